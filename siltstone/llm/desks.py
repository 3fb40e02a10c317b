"""Windows of many strings brought together by fingerprint, in parts of a fixed size.

For buckets too hot to gather: the different strings are dealt in units of about UNIT_BYTES. A unit sends each desk its
different 128-bit fingerprints with their values, all packed in one row; the desk combines the values of equal fingerprints
over all units and sends them back, again one row a unit; and the unit lays them on its windows. Desks go by fingerprint and
are as many as units, so units, desks and rows keep their size and grow in number alone, however hot a string or a window is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, U

UNIT_BYTES = 2_000_000
IDS = ["id_1", "id_2"]

#: Of a column of strings, in order: each window's string, its place there, and its fingerprint (two columns).
Windows = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def with_ids(strings: DataFrame, column: str) -> DataFrame:
    """Adds IDS, 128 bits of hash of the string."""
    return strings.withColumns({"id_1": F.xxhash64(column), "id_2": F.xxhash64(F.lit(1), column)})


def distinct_prints(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different fingerprints, ascending, and each row's place among them."""
    order = np.lexsort((prints[:, 1], prints[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (prints[order[1:]] != prints[order[:-1]]).any(1)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return prints[order[new]], place


def combined(values: np.ndarray, place: np.ndarray, n: int, least: bool) -> np.ndarray:
    if least:
        out = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(out, place, values)
        return out
    return np.minimum(np.bincount(place, values, minlength=n), 2).astype(np.int64)


def gathered(once: DataFrame, column: str, windows: Windows, least: bool, scratch: Scratch, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """once: IDS, the string, value (long), ids distinct. Returns IDS, low, high, value: runs of windows of one combined value.

    Values of equal windows are combined to their least or, if not least, to their sum, 2 standing for more; of sums, only
    runs with 2 are returned.
    """
    once = scratch.put(once.select(*IDS, column, "value"), "once")
    units = max(1, -(-(once.agg(F.sum(F.octet_length(column))).first()[0] or 0) // unit_bytes))
    once = once.withColumn("unit", F.pmod(F.xxhash64("id_1", F.lit(5)), F.lit(units)))

    def split(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by([(x, "ascending") for x in IDS])
        string, at, prints = windows(table.column(column).combine_chunks())
        prints, place = distinct_prints(prints)
        return table, string, at, place, prints, (prints[:, 0] >> U(20)) % U(units)

    def ask(table: pa.Table) -> pa.Table:
        table, string, _, place, prints, desk = split(table)
        values = combined(np.asarray(table.column("value"))[string], place, len(prints), least)
        order = np.argsort(desk, kind="stable")
        desks, at = np.unique(desk[order], return_index=True)
        parts = np.split(order, at[1:]) if len(order) else []
        unit = table.column("unit")[0].as_py()
        return pa.table({"unit": pa.array([unit] * len(parts), pa.int64()), "desk": pa.array(desks.astype(np.int64)), "prints": pa.array([prints[x].tobytes() for x in parts], pa.binary()), "values": pa.array([values[x].tobytes() for x in parts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, U).reshape(-1, 2) for x in table.column("prints").to_pylist()]
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.int64)
        different, place = distinct_prints(np.concatenate(prints))
        total = combined(values, place, len(different), least)[place]
        parts = np.split(total, np.cumsum([len(x) for x in prints])[:-1])
        return pa.table({"unit": table.column("unit"), "desk": table.column("desk"), "values": pa.array([x.tobytes() for x in parts], pa.binary())})

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, string, at, place, prints, desk = split(table)
        total = np.zeros(len(prints), np.int64)
        for k, values in zip(answers.column("desk").to_pylist(), answers.column("values").to_pylist()):
            total[desk == U(k)] = np.frombuffer(values, np.int64)
        value = total[place]
        hit = np.arange(len(value)) if least else np.flatnonzero(value > 1)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (string[hit[1:]] != string[hit[:-1]]) | (at[hit[1:]] != at[hit[:-1]] + 1) | (value[hit[1:]] != value[hit[:-1]])
        begin = np.flatnonzero(new)
        count, begin = np.diff(np.append(begin, len(hit))), hit[begin]
        own = [table.column(c).combine_chunks().take(pa.array(string[begin])) for c in IDS]
        low = at[begin]
        return pa.table([*own, pa.array(low.astype(np.int32)), pa.array((low + count).astype(np.int32)), pa.array(value[begin])], names=[*IDS, "low", "high", "value"])

    asked = scratch.put(once.groupBy("unit").applyInArrow(ask, "unit long, desk long, prints binary, values binary"), "asked")
    answers = asked.groupBy("desk").applyInArrow(answer, "unit long, desk long, values binary")
    return once.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(mark, "id_1 long, id_2 long, low int, high int, value long")
