"""Suffix-array dedup on bytes: drop every byte in a string of `length` bytes that starts in more than one place.

1. A string of `length` bytes has an anchor, the leftmost of its MER-byte runs with the smallest hash, and equal strings have
   equal ones at the same distance. First only anchors' hashes and places travel (one for about length / 3 bytes); a hash
   found in one place alone has no repeated string. The strings of one anchor lie together as one packed string, and equal
   packed strings are counted as one from there on.
2. Suffix arrays are sparse: they hold the suffix at every anchor, in order, and the texts before the anchors in order of
   their reverse. A string that starts d bytes before an anchor repeats where two packed strings agree on d bytes before it
   and on length - d bytes from it: both orders' neighbours give trees of common prefixes, and a string belongs to one node
   of each (`repeats`). So one suffix is sorted for a run of starts, and each start is still decided by its bytes.
3. The arrays form an index family (`Family`): a new batch of documents gets its arrays, is merge-scanned against every level,
   and enters as a level of its own; levels of about one size merge, so sizes stay geometric and a suffix is merged a
   logarithmic number of times. `Index` keeps a family for each part of the anchors' hashes in a table of the shared folder,
   which outlives tasks and jobs: every batch of documents reads the levels that are there and writes what they become.
4. An anchor with over HOT different packed strings isn't held in one part: its strings are counted by 128-bit fingerprint in
   units of a fixed size (siltstone.llm.desks).

Documents are told apart by their text (128 bits of hash), as equal texts lose equal bytes. So rows without doc_id, or with
equal doc_id, count like any other row: their text repeats others' and others repeat theirs.

Defined results: null or empty text has no bytes; a text shorter than `length` loses nothing; an empty table gives no rows;
other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BYTE_BASE, MIX_2, Scratch, Texts, U, covered, cut, mix, powers, prefix_sums, run_starts, slices, sliding_min, spans_hash, texts_of, whole_groups
from siltstone.llm.desks import IDS, gathered

LENGTH, MER = 400, 100
HOT = 20_000
#: Batches that the documents are dealt in, by a hash of their text.
BATCHES = 4
PART_BYTES = 8_000_000
SECOND_BASE = U(0xD6E8FEB86659FD93)
KEY = ["print_1", "print_2"]


# ---- packed strings ----------------------------------------------------------------------------------------------------


def anchors(texts: Texts, length: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first start, number of starts, the anchor's distance from the first start, its hash."""
    starts = run_starts(texts.bounds, length)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, U)
    prefix = prefix_sums(texts.data, BYTE_BASE)
    n = len(texts.data) - mer + 1
    order = mix((prefix[mer:] - prefix[:n]) * powers(U(pow(int(BYTE_BASE), -1, 1 << 64)), n))
    low = U(0xFFFFFFFF)  # the upper half of the hash, then the place
    place = (sliding_min((order & ~low) | np.arange(n, dtype=U), length - mer + 1)[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), place[at] - starts[at], order[place[at]]


def places(docs: DataFrame, length: int, mer: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            starts, count, off, least = anchors(texts, length, mer)
            text = texts.of(starts)
            own = [part.column(c).take(pa.array(text)) for c in KEY]
            ints = [pa.array(x.astype(np.int32)) for x in (starts - texts.bounds[text], count, off)]
            yield pa.RecordBatch.from_arrays([*own, *ints, pa.array(least.view(np.int64))], [*KEY, "start", "n", "off", "mini"])

    return docs.mapInArrow(run, "print_1 long, print_2 long, start int, n int, off int, mini long")


def packed(found: DataFrame, length: int) -> DataFrame:
    """found: the key, text, at (array of start, n, off, mini). A row per run with IDS of its packed string.

    Only the first row of a string in a slice of texts has its bytes, and in `times` how many rows the slice has of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            lists = part.column("at")
            flat = lists.flatten()
            text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
            start, n, off, mini = (np.asarray(flat.field(x)).astype(np.int64) for x in ("start", "n", "off", "mini"))
            low = texts.bounds[text] + start
            high = low + n + (length - 1)
            ids = np.stack([spans_hash(p, base, low, high) for p, base in two_sums(texts.data)], 1)
            _, first, place, times = np.unique(ids[:, 0] ^ mix(ids[:, 1]), return_index=True, return_inverse=True, return_counts=True)
            times = np.where(first[place] == np.arange(len(place)), times[place], 0)
            raw = texts.data.tobytes()
            strings = pa.array([raw[a:b] if t else None for a, b, t in zip(low.tolist(), high.tolist(), times.tolist())], pa.binary())
            own = [part.column(c).take(pa.array(text)) for c in KEY]
            ints = [pa.array(x.astype(np.int32)) for x in (start, n, off, times)]
            yield pa.RecordBatch.from_arrays([*own, *ints, pa.array(mini), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in ids.T), strings], [*KEY, "start", "n", "off", "times", "mini", *IDS, "bytes"])

    return found.mapInArrow(run, "print_1 long, print_2 long, start int, n int, off int, times int, mini long, id_1 long, id_2 long, bytes binary")


def two_sums(data: np.ndarray) -> list[tuple[np.ndarray, np.uint64]]:
    return [(prefix_sums(x, base), base) for x, base in ((data, BYTE_BASE), (mix(data.astype(U) + MIX_2), SECOND_BASE))]


# ---- suffix arrays -----------------------------------------------------------------------------------------------------


@dataclass
class Arrays:
    """Packed strings, and their places in order of the suffix at the anchor and of the reversed text before it."""

    texts: list[bytes]
    off: list[int]
    n: list[int]
    mini: list[int]
    number: list[int]  # what a match is reported for
    right: list[int]
    left: list[int]

    def __len__(self) -> int:
        return len(self.texts)

    def rights(self) -> list[bytes]:
        return [x[a:] for x, a in zip(self.texts, self.off)]

    def lefts(self) -> list[bytes]:
        return [x[:a][::-1] for x, a in zip(self.texts, self.off)]

    def some(self, keep: set[int]) -> Arrays:
        """Those with one of these anchors' hashes, in the same orders."""
        own = [i for i, m in enumerate(self.mini) if m in keep]
        if len(own) == len(self):
            return self
        new = {i: k for k, i in enumerate(own)}
        pick = lambda x: [x[i] for i in own]
        return Arrays(*map(pick, (self.texts, self.off, self.n, self.mini, self.number)), *([new[i] for i in order if i in new] for order in (self.right, self.left)))


def arrays(texts: list[bytes], off: list[int], n: list[int], mini: list[int], number: list[int]) -> Arrays:
    out = Arrays(texts, off, n, mini, number, [], [])
    every = range(len(texts))
    out.right, out.left = sorted(every, key=out.rights().__getitem__), sorted(every, key=out.lefts().__getitem__)
    return out


def merged(a: Arrays, b: Arrays) -> Arrays:
    """Two ascending runs each: one linear merge, as sorted() finds runs."""
    k = len(a)
    out = Arrays(a.texts + b.texts, a.off + b.off, a.n + b.n, a.mini + b.mini, a.number + b.number, [], [])
    out.right = sorted(a.right + [k + i for i in b.right], key=out.rights().__getitem__)
    out.left = sorted(a.left + [k + i for i in b.left], key=out.lefts().__getitem__)
    return out


def common(keys: list[bytes], width: int) -> list[int]:
    """Of strings in order: how many bytes each shares with the one before; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    size = np.array([len(k) for k in keys])
    for at in range(0, len(keys), 4096):
        own = keys[max(at - 1, 0) : at + 4096]
        table = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in own), np.uint8).reshape(len(own), width)
        differ = table[1:] != table[:-1]
        same = np.where(differ.any(1), differ.argmax(1), width)
        low = max(at, 1)
        out[low : low + len(same)] = same
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out.tolist()


def tree(shared: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """The tree of common prefixes of at least that many bytes, of strings in order with what each shares with the one before:
    each string's node, each node's depth, each node's parent; node 0 is the root."""
    depth, parent, of = [0], [0], []
    stack = [0]
    for k in [*(x if x >= least else 0 for x in shared[1:]), 0]:
        before, last = stack[-1], 0
        while depth[stack[-1]] > k:
            last = stack.pop()
        if depth[stack[-1]] < k:
            depth.append(k), parent.append(stack[-1])
            stack.append(len(depth) - 1)
            if last:
                parent[last] = stack[-1]
        of.append(stack[-1] if k > depth[before] else before)
    return of, depth, parent


def repeats(x: Arrays, length: int, mer: int) -> list[tuple[int, int, int]]:
    """(number, first start, end of starts) of strings of `length` bytes that lie in more than one packed string."""
    rights, lefts = x.rights(), x.lefts()
    of_right, deep, up = tree(common([rights[i] for i in x.right], length), mer)
    of_left, deep_left, up_left = tree(common([lefts[i] for i in x.left], length - mer), 1)
    right, left = [0] * len(x), [0] * len(x)
    for i, u in zip(x.right, of_right):
        right[i] = u
    for i, w in zip(x.left, of_left):
        left[i] = w
    pieces, count = [], {}
    for i, u in enumerate(right):
        if not u:
            continue
        path, w = [0], left[i]
        while w:
            path.insert(1, w)
            w = up_left[w]
        last, k = x.off[i], 0  # a start's distance from the anchor goes from this one on to `last`
        d = max(last - x.n[i] + 1, length - deep[u])
        while u and d <= last:
            if length - 1 - deep[up[u]] < d:
                u = up[u]
                continue
            while k < len(path) and deep_left[path[k]] < d:
                k += 1
            if k == len(path):
                break
            end = min(last, length - 1 - deep[up[u]], deep_left[path[k]])
            pieces.append((i, (u, path[k]), d, end))
            count[u, path[k]] = count.get((u, path[k]), 0) + 1
            d = end + 1
    return [(x.number[i], x.off[i] - end, x.off[i] - d + 1) for i, node, d, end in pieces if count[node] > 1]


class Family:
    """Levels of growing size; `found` has what was seen more than once."""

    def __init__(self, length: int, mer: int, levels: list[Arrays] | None = None) -> None:
        self.length, self.mer, self.levels = length, mer, levels or []
        self.found: list[tuple[int, int, int]] = []

    def add(self, batch: Arrays) -> None:
        self.found += repeats(batch, self.length, self.mer)
        for level in self.levels:  # merge-scan: what of the level has one of the batch's anchors, in one order with the batch
            own = level.some(set(batch.mini))
            if len(own):
                self.found += repeats(merged(own, batch.some(set(own.mini))), self.length, self.mer)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [merged(*self.levels[-2:])]


LEVELS = "part int, level int, place int, back int, id_1 long, id_2 long, mini long, off int, n int, bytes binary"


class Index:
    """A family for each part of the anchors' hashes, as a table: a row a packed string, with its place in both orders."""

    def __init__(self, scratch: Scratch, parts: int, length: int, mer: int) -> None:
        self.scratch, self.parts, self.length, self.mer, self.batches = scratch, parts, length, mer, 0
        self.levels: DataFrame | None = None

    def add(self, strings: DataFrame) -> DataFrame:
        """strings: IDS, mini, off, n, bytes, distinct. Returns IDS, low, high: starts seen more than once, of old strings too."""
        length, mer = self.length, self.mer
        new = strings.select(F.pmod(F.xxhash64("mini"), F.lit(self.parts)).cast("int").alias("part"), F.lit(-1).alias("level"), F.lit(0).alias("place"), F.lit(0).alias("back"), *IDS, "mini", "off", "n", "bytes")
        rows = new if self.levels is None else self.levels.unionByName(new)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in whole_groups(batches, ["part"]):
                for at in group_slices(some, "part"):
                    yield from family_step(at, length, mer)

        rows = rows.repartition(self.parts, "part").sortWithinPartitions("part", "level", "place")
        self.batches += 1
        out = self.scratch.put(rows.mapInArrow(run, LEVELS + ", low int, high int"), f"levels_{self.batches}")
        self.levels = out.where("level >= 0").drop("low", "high")
        return out.where("level < 0").select(*IDS, "low", "high")


def group_slices(table: pa.Table, key: str) -> Iterator[pa.Table]:
    own = np.asarray(table.column(key))
    edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for a, b in zip(edges, edges[1:]):
        yield table.slice(a, b - a)


def family_step(part: pa.Table, length: int, mer: int) -> Iterator[pa.RecordBatch]:
    """One part's levels, largest first, and its new strings (level -1): adds these, returns matches (level -1) and new levels."""
    part = part.combine_chunks()
    columns = [part.column(c).to_pylist() for c in ("bytes", "off", "n", "mini")]
    level, back = np.asarray(part.column("level")), np.asarray(part.column("back"))
    have = []
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)  # in order of place
        low, size = int(own[0]), len(own)
        left = np.empty(size, np.int64)
        left[back[own]] = np.arange(size)
        have.append(Arrays(*(c[low : low + size] for c in columns), list(range(low, low + size)), list(range(size)), left.tolist()))
    family = Family(length, mer, have)
    own = np.flatnonzero(level < 0).tolist()
    if own:
        family.add(arrays(*([c[i] for i in own] for c in columns), own))
    id_1, id_2, number = part.column("id_1").combine_chunks(), part.column("id_2").combine_chunks(), part.column("part")[0].as_py()

    def rows(level: int, own: list[int], place: list[int], back: list[int], low: list[int], high: list[int], whole: bool) -> pa.RecordBatch:
        at, ints = pa.array(own, pa.int64()), lambda v: pa.array(v, pa.int32())
        rest = [part.column(c).combine_chunks().take(at) if whole else pa.nulls(len(own), t) for c, t in (("mini", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary()))]
        return pa.RecordBatch.from_arrays([ints([number] * len(own)), ints([level] * len(own)), ints(place), ints(back), id_1.take(at), id_2.take(at), *rest, ints(low), ints(high)], [f.split()[0] for f in LEVELS.split(", ")] + ["low", "high"])

    found = sorted(set(family.found))
    none = [0] * len(found)
    yield rows(-1, [f[0] for f in found], none, none, [f[1] for f in found], [f[2] for f in found], False)
    for k, x in enumerate(family.levels):
        place = np.empty(len(x), np.int64)
        place[x.left] = np.arange(len(x))
        none = [0] * len(x)
        yield rows(k, [x.number[i] for i in x.right], list(range(len(x))), place[x.right].tolist(), none, none, True)


# ---- over documents ----------------------------------------------------------------------------------------------------


def prints_of(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each string's text, its start there, and the fingerprint of its first `length` bytes."""
    texts = texts_of(column)
    firsts = run_starts(texts.bounds, length)
    text = texts.of(firsts)
    return text, firsts - texts.bounds[text], np.stack([spans_hash(p, base, firsts, firsts + length) for p, base in two_sums(texts.data)], 1)


def repeated_spans(docs: DataFrame, length: int = LENGTH, mer: int = MER, hot: int = HOT, batches: int = BATCHES) -> DataFrame:
    """For texts (by their key) with repeated strings: spans, byte ranges first:last to drop."""
    docs = docs.where(F.octet_length("text") >= length)
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.put(places(docs, length, mer), "places")
        shared = scratch.put(found.groupBy("mini").agg(F.count("*").alias("many")).where("many > 1").select("mini"), "shared")
        at = scratch.put(found.join(shared, "mini").groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "off", "mini")).alias("at")), "at")
        strings = scratch.put(packed(docs.join(at, KEY), length), "strings")
        once = strings.where("bytes is not null").groupBy(*IDS).agg(F.min("bytes").alias("bytes"), F.min("mini").alias("mini"), F.min("off").alias("off"), F.min("n").alias("n"), F.sum("times").alias("many"), F.min("print_1").alias("print"))
        once = scratch.put(once, "different")
        buckets = scratch.put(once.groupBy("mini").agg(F.count("*").alias("strings")).where("strings > 1"), "buckets")
        several = scratch.put(once.join(buckets.select("mini", (F.col("strings") > hot).alias("hot")), "mini").withColumn("batch", F.pmod(F.xxhash64("print", F.lit(3)), F.lit(batches))), "several")
        size = several.where("not hot").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        family = Index(scratch, max(1, -(-size // PART_BYTES)), length, mer)
        marks = once.where("many > 1").select(*IDS, F.lit(0).alias("low"), F.col("n").alias("high"))
        for k in range(batches):
            marks = marks.unionAll(family.add(several.where(~F.col("hot") & (F.col("batch") == k))))
        hottest = several.where("hot").select(*IDS, "bytes", F.lit(1).cast("long").alias("value"))
        marks = marks.unionAll(gathered(hottest, "bytes", lambda c: prints_of(c, length), False, scratch).select(*IDS, "low", "high"))
        marks = scratch.put(marks.distinct(), "marks")
        spans = strings.select(*KEY, "start", *IDS).join(marks, IDS).select(*KEY, (F.col("start") + F.col("low")).cast("int").alias("first"), (F.col("start") + F.col("high") + (length - 1)).cast("int").alias("last"))
        return cut(spans.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def dedup(docs: DataFrame, length: int = LENGTH, mer: int = MER, hot: int = HOT, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes), for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print_1"), F.xxhash64(F.lit(1), "text").alias("print_2"))
    spans = repeated_spans(docs, length, mer, hot, batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            lists = part.column("spans")
            base = np.repeat(texts.bounds[:-1], np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            flat = lists.flatten()
            gone = covered(base + np.asarray(flat.field("first")), base + np.asarray(flat.field("last")), len(texts.data))
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            edges = texts.bounds[1:-1][texts.bounds[1:-1] < len(gone)]
            begin[edges] |= gone[edges]
            per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[texts.bounds]).astype(np.int64)
            kept = np.split(texts.data[~gone], np.cumsum(per(~gone))[:-1])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (np.diff(texts.bounds), per(gone), per(begin))), pa.array([x.tobytes() for x in kept], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = docs.join(spans, KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
