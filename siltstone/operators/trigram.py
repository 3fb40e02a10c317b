"""Keyword search over an index of character trigrams.

For each page the different trigrams of its title and content, ASCII-lowered, are posted under the trigram in blocks: a block is a
range of BLOCK ids, so that no posting list is longer, however common its trigram; its ids are sorted and kept as
variable-length differences. A query's wildcards cut it into literal runs; the trigrams of all runs are looked up, their lists
are intersected block by block, and the pages that are left are verified by the same LIKE as a scan's. A query without a run
of three characters is a scan.

Layout under the index's path: `postings/slot=` by a hash of the trigram, sorted by trigram and block; `pages/block=`, so that only
blocks with candidates are read. Results equal `search.matching`'s; pages without an id, or with a negative one, have no postings and
are scanned (block -1).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.text import LOWER, UPPER, like_pattern
from siltstone.operators.state import cut

BLOCK, SLOTS = 1 << 14, 32
#: Postings that a task gathers before it makes lists of them; one text's are never parted.
SLICE_CHARS = 2_000_000
#: Bytes of lists that are joined or intersected at a time.
JOINED = 1 << 20
#: Up to so many blocks with candidates are named in the pages' scan; beyond, pages are read whole and joined.
NAMED_BLOCKS = 1000
POSTINGS = "trigram long, block long, ids binary"


def pack(numbers: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of ascending non-negative numbers, end to end, to one binary value each.

    A number is its difference to the one before in its list, 7 bits a byte, the lowest first; the eighth bit says that more follow.
    """
    gaps = np.diff(numbers, prepend=0)
    gaps[starts] = numbers[starts]
    gaps = gaps.astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[ends[own] - size[own] + k] = ((gaps[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    bounds = np.append((ends - size)[starts], len(out))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpack(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of binary values, and which value each is of."""
    lists = lists.cast(pa.large_binary())
    bounds = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int64)
    raw = np.frombuffer(lists.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw)))))
    gaps = np.add.reduceat((raw & 127).astype(np.int64) << shift, first)
    owner = np.searchsorted(bounds - bounds[0], first, "right") - 1
    total = np.cumsum(gaps)
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    return total - np.repeat(total[at] - gaps[at], np.diff(np.append(at, len(owner)))), owner


def trigrams(text: str) -> np.ndarray:
    """Each three neighbouring characters, ASCII-lowered, as one number of 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    points += np.where((points >= 65) & (points <= 90), 32, 0)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) > 2 else np.zeros(0, np.int64)


def runs(query: str, literal: bool = False) -> list[str]:
    """The literal runs of a LIKE pattern, ASCII-lowered: what every match holds."""
    low = query.translate(str.maketrans(UPPER, LOWER))
    return [low] if literal else low.replace("_", "%").split("%")


def query_trigrams(query: str, literal: bool = False) -> list[int]:
    return sorted({t for r in runs(query, literal) for t in trigrams(r).tolist()})


def slot_of(trigram: int | Column, slots: int) -> int | Column:
    """The remainder of the three code points' exclusive or, for a number as for a column."""
    if isinstance(trigram, int):
        return ((trigram >> 42) ^ (trigram >> 21 & 0x1FFFFF) ^ (trigram & 0x1FFFFF)) % slots
    low = lambda c: c.bitwiseAND(F.lit(0x1FFFFF))
    return (F.shiftright(trigram, 42).bitwiseXOR(low(F.shiftright(trigram, 21))).bitwiseXOR(low(trigram)) % slots).cast("int")


def _posted(trigram: np.ndarray, ids: np.ndarray, block: int) -> pa.RecordBatch:
    """Pairs to lists of one trigram and block."""
    order = np.lexsort((ids, trigram))
    trigram, ids = trigram[order], ids[order]
    own = ids // block
    new = np.ones(len(ids), bool)
    new[1:] = (trigram[1:] != trigram[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return pa.record_batch([pa.array(trigram[at]), pa.array(own[at]), pack(ids - own * block, at)], names=["trigram", "block", "ids"])


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose `lists` have JOINED bytes, or one row: a number takes a byte at least, and some hundred while it is joined."""
    lists = batch.column("lists")
    sizes = np.asarray(pc.fill_null(pc.binary_length(lists.flatten()), 0), np.int64)
    ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
    total = np.concatenate([[0], np.cumsum(sizes)])[ends]
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + JOINED, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def postings(pages: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """POSTINGS and slot of pages (id, title, content), ids not negative: tasks post slices, lists of one trigram and block are joined."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for i, *fields in zip(*(batch.column(c).to_pylist() for c in ("id", "title", "content"))):
                own = np.sort(np.concatenate([trigrams(x) for x in fields if x] or [np.zeros(0, np.int64)]))
                own = own[np.diff(own, prepend=-1) != 0]
                found.append((own, np.full(len(own), i)))
                held += len(own)
                if held >= SLICE_CHARS:
                    yield _posted(*map(np.concatenate, zip(*found)), block)
                    found, held = [], 0
        if held:
            yield _posted(*map(np.concatenate, zip(*found)), block)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            lists = batch.column("lists")
            numbers, value = unpack(lists.flatten())
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))[value]
            order = np.lexsort((numbers, owner))
            numbers, owner = numbers[order], owner[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (numbers[1:] != numbers[:-1])  # rows that repeat
            numbers, owner = numbers[new], owner[new]
            yield pa.record_batch([*(batch.column(c) for c in ("trigram", "block")), pack(numbers, np.flatnonzero(np.diff(owner, prepend=-1)))], names=["trigram", "block", "ids"])

    own = pages.where("id >= 0").select(F.col("id").cast("long"), F.col("title"), F.col("content"))
    lists = own.mapInArrow(post, POSTINGS).groupBy("trigram", "block").agg(F.collect_list("ids").alias("lists")).mapInArrow(join, POSTINGS)
    return lists.withColumn("slot", slot_of(F.col("trigram"), slots))


def build(pages: DataFrame, path: str, block: int = BLOCK, slots: int = SLOTS) -> None:
    """Writes the index of pages (id, title, content, ...)."""
    (postings(pages, block, slots).repartitionByRange("slot", "trigram", "block").sortWithinPartitions("slot", "trigram", "block")
        .write.option("compression", "zstd").partitionBy("slot").parquet(f"{path}/postings"))
    own = F.when(F.col("id") >= 0, F.floor(F.col("id") / block)).otherwise(-1).cast("long")
    (pages.withColumn("block", own).repartitionByRange("block", "id").sortWithinPartitions("block", "id")
        .write.option("compression", "zstd").partitionBy("block").parquet(f"{path}/pages"))
    pages.sparkSession.createDataFrame([(block, slots, pages.schema.json())], "block long, slots int, pages string").coalesce(1).write.parquet(f"{path}/shape")


def candidates(spark: SparkSession, path: str, wanted: dict[str, list[int]]) -> DataFrame:
    """query, block, id: pages that have all of the query's trigrams, in whatever order and field."""
    block, slots, _ = spark.read.parquet(f"{path}/shape").first()
    asked = [(q, t) for q, own in wanted.items() for t in own]
    every = sorted({t for _, t in asked})
    lists = spark.read.schema(f"{POSTINGS}, slot int").parquet(f"{path}/postings").where(F.col("slot").isin(sorted({slot_of(t, slots) for t in every})) & F.col("trigram").isin(every))
    by_query = F.broadcast(spark.createDataFrame(asked, "query string, trigram long"))  # what the caller asks
    least = F.broadcast(spark.createDataFrame([(q, len(own)) for q, own in wanted.items()], "query string, least long"))
    whole = lists.join(by_query, "trigram").groupBy("query", "block").agg(F.collect_list("ids").alias("lists")).join(least, "query").where(F.size("lists") == F.col("least"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                query, own, ids = [], [], []
                for q, b, lists in zip(*(part.column(c) for c in ("query", "block", "lists"))):
                    numbers, _ = unpack(lists.values)
                    numbers, times = np.unique(numbers, return_counts=True)
                    left = numbers[times == len(lists)]  # in every list
                    query.append(np.repeat(q.as_py(), len(left)))
                    own.append(np.full(len(left), b.as_py()))
                    ids.append(left + b.as_py() * block)
                yield pa.record_batch([pa.array(np.concatenate(query).tolist(), pa.string()), pa.array(np.concatenate(own)), pa.array(np.concatenate(ids))], names=["query", "block", "id"])

    return whole.select("query", "block", "lists").mapInArrow(meet, "query string, block long, id long")


def _matches(query: str, literal: bool) -> Column:
    """As `search.matching` decides; what both do is tested."""
    pattern = like_pattern(query, literal)
    return F.col("title").rlike(pattern) | F.col("content").rlike(pattern)


def search_many(spark: SparkSession, path: str, queries: dict[str, tuple[str, bool]]) -> DataFrame:
    """`query` (a name) and the page's columns, of every page that matches; queries: name to (query, literal).

    Equal to `search.matching` over the pages that the index was built of, for each query.
    """
    columns = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/shape").first().pages))
    pages = spark.read.schema(columns.add("block", "long")).parquet(f"{path}/pages")
    wanted = {name: query_trigrams(*q) for name, q in queries.items()}
    indexed = {name: own for name, own in wanted.items() if own}
    scans = [(pages if name not in indexed else pages.where("block = -1")).where(_matches(*q)).withColumn("query", F.lit(name)) for name, q in queries.items()]
    if indexed:
        found = cut(candidates(spark, path, indexed))
        blocks = [r.block for r in found.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
        near = pages.where(F.col("block").isin(blocks)) if len(blocks) <= NAMED_BLOCKS else pages
        rows = near.join(found, ["block", "id"])
        hit = reduce(lambda c, name: c.when(F.col("query") == name, _matches(*queries[name])), indexed, F.when(F.lit(False), F.lit(False)))
        scans.append(rows.where(hit).select(*pages.columns, "query"))
    return reduce(DataFrame.unionByName, scans).drop("block")


def search_index(spark: SparkSession, path: str, query: str, literal: bool = False) -> DataFrame:
    """The pages that match, as `search.matching` has them."""
    return search_many(spark, path, {"": (query, literal)}).drop("query")
