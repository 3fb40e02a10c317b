"""Near-duplicates by SetSketch: documents whose shingle sets have a Jaccard similarity of `threshold` or more.

1. `sketch` turns each whole text into its shingle set's size, a 128-bit fingerprint of the set and M registers: truncated
   minima on an exponential scale (base BASE), so registers of parts merge by their maximum and two sets' registers agree
   about as often as the sets are similar. Equal sets become one class, known by its smallest doc_id, before anything else.
2. Registers are banded: classes that agree on ROWS registers of one of BANDS bands share a bucket.
3. In each bucket every class is held against the smallest one. The joint likelihood of the two sketches (sizes are known)
   estimates the similarity; a pair that may reach the threshold is confirmed on full sets.
4. Buckets that then still hold several components get their other pairs: the bucket is cut into blocks, whose pairs are
   compared sketch by sketch, each pair only in the first band that it shares, only across components. Sets of up to PRINTED
   shingles also have 16-bit fingerprints of all of them there, whose matches bound the intersection from above, so few
   pairs but true links leave a block; these are confirmed. So no link between different sets is lost to step 3, and
   nothing is capped.
5. Components of the confirmed links.

A pair at 0.8 shares no band with a chance of 1.3e-7, and its estimate falls short by MARGIN with one below 1e-6.
Nothing of one document goes to the driver. Hot buckets: the smallest class comes from an aggregation, its join with the
members and that of classes with their copies are equi-joins that adaptive execution splits, and blocks have at most
2 * BLOCK members.

Defined results: null or empty text, or one without words, has no shingles and is linked with nothing; a text with fewer
words than a shingle has the whole sequence as its one shingle; rows with equal doc_id are one document, linked with all
that one of them is linked with; rows without doc_id are linked with nothing and kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import MIX_1, MIX_2, Scratch, Texts, U, cut, mix, ranges, slices, windows_hash, words_of
from siltstone.llm.components import components

BANDS, ROWS = 40, 5
M = BANDS * ROWS
#: Up to so many ids of documents to confirm are broadcast (8 bytes each), more are joined by a shuffle.
BROADCAST_IDS = 20_000
_NO_PRINT = np.zeros(0, "<u2")
#: SetSketch's parameters: base, rate and the largest register, as in Ertl (2021) for 16-bit registers.
BASE, RATE, LARGEST = 1.001, 20.0, 65_535
MARGIN = 0.15
BLOCK = 1024
#: A sketch holds 16-bit fingerprints of all shingles of sets up to this size.
PRINTED = 1024
FACTORS = (mix(np.arange(1, M + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, ascending within each text, and where each text's begin."""
    words = words_of(texts, lower=True)
    hashes = words.hashes()
    firsts, found = windows_hash(words, hashes, n)
    counts = np.diff(words.first)
    text = np.searchsorted(words.first, firsts, "right") - 1
    for k in np.unique(counts[(counts > 0) & (counts < n)]).tolist():  # fewer words than a shingle has
        own = np.flatnonzero(counts == k)
        short, h = windows_hash(words, hashes, k)
        keep = np.isin(short, words.first[own])
        found = np.concatenate([found, h[keep]])
        text = np.concatenate([text, np.searchsorted(words.first, short[keep], "right") - 1])
    order = np.argsort(found)
    order = order[np.argsort(text[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def registers_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """M registers of each non-empty set, one row a set."""
    small, firsts = (sets >> U(32)).astype(np.uint32), bounds[:-1]
    least = np.empty((M, len(firsts)), np.uint32)
    for i in range(M):
        np.minimum.reduceat(small * FACTORS[i], firsts, out=least[i])
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**32
    minimum = -np.log1p(-uniform) / RATE  # of exponential variates with that rate
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, LARGEST).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union's registers."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most likelihood, for rows of registers and known set sizes, to 1/200."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    jaccard = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[None, :]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = np.clip(chance(u - v * jaccard), 1e-12, 1), np.clip(chance(v - u * jaccard), 1e-12, 1)
    likely = more * np.log(p) + less * np.log(q) + (M - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))
    return jaccard[np.arange(len(a)), likely.argmax(1)]


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (set_1, set_2), and as bytes its registers (null: no
    shingles) and its shingles' 16-bit fingerprints (null: too many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets, bounds = shingle_sets(texts, shingle)
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            prints = np.zeros((2, len(counts)), U)
            raw: list[bytes | None] = [None] * len(counts)
            short: list[bytes | None] = [None] * len(counts)
            if len(full):
                edges = np.append(bounds[full], len(sets))
                for k, factor in enumerate((MIX_1, MIX_2)):
                    prints[k, full] = np.add.reduceat(mix(sets * factor), edges[:-1])
                for k, row in zip(full.tolist(), registers_of(sets, edges)):
                    raw[k] = row.tobytes()
                tags = (sets >> U(48)).astype("<u2")
                for k in np.flatnonzero((counts > 0) & (counts <= PRINTED)).tolist():
                    short[k] = tags[bounds[k] : bounds[k + 1]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(raw, pa.binary()), pa.array(short, pa.binary())],
                ["doc_id", "n_shingles", "set_1", "set_2", "registers", "prints"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_1 long, set_2 long, registers binary, prints binary")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets, bounds = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles binary")


def registers_in(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, M)


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of classes those whose sketches don't rule out the threshold."""
    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n_a, n_b = (np.asarray(part.column(x), np.float64) for x in ("n_a", "n_b"))
                keep = estimate(registers_in(part.column("r_a")), registers_in(part.column("r_b")), n_a, n_b) >= threshold - MARGIN
                yield part.select(["a", "b"]).filter(pa.array(keep))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    return near.mapInArrow(run, "a long, b long")


def chosen(rows: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """rows whose doc_id is in ids; `few`: where BROADCAST_IDS allows it, ids are broadcast."""
    return rows.join(F.broadcast(ids) if few and ids.count() <= BROADCAST_IDS else ids.hint("merge"), "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, scratch: Scratch, name: str, few: bool = False) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union of their full sets; few: few documents are likely."""
    asked = pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    asked = scratch.put(asked, f"{name}_asked")
    sets = scratch.put(full_sets(chosen(docs.select("doc_id", "text"), asked, few), shingle), f"{name}_sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                one, two = (np.frombuffer(s.as_buffer(), U) for s in (x, y))
                both = np.concatenate([one, two])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s_{x}"))
    return scratch.put(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long"), name)


def unseen_pairs(buckets: DataFrame, sketches: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components that may reach the threshold, each once.

    buckets: key, band, doc_id, component. A bucket with more than BLOCK members is cut into parts of about that many, and
    each two parts meet in one block.
    """
    mixed = buckets.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("size > 2 and low < high").select("key", "size")
    rows = buckets.join(mixed, "key").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", "band", "doc_id", "component", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    rows = scratch.put(rows, "block_rows")
    ids = scratch.put(rows.select("doc_id").distinct(), "block_ids")
    own = chosen(sketches.where("n_shingles > 0").select("doc_id", "n_shingles", "registers", "prints"), ids, few=True)
    rows = rows.join(own, "doc_id")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def compare(group: pa.Table) -> pa.RecordBatch:
        ids, comp, part, n = (np.asarray(group.column(x)) for x in ("doc_id", "component", "part", "n_shingles"))
        band, p, q = (group.column(x)[0].as_py() for x in ("band", "p", "q"))
        regs = registers_in(group.column("registers").combine_chunks())
        prints = [x if x is None else np.frombuffer(x, "<u2") for x in group.column("prints").to_pylist()]
        known = np.array([x is not None for x in prints])
        flat, edges = np.concatenate([_NO_PRINT, *(x for x in prints if x is not None)]), np.cumsum([0, *(0 if x is None else len(x) for x in prints)])
        times = np.zeros(1 << 16, np.int64)
        found_a, found_b = [], []
        for i in range(len(ids)):
            if p != q and part[i] != p:
                continue
            other = np.flatnonzero((comp != comp[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9) & ((part == q) if p != q else (np.arange(len(ids)) > i)))
            if not len(other):
                continue
            same = (regs[other] == regs[i]).reshape(len(other), BANDS, ROWS).all(2)
            other = other[same.argmax(1) == band]
            if len(other) and known[i]:
                times[:] = np.bincount(prints[i], minlength=1 << 16)
                tested = other[known[other]]
                at, sizes = ranges(edges[tested], edges[tested + 1] - edges[tested]), edges[tested + 1] - edges[tested]
                # A tag that i has twice may match two shingles with that tag: times bounds it from above.
                shared = np.add.reduceat(times[flat[at]], np.cumsum(sizes) - sizes) if len(tested) else sizes
                shared = np.minimum(shared, np.minimum(n[i], n[tested]))
                other = np.concatenate([tested[shared >= threshold * (n[i] + n[tested] - shared) - 1e-9], other[~known[other]]])
            if len(other):
                mine = np.repeat(regs[i][None], len(other), 0)
                other = other[estimate(mine, regs[other], np.full(len(other), float(n[i])), n[other].astype(float)) >= threshold - MARGIN]
                found_a.append(np.minimum(ids[i], ids[other]))
                found_b.append(np.maximum(ids[i], ids[other]))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *found_a])), pa.array(np.concatenate([none, *found_b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the current block, at most about 2 * BLOCK rows

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(x)) for x in ("key", "p", "q")]
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                piece = batch.slice(a, b - a)
                if held and any(held[-1].column(x)[0] != piece.column(x)[0] for x in ("key", "p", "q")):
                    yield compare(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that one), for every row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        return cut(_near_duplicates(docs, shingle, percent, scratch))


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    threshold = percent / 100
    sketches = scratch.put(sketch(docs, shingle), "sketches")
    known = sketches.where("doc_id is not null and n_shingles > 0")
    same_set = ["set_1", "set_2", "n_shingles"]  # and hence the same registers
    heads = scratch.put(known.groupBy(*same_set).agg(F.min("doc_id").alias("head"), F.first("registers").alias("registers")), "heads")
    member = known.select("doc_id", *same_set).join(heads.select(*same_set, "head"), same_set).select("doc_id", "head").distinct()
    classes = heads.select(F.col("head").alias("doc_id"), "n_shingles", "registers")

    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, {2 * ROWS} * i + 1, {2 * ROWS})))")
    rows = classes.select("doc_id", F.posexplode(band).alias("band", "key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    buckets = scratch.put(rows.join(first, "key"), "buckets")
    pairs = scratch.put(buckets.where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = confirm(scratch.put(likely(pairs, classes, threshold), "likely"), docs, shingle, percent, scratch, "links")
    # A document in several classes (rows with equal doc_id) links them.
    twice = member.where("head < doc_id").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).join(classes.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    links = links.unionAll(twice)
    found = components(links)

    labelled = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    more = scratch.put(unseen_pairs(labelled, sketches, threshold, scratch).join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        so_far = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(so_far.unionAll(confirm(more, docs, shingle, percent, scratch, "more_links", few=True)))
    of_head = found.select(F.col("node").alias("head"), F.col("component").alias("of_head"))
    labels = member.join(of_head, "head", "left").groupBy("doc_id").agg(F.min(F.coalesce("of_head", "head")).alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
