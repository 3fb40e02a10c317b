"""Exact dedup against a history of digests, held in minimal perfect hashes.

A text's digest is the SHA-256 of the text without white space. The different digests of the history are dealt to shards of
about SHARD_KEYS; a shard's minimal perfect hash is a cascade of bit arrays (each digest takes a bit that no other of its level
wants, the rest go to the next level), and a digest's slot is the rank of its bit. Slots hold the full digest and the winner's
locator: its doc_id and length, and how many texts were equal. A batch is combined to one row a digest before it travels; a
digest finds its slot and is the slot's only if all 32 bytes agree. Members fall to the better of both winners; nonmembers are
groups of their own, and both together are the history of the next batch.

Hot digests are those with at least a ten-thousandth of all rows (and 1000), so there are at most 10,000 of them: these reach
their rows by broadcast, all others by a shuffle in which no key has more rows than that.

Defined results: null text counts as empty, and empty texts are equal; of equal texts the longest (code points) stays, then
the smallest doc_id, a row without doc_id only where the group's longest have none; rows that share doc_id, text and length
stay or go together; further columns are left aside, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BYTE_BASE, Scratch, U, mix, powers

SHARD_KEYS = 200_000
HOT_ROWS, HOT_SHARE = 1000, 10_000
#: Bits a digest at a level, and how many levels there are before the rest is listed.
GAMMA, LEVELS = 2, 40
BYTES = 32
WINNER = "digest binary, keep_id long, best_chars long, size long"
INDEX = "shard int, bits binary, widths array<long>, digests binary, keep_id array<long>, best_chars array<long>, size array<long>"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the text as it is), digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """One row a digest: WINNER."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"))).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count("*").alias("size"))
    return groups.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("best_chars"), "size")


# ---- the hash of a shard -----------------------------------------------------------------------------------------------


def words_of(keys: np.ndarray) -> np.ndarray:
    """n rows of 32 bytes as n rows of four 64-bit numbers."""
    return np.frombuffer(keys.tobytes(), "<u8").reshape(-1, 4)


def place(words: np.ndarray, level: int, width: int) -> np.ndarray:
    return (mix(words[:, level % 4] ^ powers(BYTE_BASE, LEVELS)[level]) % U(width)).astype(np.int64)


def perfect(words: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bits of all levels end to end and each level's width, for different keys; keys that no level takes have the last slots."""
    bits, widths, left = [np.zeros(0, bool)], [], words
    while len(left) and len(widths) < LEVELS:
        widths.append(max(64, GAMMA * len(left)))
        at = place(left, len(widths) - 1, widths[-1])
        wanted = np.bincount(at, minlength=widths[-1])
        bits.append(wanted == 1)
        left = left[wanted[at] > 1]
    return np.concatenate(bits), widths


def slots(bits: np.ndarray, widths: list[int], words: np.ndarray) -> np.ndarray:
    """A slot for each key, whether it is in the hash or not; -1 if no level has its bit."""
    rank, out, left, base = np.cumsum(bits) - 1, np.full(len(words), -1), np.arange(len(words)), 0
    for level, width in enumerate(widths):
        at = base + place(words[left], level, width)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + width
    return out


def keys_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def build_shard(table: pa.Table) -> pa.Table:
    """WINNER rows of different digests to one row of INDEX."""
    keys = keys_of(table.column("digest"))
    words = words_of(keys)
    bits, widths = perfect(words)
    slot = slots(bits, widths, words)
    slot[slot < 0] = int(bits.sum()) + np.arange(int((slot < 0).sum()))
    order = np.argsort(slot)
    held = [pa.array([table.column(c).combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(pa.int64())) for c in ("keep_id", "best_chars", "size")]
    return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([widths], pa.list_(pa.int64())), pa.array([keys[order].tobytes()], pa.binary()), *held], names=["shard", "bits", "widths", "digests", "keep_id", "best_chars", "size"])


def find_in_shard(shard: pa.Table, keys: np.ndarray) -> np.ndarray:
    """Each key's slot if the slot's digest is the key in all its bytes, else -1."""
    own = {c: shard.column(c)[0].as_py() for c in ("bits", "widths", "digests")}
    held = np.frombuffer(own["digests"], np.uint8).reshape(-1, BYTES)
    bits = np.unpackbits(np.frombuffer(own["bits"], np.uint8), count=sum(own["widths"])).astype(bool)
    slot = slots(bits, own["widths"], words_of(keys))
    if (slot < 0).any() and int(bits.sum()) < len(held):  # keys listed after all levels
        last = {held[k].tobytes(): k for k in range(int(bits.sum()), len(held))}
        for k in np.flatnonzero(slot < 0):
            slot[k] = last.get(keys[k].tobytes(), -1)
    same = slot >= 0
    same[same] = (held[slot[same]] == keys[same]).all(1)
    return np.where(same, slot, -1)


# ---- over shards -------------------------------------------------------------------------------------------------------


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build(history: DataFrame, shards: int) -> DataFrame:
    """INDEX over WINNER rows, one row a shard; write it to keep it."""
    return history.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build_shard, INDEX)


def better(a: tuple, b: tuple) -> bool:
    """Of (keep_id, best_chars): is a to be kept rather than b?"""
    return (-a[1], a[0] is None, a[0] or 0) < (-b[1], b[0] is None, b[0] or 0)


def lookup(batch: DataFrame, index: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """Adds to the batch's WINNER rows: seen, and the combined winner and size with the history's. parts: pieces of a shard's batch."""

    def ask(own: pa.Table, shard: pa.Table) -> pa.Table:
        keep, chars, size = (own.column(c).to_pylist() for c in ("keep_id", "best_chars", "size"))
        slot = find_in_shard(shard, keys_of(own.column("digest"))) if shard.num_rows and own.num_rows else np.full(own.num_rows, -1)
        if (slot >= 0).any():
            held = [shard.column(c).combine_chunks().flatten() for c in ("keep_id", "best_chars", "size")]
            for k in np.flatnonzero(slot >= 0).tolist():
                old = [x[int(slot[k])].as_py() for x in held]
                size[k] += old[2]
                if better(old[:2], (keep[k], chars[k])):
                    keep[k], chars[k] = old[:2]
        return pa.table([own.column("digest").combine_chunks().cast(pa.binary()), pa.array(keep, pa.int64()), pa.array(chars, pa.int64()), pa.array(size, pa.int64()), pa.array(slot >= 0)], names=["digest", "keep_id", "best_chars", "size", "seen"])

    left = batch.withColumns({"shard": shard_of(shards), "part": F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(parts)).cast("int")})
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(ask, f"{WINNER}, seen boolean")


def attach(rows: DataFrame, classes: DataFrame, n_rows: int) -> DataFrame:
    """rows (doc_id, n_chars, digest, ...) with their class's keep_id and group_size, and whether they are kept."""
    hot_from = max(HOT_ROWS, -(-n_rows // HOT_SHARE))
    hot = F.broadcast(classes.where(F.col("size") >= hot_from))
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(classes.where(F.col("size") < hot_from), "digest")
    every = rows.join(hot, "digest").unionByName(cold)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars"))
    return every.withColumnRenamed("size", "group_size").withColumn("kept", kept).drop("best_chars")


def dedup(docs: DataFrame, history: DataFrame, scratch: Scratch, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Both tables' rows (doc_id, n_chars, digest, keep_id, group_size, kept, batch: is it one of docs?), docs as a batch after the history."""
    rows = scratch.put(digests(history).withColumn("batch", F.lit(False)).unionByName(digests(docs).withColumn("batch", F.lit(True))), "rows")
    old, new = (scratch.put(winners(rows.where(F.col("batch") == x)), f"winners_{x}") for x in (False, True))
    n_old, n_new = old.count(), new.count()
    shards = max(1, -(-n_old // shard_keys))
    index = scratch.put(build(old, shards), "index")
    found = scratch.put(lookup(new, index, shards, max(1, -(-n_new // (shards * shard_keys)))), "found")
    # what the batch doesn't touch stays as it is in the slots
    untouched = old.join(found.where("seen").select("digest"), "digest", "left_anti")
    classes = scratch.put(found.drop("seen").unionByName(untouched), "classes")
    return attach(rows, classes, rows.count())
