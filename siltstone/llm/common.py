"""What the training-data operators share: word and byte kernels on Arrow buffers, and cutting of lineage.

The kernels work on a whole Arrow batch at once: the text column's own buffers are viewed as numpy arrays, so no Python
string is made for a word or a shingle. Batches are cut into slices of about SLICE_BYTES (one longer text is one slice),
so memory follows the longest single text and not Spark's rows per batch.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1_500_000
SLICE_ROWS = 4096

U = np.uint64
#: Odd multipliers of the polynomial hashes (any odd numbers do) and of the final mixing.
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where none is set, a folder of our own on a single machine only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and forget the lineage; a lost executor's part is read again from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, U)
        grown[0] = 1
        _POWERS[int(base)] = have = np.cumprod(grown, dtype=U)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] * base ** k over i <= k < j."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(base, len(values)), out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(inverse(base), len(prefix))[starts] + (ends - starts).astype(U))


@dataclass
class Texts:
    """Some texts end to end: bytes data[bounds[i]:bounds[i + 1]] are text i."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.bounds, positions, "right") - 1


def texts_of(column: pa.Array) -> Texts:
    """A string or binary column's buffers; null counts as empty."""
    text = not pa.types.is_binary(column.type)
    column = pc.fill_null(column, "" if text else b"").cast(pa.large_string() if text else pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return Texts(raw, bounds - low)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut so that each slice has about that many bytes of text, and SLICE_ROWS rows at most, with the texts as arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        step = (before // most)[1:] != (before // most)[:-1]
        step |= np.arange(1, len(sizes)) % SLICE_ROWS == 0
        edges = [0, *(np.flatnonzero(step) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            yield part, texts_of(part.column(text))


@dataclass
class Words:
    """Words [^\\x20\\x09-\\x0D]+ of Texts: byte spans, and for text i the words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @cached_property
    def prefix(self) -> np.ndarray:
        return prefix_sums(self.data, BYTE_BASE)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return spans_hash(self.prefix, BYTE_BASE, self.starts, self.ends)


def words_of(texts: Texts, lower: bool = False) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    edges = texts.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word never runs on into the next text
    begin[edges] |= solid[edges]
    end[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds), data)


def windows_hash(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of n consecutive words of one text."""
    firsts = run_starts(words.first, n)
    prefix = prefix_sums(hashes, WORD_BASE)
    return firsts, spans_hash(prefix, WORD_BASE, firsts, firsts + n)


def run_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive elements of one group begin."""
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    return ranges(bounds[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(total) - np.repeat(before - starts, counts)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each full window of that width: of each block's running minima from both ends, two meet."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def lines_of(words: Words, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the \\n-split lines, and where each text's lines begin; an empty text has one empty line."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    starts = np.concatenate([texts.bounds[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(texts)), texts.of(breaks)])
    ends = np.concatenate([texts.bounds[1:], breaks])
    end_owner = owner.copy()
    starts, ends = starts[np.lexsort((starts, owner))], ends[np.lexsort((ends, end_owner))]
    return starts, ends, np.searchsorted(np.sort(owner), np.arange(len(texts) + 1))


def seen_before(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items in order, with their text: which equal an earlier one, and which a later one, of the same text."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if not len(text) or text.max() < 1 << 16 else np.int64), kind="stable")]
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    earlier, later = np.zeros(len(text), bool), np.zeros(len(text), bool)
    earlier[order[1:]], later[order[:-1]] = same, same
    return earlier, later


class Scratch:
    """Tables written in the shared folder for the length of one operator's run, compressed, and dropped at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{ensure_checkpoint_dir(spark)}/siltstone-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def __exit__(self, *_: object) -> None:
        remove_folder(self.spark, self.base)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file system, so that any shared store will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Non-empty slices of batches, of about that many bytes on average."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Batches of a partition sorted by the keys, put together so that no group is split; at least that many bytes if there are."""
    held, size = [], 0
    for batch in small(batches, least):
        if size >= least:
            now = [np.asarray(batch.column(k)) for k in keys]
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            other = np.logical_or.reduce([n != x for n, x in zip(now, last)])
            at = int(other.argmax()) if other.any() else batch.num_rows
            held.append(batch.slice(0, at))
            if at == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(at)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)
