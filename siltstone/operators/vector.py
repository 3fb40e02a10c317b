"""Vectors: JSON form, exact and approximate search, pooling, clustering, and an offline embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

#: Bytes of query vectors and of vectors that meet in one cell of the grid.
QUERY_BYTES, VECTOR_BYTES = 16 << 20, 64 << 20
EMBEDDING_SIZE = 64
#: Words whose places a task holds.
KNOWN_WORDS = 1 << 18
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def to_json(vector: Column) -> Column:
    return F.to_json(vector)


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if one of them is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Exact search for one vector; ties by vec_id."""
    own = F.col("embedding").cast("array<double>")
    scored = vectors.select("vec_id", F.round(cosine(own, F.array(*map(F.lit, map(float, query)))), 6).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that have both, embedding of its own element type; all of one length."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null and vec_id is not null")


def matrix_of(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(rows, -1)


def dealt(rows: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
    """rows dealt to `parts` parts by their id, each part once for each part of the other side: a grid of cells of a bounded size."""
    return rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best scores and their ids, ties by id. ids: like scores."""
    if scores.shape[1] > 4 * k:  # what can't be among the best goes first
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        width = int((scores >= least).sum(1).max(initial=0))
        near = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else np.broadcast_to(np.arange(width), scores.shape)
        scores, ids = np.take_along_axis(scores, near, 1), np.take_along_axis(ids, near, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def pairs(asks: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    keep = np.isfinite(scores.ravel())
    return pa.table([pa.array(np.broadcast_to(asks[:, None], scores.shape).ravel()[keep]), pa.array(ids.ravel()[keep]), pa.array(scores.ravel()[keep])], names=["query_id", "vec_id", "score"])


PAIRS = "query_id long, vec_id long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES) -> DataFrame:
    """query_id, vec_id, score: the k nearest other vectors of every query, exactly.

    Both sides stay DataFrames: queries in parts of about query_bytes meet vectors in parts of about vector_bytes in the cells of a
    grid, one matrix product a cell, of which a query's k best leave the cell; the best of all its cells are the answer. Only the
    two counts go to the driver. Vectors travel once for each part of the queries. Zero vectors neither ask nor answer.
    """
    asked, own = units(queries), units(vectors)
    n, size = asked.select(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return own.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).where("false")
    many = own.count()
    parts = max(1, -(-n * size * 8 // query_bytes))
    spread = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-many // 1000))
    cells = max(1, -(-many * size * 8 // vector_bytes), -(-spread // parts))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pairs(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1)))
        ids, others = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
        ask, have = matrix_of(left.column("embedding"), len(ids)), matrix_of(right.column("embedding"), len(others))
        norm, length = np.sqrt((ask * ask).sum(1)), np.sqrt((have * have).sum(1))
        out = []
        for a in range(0, len(ids), 512):
            q = slice(a, a + 512)
            best = np.full((len(ids[q]), 0), -np.inf), np.zeros((len(ids[q]), 0), np.int64)
            for b in range(0, len(others), 4096):
                v = slice(b, b + 4096)
                with np.errstate(divide="ignore", invalid="ignore"):
                    now = np.round((ask[q] @ have[v].T) / (norm[q][:, None] * length[v][None, :]), 6)
                now[~np.isfinite(now) | (ids[q][:, None] == others[v][None, :])] = -np.inf
                best = best_of(np.concatenate([best[0], now], 1), np.concatenate([best[1], np.broadcast_to(others[v], now.shape)], 1), k)
            out.append(pairs(ids[q], best[1], best[0]))
        return pa.concat_tables(out)

    left, right = dealt(asked, "_q", parts, "_v", cells), dealt(own, "_v", cells, "_q", parts)
    return ranked(left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(score, PAIRS), k)


def mean_by(vectors: DataFrame, group: str) -> DataFrame:
    """The mean vector of each group, rounded to 6 digits; one aggregation per dimension with map-side combining."""
    cells = vectors.select(group, F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = cells.groupBy(group, "i").agg(F.round(F.avg("x"), 6).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def clusters(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vec_id and the KMeans cluster of its vector."""
    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


class _Places(dict):
    """Of each word its dimension, and `size` more for a negative sign; by md5 once a word, held for KNOWN_WORDS of them."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.translate(_LOWER).encode()).hexdigest()
        found = int(digest[:8], 16) % self.size + (self.size if digest[8] >= "8" else 0)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found
        return found

    def matrix(self, texts: list[str]) -> np.ndarray:
        """A row a text: words with a positive sign less those with a negative one, by dimension."""
        out = np.zeros((len(texts), self.size), np.int32)
        for row, x in zip(out, texts):
            words = x.split()  # at the characters of WS
            if words:
                both = np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=2 * self.size)
                row[:] = both[: self.size] - both[self.size :]
        return out


def hashed_embedding(text: Column, size: int = EMBEDDING_SIZE) -> Column:
    """A deterministic offline embedding: signed feature hashing of lower-cased words, before normalisation; of null as of ''.

    A word's md5 gives its dimension (first 8 hex digits) and sign (ninth). In Arrow batches: as an expression, each word copies the
    whole vector.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Places(size)
        for batch in batches:
            found = [places.matrix([x or "" for x in batch.slice(at, 256).to_pylist()]) for at in range(0, len(batch), 256)]
            flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size), pa.array(flat))

    return F.arrow_udf(run, "array<int>", ArrowUDFType.SCALAR_ITER)(text)


def hashing_embedder(size: int = EMBEDDING_SIZE):  # noqa: ANN201
    """`hashed_embedding` as an embedder for `embed`."""
    places = _Places(size)
    return lambda texts: places.matrix(texts).astype(np.float32)


def embed(chunks: DataFrame, embedder, text: str = "chunk_text", size: int = EMBEDDING_SIZE) -> DataFrame:  # noqa: ANN001
    """chunks with `vector`, by a pluggable embedder: a function of a list of strings that returns a matrix, made once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                found = np.asarray(model([x or "" for x in part.column(text).to_pylist()]), np.float32)
                yield part.append_column("vector", pa.array(list(found), pa.list_(pa.float32())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, vector array<float>")
