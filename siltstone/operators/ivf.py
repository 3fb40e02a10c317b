"""Approximate vector search over a stored index: inverted lists as partitions, product quantisation, exact re-ranking.

Centres of cells and code books are fitted on a bounded sample (FIT_ROWS vectors by a hash of their id), all vectors are indexed.
A vector is a member of its COPIES nearest cells, so that neighbours that lie in different cells still share one, and stands
in their lists as a code: one byte for each of PARTS pieces of its unit vector, the nearest entry of the piece's code book. A query
asks its `probes` nearest cells. A score by codes is the sum of the entries' products with the query's pieces (a distance
table's entries; for the many queries of a cell the sums are one matrix product with the decoded vectors). Each cell's best PER_CELL
are pooled, and the best SHORTLIST of the pool are scored exactly, with their own vectors.

Layout under the index's path: `lists/cell=` (vec_id, code), `vectors` (vec_id, embedding), `model` (centres, code books). Searches read
only the lists of cells that are asked. Recall is below 1; tests ask 0.9 at a quarter of the cells. Zero and null vectors are in no
list and don't ask; all vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.vector import PAIRS, best_of, matrix_of, pairs, ranked, units

#: Cells, in how many each vector is a member, how many a query asks, and how many vectors the model is fitted on.
CELLS, COPIES, PROBES, FIT_ROWS = 64, 4, 16, 10_000
#: Pieces of a vector, entries of a code book (a byte), and the rounds of fitting.
PARTS, ENTRIES, ROUNDS = 32, 256, 10
PER_CELL, SHORTLIST = 25, 60
#: Members of a list and queries that meet in one task.
LIST_ROWS, QUERY_ROWS = 200_000, 20_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN for zero vectors."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, np.nan)


def means(rows: np.ndarray, k: int, spherical: bool) -> np.ndarray:
    """k centres by Lloyd's rounds from the first rows on; repeated where there are fewer rows."""
    middle = rows[np.arange(k) % len(rows)]
    for _ in range(ROUNDS):
        near = nearest(rows, middle, spherical)[:, 0]
        count = np.bincount(near, minlength=k)[:, None]
        total = np.stack([np.bincount(near, rows[:, i], minlength=k) for i in range(rows.shape[1])], 1)
        new = np.where(count > 0, total / np.maximum(count, 1), middle)
        middle = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-300) if spherical else new
    return middle


def nearest(rows: np.ndarray, middle: np.ndarray, spherical: bool, n: int = 1) -> np.ndarray:
    """Each row's n nearest centres, the nearest first."""
    near = rows @ middle.T
    near = near if spherical else near - (middle * middle).sum(1) / 2
    return near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]


@dataclass
class Model:
    centres: np.ndarray  # cells x dimensions
    books: np.ndarray  # pieces x entries x dimensions of a piece

    @classmethod
    def fitted(cls, vectors: DataFrame, cells: int, parts: int) -> Model | None:
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()
        rows = [r.embedding for r in chosen if any(r.embedding)]
        if not rows:
            return None
        rows = unit(np.array(rows, float))
        split = cls.split(rows, parts)
        return cls(means(rows, cells, True), np.stack([means(split[:, p], ENTRIES, False) for p in range(parts)]))

    @staticmethod
    def split(rows: np.ndarray, parts: int) -> np.ndarray:
        """Rows in pieces, the last filled up with zeros."""
        width = -(-rows.shape[1] // parts)
        return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        split = self.split(rows, len(self.books))
        return np.stack([nearest(split[:, p], book, False)[:, 0] for p, book in enumerate(self.books)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        own = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)
        return own[:, : self.centres.shape[1]]

    def table(self, query: np.ndarray) -> np.ndarray:
        """pieces x entries: what an entry adds to the score of one query."""
        return np.einsum("pew,pw->pe", self.books, self.split(query[None], len(self.books))[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors, without zero vectors, 4096 at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = pa.Table.from_batches([batch.slice(at, 4096)])
            rows = unit(matrix_of(part.column("embedding"), part.num_rows))
            good = ~np.isnan(rows[:, 0])
            yield np.asarray(part.column("vec_id"))[good], rows[good]


def build(vectors: DataFrame, path: str, cells: int = CELLS, copies: int = COPIES, parts: int = PARTS) -> None:
    """Writes the index of vectors (vec_id, embedding)."""
    own = units(vectors)
    model = Model.fitted(own, cells, parts)
    saved = [(model.centres.tobytes(), model.books.tobytes(), *model.books.shape, model.centres.shape[1])] if model else []
    spark = vectors.sparkSession
    spark.createDataFrame(saved, "centres binary, books binary, parts int, entries int, width int, size int").coalesce(1).write.parquet(f"{path}/model")
    if not model:
        return

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _slices(batches):
            cell = nearest(rows, model.centres, True, copies)
            codes = [x.tobytes() for x in model.codes(rows)]
            again = np.repeat(np.arange(len(ids)), cell.shape[1])
            yield pa.record_batch({"cell": pa.array(cell.ravel(), pa.int32()), "vec_id": pa.array(ids[again]), "code": pa.array([codes[k] for k in again], pa.binary())})

    lists = own.mapInArrow(assign, "cell int, vec_id long, code binary")
    lists.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/lists")
    own.write.option("compression", "zstd").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = PROBES, per_cell: int = PER_CELL, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, vec_id, score: about the k nearest other vectors of each query (vec_id, embedding)."""
    saved = spark.read.parquet(f"{path}/model").first()
    own = units(queries)
    if saved is None:
        return own.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).where("false")
    model = Model(np.frombuffer(saved.centres).reshape(-1, saved.size), np.frombuffer(saved.books).reshape(saved.parts, saved.entries, saved.width))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _slices(batches):
            cell = nearest(rows, model.centres, True, probes)
            again = np.repeat(np.arange(len(ids)), cell.shape[1])
            yield pa.record_batch({"cell": pa.array(cell.ravel(), pa.int32()), "vec_id": pa.array(ids[again]), "embedding": pa.array(list(rows[again].astype(np.float32)), pa.list_(pa.float32()))})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pairs(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1)))
        ids, others = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
        asked = matrix_of(left.column("embedding"), len(ids)).astype(np.float32)
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(others), -1)
        out = []
        for a in range(0, len(ids), 256):
            q = slice(a, a + 256)
            best = np.full((len(ids[q]), 0), -np.inf, np.float32), np.zeros((len(ids[q]), 0), np.int64)
            for b in range(0, len(others), 8192):
                v = slice(b, b + 8192)
                now = asked[q] @ model.decoded(codes[v]).astype(np.float32).T
                now[ids[q][:, None] == others[v][None, :]] = -np.inf
                best = best_of(np.concatenate([best[0], now], 1), np.concatenate([best[1], np.broadcast_to(others[v], now.shape)], 1), per_cell)
            out.append(pairs(ids[q], best[1], best[0].astype(np.float64)))
        return pa.concat_tables(out)

    asked = own.mapInArrow(ask, "cell int, vec_id long, embedding array<float>")
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())  # at most as many as there are cells
    lists = spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/lists").where(F.col("cell").isin(cells))
    longest, most = (x or 0 for x in (lists.groupBy("cell").count().agg(F.max("count")).first()[0], own.count()))
    pieces, blocks = max(1, -(-longest // LIST_ROWS)), max(1, -(-most // QUERY_ROWS))
    by = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", by("vec_id", blocks)).withColumn("piece", each(pieces))
    right = lists.withColumn("piece", by("vec_id", pieces)).withColumn("block", each(blocks))
    keys = ["cell", "piece", "block"]
    pool = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, PAIRS)
    near = ranked(pool.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), shortlist).select("query_id", "vec_id")

    vectors = units(spark.read.parquet(f"{path}/vectors"))
    both = near.join(vectors, "vec_id").join(own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_asked")), "query_id")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if part.num_rows:
                a, b = (unit(matrix_of(part.column(c), part.num_rows)) for c in ("embedding", "_asked"))
                yield pa.record_batch({"query_id": batch.column("query_id"), "vec_id": batch.column("vec_id"), "score": pa.array(np.round((a * b).sum(1), 6))})

    return ranked(both.select("query_id", "vec_id", "embedding", "_asked").mapInArrow(again, PAIRS), k)
