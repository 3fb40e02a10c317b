"""A stored page table that batches are merged into, with a key index and Bloom filters in front of it.

A batch is what arrives together: a DataFrame, or a micro-batch of a stream (`saving`). Pages whose url or content hash the
store has are refused, the others are decided among themselves as a one-by-one writer would (`dedup.ingest`), so batches give
what one pass over all of them gives, as long as later batches have later ids. Every page gets the id under which its content
is stored: its own, that of the page stored before with the same hash, or 0 where only the url was taken.

Layout under the store's path; all but the first two are partitioned by batch, so a batch that is written again replaces itself:

- `shape`: the filters' shape, fixed when the store is made;
- `pages/batch=`, `keys/batch=/bucket=`: accepted pages, and their urls and hashes dealt to buckets, with the ids;
- `filters/batch=`: one Bloom filter a bucket, over all batches up to this one (those of the batch before, joined by OR);
- `decisions/batch=`: written last. A batch is in the store if these are complete; a batch that comes again is answered from them.

A filter says which of the batch's keys may be stored. Only buckets with such keys are read (partition pruning), and only such keys
are joined. A filter's false positives cost work, never results. Keys are distinct before they travel, and pieces of a bucket
have about PIECE_KEYS keys, so no task gathers more. Batches are merged one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators import dedup
from siltstone.operators.state import cut

BUCKETS, FILTER_BITS, HASHES = 64, 1 << 17, 7
PIECE_KEYS = 500_000
KEYS = "kind string, key string, id long"
DECISION = "id long, url string, content_hash string, stored boolean, page_id long"


def filter_places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each key, by double hashing; bits is a power of two."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((a.view(np.uint64)[:, None] + steps * (b.view(np.uint64)[:, None] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(places: np.ndarray, bits: int) -> np.ndarray:
    held = np.zeros(bits, bool)
    held[places.ravel()] = True
    return np.packbits(held)


def maybe_in(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.unpackbits(held).astype(bool)[places].all(1)


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds two hashes and the bucket; a url and a hash that read alike are different keys."""
    named = F.concat_ws(":", "kind", "key")
    return keys.withColumns({"a": F.xxhash64(named), "b": F.xxhash64(F.lit(7), named)}).withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), named), F.lit(buckets)).cast("int"))


def _keys_of(pages: DataFrame) -> DataFrame:
    """KEYS of pages (id, url, content_hash): a null hash is no key."""
    own = pages.select("id", F.explode(F.array(F.struct(F.lit("url").alias("kind"), F.col("url").alias("key")), F.struct(F.lit("hash").alias("kind"), F.col("content_hash").alias("key")))).alias("own"))
    return own.select("own.kind", "own.key", "id").where("key is not null")


@dataclass(frozen=True)
class PageStore:
    """buckets and filter_bits (a power of two) count when the store is made and are read from it later."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    filter_bits: int = FILTER_BITS

    # ---- reading

    def _files(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Batches that are in the store: whose decisions are complete."""
        fs, files = self._files()
        top = fs.Path(f"{self.path}/decisions")
        if not files.exists(top):
            return []
        names = [x.getPath().getName() for x in files.listStatus(top)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and files.exists(fs.Path(f"{self.path}/decisions/{n}/_SUCCESS")))

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        """The table's batches; a new, empty one without any."""
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        parts = [f"{self.path}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{name}").parquet(*parts)

    def shape(self) -> tuple[int, int]:
        fs, files = self._files()
        if not files.exists(fs.Path(f"{self.path}/shape/_SUCCESS")):
            self.spark.createDataFrame([(self.buckets, self.filter_bits)], "buckets int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/shape")
        return tuple(self.spark.read.parquet(f"{self.path}/shape").first())

    def pages(self) -> DataFrame:
        """All stored pages, with the columns that the batches had."""
        done = self.committed()
        if not done:
            raise ValueError("nothing is stored yet")
        return self.spark.read.option("basePath", f"{self.path}/pages").option("mergeSchema", "true").parquet(*(f"{self.path}/pages/batch={b}" for b in done)).drop("batch")

    def decisions(self, batch: int) -> DataFrame:
        return self._read("decisions", DECISION, [batch]).drop("batch")

    # ---- merging

    def known(self, keys: DataFrame) -> DataFrame:
        """Of KEYS rows, the distinct (kind, key) that the store has, with the id that they are stored under."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], KEYS)
        buckets, bits = self.shape()
        asked = cut(_hashed(keys.select("kind", "key").distinct(), buckets))
        pieces = max(1, -(-asked.count() // (buckets * PIECE_KEYS)))
        filters = self._read("filters", "bucket int, bits binary", done[-1:]).select("bucket", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), "bits")

        def test(own: pa.Table, held: pa.Table) -> pa.Table:
            if not held.num_rows or not own.num_rows:
                return own.slice(0, 0).select(["kind", "key", "bucket"])
            places = filter_places(*(np.asarray(own.column(c), np.int64) for c in ("a", "b")), bits)
            return own.select(["kind", "key", "bucket"]).filter(pa.array(maybe_in(np.frombuffer(held.column("bits")[0].as_py(), np.uint8), places)))

        dealt = asked.withColumn("piece", F.pmod("a", F.lit(pieces)).cast("int"))
        maybe = cut(dealt.groupBy("bucket", "piece").cogroup(filters.groupBy("bucket", "piece")).applyInArrow(test, "kind string, key string, bucket int"))
        wanted = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most `buckets`
        index = self._read("keys", f"{KEYS}, bucket int", done).where(F.col("bucket").isin(wanted))
        return index.join(maybe, ["bucket", "kind", "key"]).select("kind", "key", "id")

    def _decide(self, pages: DataFrame) -> DataFrame:
        """DECISION rows of a batch."""
        own = cut(pages.select(F.col("id").cast("long"), "url", "content_hash"))
        known = cut(self.known(_keys_of(own)))
        urls = known.where("kind = 'url'").select(F.col("key").alias("url"))
        hashes = known.where("kind = 'hash'").select(F.col("key").alias("content_hash"), F.col("id").alias("_before"))
        fresh = own.join(urls, "url", "left_anti").join(hashes, "content_hash", "left_anti")
        accepted = cut(dedup.ingest(fresh).select("id", "url", "content_hash").distinct())
        # what has a hash now: one page each, stored before or accepted in this batch
        holders = hashes.unionByName(accepted.where("content_hash is not null").select("content_hash", F.col("id").alias("_before"))).where("content_hash <> ''")
        mine = accepted.withColumn("stored", F.lit(True))
        found = own.join(mine, on=[own["id"].eqNullSafe(mine["id"]), own["url"] == mine["url"], own["content_hash"].eqNullSafe(mine["content_hash"])], how="left")
        found = found.select(own["id"], own["url"], own["content_hash"], F.coalesce("stored", F.lit(False)).alias("stored")).join(holders, "content_hash", "left")
        before = F.when(F.col("_before") < F.col("id"), F.col("_before"))
        return found.select("id", "url", "content_hash", "stored", F.when(F.col("stored"), F.col("id")).otherwise(F.coalesce(before, F.lit(0))).alias("page_id"))

    def merge(self, pages: DataFrame, batch: int) -> DataFrame:
        """Stores what of pages (id, url, content_hash, ...) is new; returns DECISION rows, one a page. The same batch again changes nothing.

        Ids are unique and later than all stored ones, urls of pages without one are refused. An interrupted merge leaves no
        trace in what is read, and is made good when the batch comes again.
        """
        done = self.committed()
        if batch in done:
            return self.decisions(batch)
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        buckets, bits = self.shape()
        decided = cut(self._decide(pages))
        accepted = decided.where("stored").select("id", "url", "content_hash")
        pages.join(accepted.select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/pages/batch={batch}")
        keys = _hashed(_keys_of(accepted), buckets)
        (keys.select("kind", "key", "id", "bucket").repartition("bucket", "key").sortWithinPartitions("bucket", "key")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch={batch}"))
        self._filters(keys, done[-1:], bits).write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")
        decided.write.mode("overwrite").parquet(f"{self.path}/decisions/batch={batch}")
        return self.decisions(batch)

    def _filters(self, keys: DataFrame, before: list[int], bits: int) -> DataFrame:
        """Each bucket's filter: those of all tasks (each holds `buckets` of them) and of the batch before, joined by OR."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                bucket = np.asarray(batch.column("bucket"), np.int64)
                places = filter_places(*(np.asarray(batch.column(c), np.int64) for c in ("a", "b")), bits)
                for k in np.unique(bucket).tolist():
                    held[k] = filter_of(places[bucket == k], bits) | held.get(k, np.uint8(0))
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["bucket", "bits"])

        def joined(table: pa.Table) -> pa.Table:
            held = np.zeros(bits // 8, np.uint8)
            for x in table.column("bits"):
                held |= np.frombuffer(x.as_py(), np.uint8)
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([held.tobytes()], pa.binary())})

        schema = "bucket int, bits binary"
        new = keys.select("bucket", "a", "b").mapInArrow(part, schema)
        old = self._read("filters", schema, before).drop("batch")
        return new.unionByName(old).groupBy("bucket").applyInArrow(joined, schema)


def saving(pages: DataFrame, store: PageStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of pages (id, url, content_hash, ...) into the store, each micro-batch merged once whatever is retried."""
    return pages.writeStream.foreachBatch(lambda df, batch: store.merge(df, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
