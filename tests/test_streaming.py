"""Each stream, run over what is there, gives the batch result."""

import datetime as dt
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siltstone.operators import chunk, extract, lease, queue, stats, vector
from siltstone.schemas import pages_of
from siltstone.sources import landed
from siltstone.streaming import jobs, metrics


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def landing(spark, sf, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landing"))
    for t in ("pages", "events", "documents"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{base}/{t}")
    return base


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_extraction(spark, landing):
    got = run(jobs.extraction(landed.raw_page_stream(spark, f"{landing}/pages", 1)), "extracted")
    assert rows(got) == rows(extract.lightweight(spark.read.parquet(f"{landing}/pages")))


def test_chunking(spark, landing, tmp_path):
    blank = spark.createDataFrame([(10**6, " \xa0\n", "en", "s", 3)], spark.read.parquet(f"{landing}/documents").schema)
    blank.write.mode("append").parquet(f"{landing}/documents")
    q = jobs.chunking_to(pages_of(stream(spark, f"{landing}/documents")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(chunk.chunk_by_sentences(pages_of(spark.read.parquet(f"{landing}/documents"))))


def test_embedding(spark, landing, tmp_path):
    chunks = lambda df: df.select("doc_id", F.col("text").alias("chunk_text"))
    q = jobs.embedding_to(chunks(stream(spark, f"{landing}/documents")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    batch = spark.read.parquet(f"{landing}/documents")
    want = batch.where("text <> ''").select("doc_id", "text", vector.hashed_embedding(F.col("text")).cast("array<float>"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want)


def test_counts(spark, landing):
    events = spark.read.parquet(f"{landing}/events")
    got = run(jobs.windowed_counts(stream(spark, f"{landing}/events"), "ts", "event_type", delay="60 days"), "windows", "complete")
    assert rows(got.select(F.col("start").cast("timestamp_ntz"), "event_type", "n")) == rows(stats.trend(events, "ts", "event_type"))
    got = run(jobs.status_counts(stream(spark, f"{landing}/events"), "event_type"), "statuses", "complete")
    assert rows(got) == rows(events.groupBy("event_type").count())


def test_first_pages(spark, landing):
    pages = stream(spark, f"{landing}/documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    got = run(jobs.first_pages(pages, "at"), "firsts")
    assert got.count() == spark.read.parquet(f"{landing}/documents").select("text").distinct().count()


def test_polite(spark, sf, tmp_path):
    base = str(tmp_path / "requests")
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 20").select(F.col("user_id").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    events.coalesce(1).write.parquet(base)
    got = run(jobs.polite(stream(spark, base), "host", "ts", 86_400), "polite")
    want = queue.schedule(events, "host", "ts", "event_id", 86_400).select("host", (F.unix_micros("ts") + F.col("wait_us")).alias("start"))
    assert rows(got.select("host", F.unix_micros("start"))) == rows(want)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


EVENT = "url string, kind string, worker string, at timestamp"
RULES = lease.Rules(30 * 60_000_000, 10 * 60_000_000, 2)


def lease_events():
    """u1: a worker that never finishes, three times over; u2: done in time; u3: done too late, then again; u4: fails at once; u5: others ask."""
    rows = [("u1", "add", None, 0)] + [("u1", "claim", "lazy", t) for t in (1, 20, 35, 45, 100, 105, 300)]
    rows += [("u2", "add", None, 2), ("u2", "claim", "a", 3), ("u2", "add", None, 4), ("u2", "done", "a", 32), ("u2", "claim", "a", 40)]
    rows += [("u3", "claim", "a", 1), ("u3", "add", None, 5), ("u3", "claim", "a", 5), ("u3", "done", "a", 35), ("u3", "claim", "b", 60), ("u3", "done", "a", 61), ("u3", "done", "b", 62)]
    rows += [("u4", "add", None, 0)] + [x for t in (1, 12, 50) for x in (("u4", "claim", "c", t), ("u4", "fail", "c", t + 1))]
    rows += [("u5", "add", None, 0), ("u5", "claim", "a", 2), ("u5", "fail", "b", 3), ("u5", "done", None, 3), (None, "add", None, 1), ("u6", "none", "a", 3), ("u6", None, "a", 3)]
    return sorted(rows, key=lambda r: r[3])


def test_leases_equal_a_replay(spark, tmp_path, rocks):
    events = lease_events() + [("far", "add", None, 10_000)]
    for k in range(0, len(events), 4):
        spark.createDataFrame([(*r[:3], at(r[3])) for r in events[k : k + 4]], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = jobs.leases(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), RULES, "1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        if k % 8 or k + 4 >= len(events):  # several files at times, and each start goes on where the last one stopped
            q.trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    want = rows(lease.replay(spark.createDataFrame([(*r[:3], at(r[3])) for r in events], EVENT).repartition(3), RULES))
    assert got == want
    ends = {}
    for r in sorted(got, key=lambda r: r[1]):
        ends[r[0]] = r[2:]
    assert ends == {"u1": ("dead", 3, "lazy"), "u2": ("completed", 0, "a"), "u3": ("completed", 1, "b"), "u4": ("dead", 3, "c"), "u5": ("queued", 1, "a"), "far": ("queued", 0, None)}
    assert [(r[1].minute + 60 * r[1].hour, r[2]) for r in got if r[0] == "u1"] == [(0, "queued"), (1, "processing"), (31, "queued"), (45, "processing"), (75, "queued"), (100, "processing"), (130, "dead")]


def test_late_and_missing_chunks(spark, tmp_path):
    """Page 1 has a chunk in time, 2 none, 3 one that comes too late, 4 one of an older time, 5 no content, 6 two; 99 moves the time on."""
    pages = [(1, "x", 0), (2, "x", 1), (3, "x", 2), (4, "x", 5), (5, "", 5), (6, "x", 6), (7, None, 6), (99, "x", 5000), (100, "x", 9000)]
    chunks = [(1, 50), (3, 90), (4, 1), (6, 7), (6, 8), (99, 5001), (100, 9001)]
    spark.createDataFrame([(i, c, at(t)) for i, c, t in pages], "id long, content string, crawl_time timestamp").repartitionByRange(3, "crawl_time").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([(i, at(t)) for i, t in chunks], "page_id long, created_at timestamp").repartitionByRange(3, "created_at").write.parquet(f"{tmp_path}/chunks")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    found = jobs.pages_without_chunks(read("pages", "id long, content string, crawl_time timestamp"), read("chunks", "page_id long, created_at timestamp"))
    assert sorted(r.id for r in run(found, "waiting").collect()) == [2, 3, 4]
    own = read("pages", "id long, content string, crawl_time timestamp").select("id", F.col("content").alias("chunk_text"), F.col("crawl_time").alias("created_at"))
    have = read("chunks", "page_id long, created_at timestamp").select(F.col("page_id").alias("chunk_id"), F.col("created_at").alias("embedded_at"))
    assert sorted(r.id for r in run(jobs.chunks_without_vectors(own, have), "waiting_chunks").collect()) == [2, 3, 4]


def test_metrics_of_a_stream(spark, landing, tmp_path):
    sink = metrics.MetricSink(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(sink)
    try:
        found = metrics.observed(stream(spark, f"{landing}/events"), "events", rows=F.count(F.lit(1)), errors=F.count_if(F.col("event_type") == "error"))
        run(found.groupBy("event_type").count(), "observed", "complete")
        want = spark.read.parquet(f"{landing}/events")
        for _ in range(100):  # the listener is told after the batch
            try:
                got = {r.metric: (r.n, r.batches) for r in spark.read.parquet(str(tmp_path / "metrics")).groupBy("metric").agg(F.sum("value").alias("n"), F.count_distinct("batch").alias("batches")).collect()}
            except AnalysisException:
                got = {}
            if got.get("rows", (0,))[0] == want.count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(sink)
    assert got == {"rows": (want.count(), 3), "errors": (want.where("event_type = 'error'").count(), 3)}
