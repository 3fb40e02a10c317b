"""The incremental stages as Structured Streaming queries. Each takes a streaming DataFrame and returns one, or a writer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltstone.functions.text import WS
from siltstone.operators import chunk, extract, lease, vector


def extraction(raw: DataFrame) -> DataFrame:
    """page_id, title, content, content_hash, word_count of arriving pages: stateless, so a stream as it is."""
    return extract.lightweight(raw)


def chunking(pages: DataFrame) -> DataFrame:
    """Chunks of arriving pages; white-space-only content is left out, so that none comes round again."""
    return chunk.chunk_by_sentences(pages.where(F.col("content").rlike(f"(?!{WS})[\\s\\S]")))


def chunking_to(pages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return chunking(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def embedding(chunks: DataFrame, embedder=vector.hashing_embedder) -> DataFrame:  # noqa: ANN001
    """Arriving chunks with their vectors; chunks without text are left out."""
    return vector.embed(chunks.where("chunk_text <> ''"), embedder)


def embedding_to(chunks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return embedding(chunks).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_pages(pages: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Arriving pages without those whose hash came before within the watermark."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    rows = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    return rows.groupBy(F.window("_time", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def status_counts(queue_events: DataFrame, status: str = "status") -> DataFrame:
    """Running counts by status, for a complete-mode sink."""
    return queue_events.groupBy(status).agg(F.count("*").alias("n"))


def polite(requests: DataFrame, domain: str, time: str, delay_s: int = 2) -> DataFrame:
    """Start times of requests, delay_s apart on each domain; state: the domain's last start.

    Within a micro-batch a domain's requests are taken by arrival.
    """
    schema = f"{domain} string, arrival timestamp, start timestamp"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time)
        out = []
        for arrival in (int(x.value // 1000) for x in rows[time]):
            last = arrival if last is None else max(arrival, last + delay_s * 1_000_000)
            out.append((key[0], pd.Timestamp(arrival, unit="us"), pd.Timestamp(last, unit="us")))
        state.update((last,))
        yield pd.DataFrame(out, columns=[domain, "arrival", "start"])

    return requests.select(domain, F.col(time).cast("timestamp").alias(time)).groupBy(domain).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


class _Leases(StatefulProcessor):
    """One URL's `lease.Item`, and a timer at the end of its lease."""

    def __init__(self, rules: lease.Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "status string, retries int, due long, lease_until long, worker string")

    def _item(self) -> lease.Item:
        return lease.Item(*self.state.get()) if self.state.exists() else lease.Item()

    def _rows(self, key: tuple, changes: list[lease.Change]) -> Iterator[Row]:
        for us, status, retries, worker in changes:
            yield Row(url=key[0], us=us, status=status, retries=retries, worker=worker)

    def _keep(self, item: lease.Item, timer: int) -> None:
        """The state, and a timer only where there is a lease."""
        now = item.lease_until if item.status == "processing" else 0
        if timer and timer != now:
            self.handle.deleteTimer(-(-timer // 1000))
        if now and timer != now:
            self.handle.registerTimer(-(-now // 1000))
        if item.status:
            self.state.update(astuple(item))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        item = self._item()
        timer = item.lease_until if item.status == "processing" else 0
        changes = []
        for us, kind, worker in sorted(((r.us, r.kind, r.worker) for r in rows), key=lambda x: (x[0], x[1], x[2] or "")):
            changes += item.take(kind, worker, us, self.rules)
        self._keep(item, timer)
        yield from self._rows(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        item = self._item()
        changes = item.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000, self.rules)
        if changes:
            self.state.update(astuple(item))
        yield from self._rows(key, changes)

    def close(self) -> None:
        pass


def leases(events: DataFrame, rules: lease.Rules = lease.Rules(), delay: str = "1 hour") -> DataFrame:
    """`lease.replay` of arriving events (url, kind, worker, at): changes as they come, and leases that run out as the watermark passes.

    State by URL in RocksDB (the session's state store provider must be that one). Events later than the watermark are dropped;
    those of one URL and micro-batch are taken in the order of their time.
    """
    rows = lease.readable(events).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    changes = rows.groupBy("url").transformWithState(_Leases(rules), "url string, us long, status string, retries int, worker string", "append", "eventTime")
    return changes.select("url", F.timestamp_micros("us").alias("at"), "status", "retries", "worker")


def pages_without_chunks(pages: DataFrame, chunks: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """id, crawl_time of arriving pages with content for which no chunk arrives within that time: what has to be chunked (again).

    pages: id, content, crawl_time; chunks: page_id, created_at. A left outer join of two streams: a page is given out once the
    watermarks of both have passed its time and `within`; its state is dropped then.
    """
    own = pages.where("content is not null and content <> ''").select("id", F.col("crawl_time").cast("timestamp").alias("crawl_time")).withWatermark("crawl_time", delay)
    have = chunks.select("page_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", delay)
    met = (F.col("id") == F.col("page_id")) & (F.col("created_at") >= F.col("crawl_time")) & (F.col("created_at") <= F.col("crawl_time") + F.expr(f"interval {within}"))
    return own.join(have, met, "left_outer").where("page_id is null").select("id", "crawl_time")


def chunks_without_vectors(chunks: DataFrame, vectors: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """id, created_at of arriving chunks with text for which no vector arrives within that time.

    chunks: id, chunk_text, created_at; vectors: chunk_id, embedded_at.
    """
    own = chunks.where("chunk_text is not null and chunk_text <> ''").select(F.col("id"), F.lit("x").alias("content"), F.col("created_at").alias("crawl_time"))
    have = vectors.select(F.col("chunk_id").alias("page_id"), F.col("embedded_at").alias("created_at"))
    return pages_without_chunks(own, have, within, delay).withColumnRenamed("crawl_time", "created_at")
