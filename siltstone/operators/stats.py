"""Statistics: counts by status, search-log reports, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

STATUSES = ["queued", "processing", "completed", "failed"]


def stats(queue: DataFrame, pages: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: each status's count, their sum, and the tables' sizes; the queue is read once."""
    counts = queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    for name, df in (("pages", pages), ("chunks", chunks), ("embeddings", embeddings)):
        counts = counts.crossJoin(df.agg(F.count("*").alias(name)))  # single rows
    return counts.withColumn("total_queue", sum(F.col(s) for s in STATUSES))


def memory_stats(queue: DataFrame, pages: DataFrame) -> DataFrame:
    counts = queue.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") != "queued").alias("processed"))
    return counts.crossJoin(pages.agg(F.count("*").alias("pages"))).withColumn("total", F.col("queued") + F.col("processed"))


def added(new: DataFrame, queue: DataFrame) -> DataFrame:
    """One row, the answer to a crawl request: how many of its URLs are new, and how many are queued then."""
    counts = new.agg(F.count("*").alias("added")).crossJoin(queue.agg(F.count_if(F.col("status") == "queued").alias("before")))  # single rows
    return counts.select("added", (F.col("before") + F.col("added")).alias("queued"))


def popular(logs: DataFrame, top: int = 10) -> DataFrame:
    return logs.groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "query").limit(top)


def failed(logs: DataFrame) -> DataFrame:
    """Queries that found nothing, with how often."""
    return logs.groupBy("query").agg(F.count("*").alias("searches"), F.count_if(F.col("results_count") == 0).alias("empty")).where("empty > 0")


def trend(logs: DataFrame, time: str, key: str, width: str = "1 day") -> DataFrame:
    """Counts by key and tumbling window, with the window's start."""
    rows = logs.groupBy(F.window(F.col(time).cast("timestamp"), width), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "n")


def panes(logs: DataFrame, time: str, key: str, pane: str) -> DataFrame:
    """start, key, n: exact counts by pane and key, combined on the map side; to be kept, and added up."""
    rows = logs.groupBy(F.window(F.col(time).cast("timestamp"), pane), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "key", "n")


def sliding(counts: DataFrame, pane_s: int, width: int) -> DataFrame:
    """start, key, n of windows of `width` panes that begin at every pane: added up from the panes' counts, not counted again."""
    moved = counts.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.timestamp_micros(F.unix_micros("start") - k * F.lit(pane_s * 1_000_000)))))
    return moved.groupBy("start", "key").agg(F.sum("n").alias("n"))


def bursts(windows: DataFrame, earlier_s: tuple[int, int], n_earlier: int) -> DataFrame:
    """start, key, n, expected, score of each window's keys: how far n is from the mean of the earlier windows, in roots of it.

    Earlier windows are the n_earlier that begin from earlier_s[0] to earlier_s[1] seconds before; a key that one lacks counts 0 there.
    A task holds one key's windows, of which there are no more than panes in the time that is looked at.
    """
    before = Window.partitionBy("key").orderBy(F.unix_seconds("start")).rangeBetween(-earlier_s[0], -earlier_s[1])
    expected = F.coalesce(F.sum("n").over(before), F.lit(0)) / n_earlier
    return windows.withColumn("expected", expected).withColumn("score", (F.col("n") - F.col("expected")) / F.sqrt(F.col("expected") + 1))


def sessions(logs: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """key, start, end, n: runs of a key's rows with less than `gap` between neighbours; end is the last row's time and the gap."""
    rows = logs.where(F.col(key).isNotNull()).groupBy(F.session_window(F.col(time).cast("timestamp"), gap), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def counted(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """rows, and their count, which is known (`observation.get["n"]`) once an action has run over them: no second pass."""
    observation = Observation(name)
    return rows.observe(observation, F.count(F.lit(1)).alias("n")), observation
