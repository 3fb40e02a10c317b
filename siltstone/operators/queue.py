"""The crawl queue as a state table: order, claims, latest status, politeness, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.urls import depth
from siltstone.operators.state import cut


def next_item(queue: DataFrame, by_priority: bool = False) -> DataFrame:
    """The queued row scheduled first (by id where times are equal), as a worker gets it."""
    order = ["scheduled_at", "id"]
    return queue.where("status = 'queued'").orderBy(*([F.asc("priority")] if by_priority else []), *order).limit(1).select("id", "url", "status", "retries")


def next_inserted(queue: DataFrame) -> DataFrame:
    """The queued row that was put in first, whatever its schedule."""
    return queue.where("status = 'queued'").orderBy("id").limit(1).select("id", "url", "status", "retries")


def claim(queue: DataFrame, most: int) -> DataFrame:
    """The rows that a batch of workers claims, now processing."""
    return queue.where("status = 'queued'").orderBy("scheduled_at", "id").limit(most).select("id", "url", F.lit("processing").alias("status"), "retries")


def finish(queue: DataFrame, finished: DataFrame) -> DataFrame:
    """queue with the status and processed_at of `finished` (id, status, processed_at) where it has the id.

    Ids may be text; one that is no number changes nothing.
    """
    new = finished.select(F.col("id").try_cast("long").alias("id"), F.col("status").alias("_status"), F.col("processed_at").alias("_at"))
    return queue.drop("processed_at").join(new, "id", "left").withColumn("status", F.coalesce("_status", "status")).withColumnRenamed("_at", "processed_at").drop("_status")


def latest_status(events: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """The last status of each key; an aggregation, so no key is sorted."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(time, tie)).alias("status"), F.max(time).alias("at"))


def _dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `_part`, dealt by ranges of key and order: parts are of like size, and follow one another, whatever share a key has."""
    return rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id())


def _carried(local: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """local with the columns of carry (_part, _key, ...), which has one row a part at most: only a part's first key has begun before."""
    found = carry.withColumnRenamed("_part", "_of")
    return local.join(F.broadcast(found), (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_of", "_key", "_part")


def schedule(requests: DataFrame, domain: str, time: str, tie: str, delay_s: int = 2) -> DataFrame:
    """When each request may start: not before its arrival, nor within delay_s after the one before on its domain.

    Start k is delay * k + the largest of (arrival j - delay * j) over j <= k: a running maximum. It runs within parts; what
    a domain's earlier parts come to, their count and maximum, is added to the later ones.
    """
    step = delay_s * 1_000_000
    order = Window.partitionBy("_part", domain).orderBy(time, tie)
    rows = _dealt(requests, domain, [time, tie]).withColumn("_k", F.row_number().over(order) - 1).withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    local = cut(rows.withColumn("_m", F.max(F.col("_t") - step * F.col("_k")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy("_part", F.col(domain).alias("_key")).agg(F.count("*").alias("_n"), F.max("_m").alias("_most"))
    parts = parts.withColumn("_base", F.sum("_n").over(before)).withColumn("_before", F.max(F.col("_most") - step * F.coalesce("_base", F.lit(0))).over(before))
    rows = _carried(local, parts.where("_base is not null").select("_part", "_key", "_base", "_before"), domain).withColumn("_base", F.coalesce("_base", F.lit(0)))
    running = F.greatest(F.col("_m") - step * F.col("_base"), F.col("_before"))
    return rows.withColumn("wait_us", (running + step * (F.col("_k") + F.col("_base")) - F.col("_t")).cast("long")).drop("_k", "_t", "_m", "_base", "_before")


def recrawl(crawls: DataFrame, key: str, time: str, now: str, days: int) -> DataFrame:
    """Keys whose last crawl is that many days before `now` or more, with its time."""
    return crawls.groupBy(key).agg(F.max(time).alias("last")).where(F.col("last") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def within_depth(requests: DataFrame, url: str, most: int) -> DataFrame:
    """Requests whose URL has at most that many path segments."""
    return requests.where(depth(F.col(url)) <= most)


def retryable(queue: DataFrame, most: int) -> DataFrame:
    return queue.where((F.col("status") == "failed") & (F.col("retries") < most))


def dead_letters(queue: DataFrame, most: int) -> DataFrame:
    return queue.where((F.col("status") == "failed") & (F.col("retries") >= most))


def allowed(requests: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """Requests that no robots rule (host, prefix, allow) forbids: the longest matching prefix decides, allow wins ties.

    Verdicts are found for each host and path once; requests that repeat stay as often as they come.
    """
    places = requests.select(F.col(host).alias("_host"), F.col(path).alias("_path")).distinct()
    hit = places.join(rules, (F.col("_host") == F.col("host")) & F.col("_path").startswith(F.col("prefix")))
    verdict = hit.groupBy("_host", "_path").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("_allow"))
    return requests.join(verdict.where("not _allow"), (F.col(host) == F.col("_host")) & (F.col(path) == F.col("_path")), "left_anti")


def changed(crawls: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """Crawls whose value differs from the one before of their key; a part's first crawl of a key looks at the part before."""
    order = Window.partitionBy("_part", key).orderBy(time, tie)
    local = cut(_dealt(crawls, key, [time, tie]).withColumn("previous", F.lag(value).over(order)).withColumn("_k", F.row_number().over(order)))
    last = local.groupBy("_part", F.col(key).alias("_key")).agg(F.max_by(value, "_k").alias("_last"))
    carry = last.withColumn("_last", F.lag("_last").over(Window.partitionBy("_key").orderBy("_part"))).where("_last is not null")
    rows = _carried(local, carry, key).withColumn("previous", F.when(F.col("_k") == 1, F.col("_last")).otherwise(F.col("previous"))).drop("_k", "_last")
    return rows.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))
