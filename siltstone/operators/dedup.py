"""Exact dedup and first-writer-wins ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.state import cut


def first_by_hash(pages: DataFrame, seq: str = "id") -> DataFrame:
    """The first page of each content hash; pages with an empty or null hash all stay, and so do rows that repeat (hash, seq).

    The minimum is combined on the map side, so a hash with very many copies is no hot partition.
    """
    keyed = F.coalesce("content_hash", F.lit("")) != ""
    first = pages.where(keyed).groupBy("content_hash").agg(F.min(seq).alias(seq))
    return pages.where(keyed).join(first, ["content_hash", seq], "left_semi").select(pages.columns).unionByName(pages.where(~keyed))


def is_duplicate(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """candidates with `duplicate`: whether a stored page has their hash."""
    have = stored.select("content_hash").where("content_hash is not null").distinct().withColumn("_have", F.lit(True))
    return candidates.join(have, "content_hash", "left").withColumn("duplicate", F.coalesce("_have", F.lit(False))).drop("_have")


def ingest(pages: DataFrame, seq: str = "id") -> DataFrame:
    """Rows that a writer accepting them one by one in `seq` order would store: url unique, and content_hash unique.

    A row is accepted if neither its url nor its hash was *accepted* before; so a row whose rival was itself refused gets in.
    Each round accepts what is the first undecided row of both its groups and refuses what shares a group with it. A null
    hash is nobody's rival, an empty one is like any other; rows with a null url are refused. Rows of one seq go by hash
    within a url and by url within a hash; rows equal in all three are one row, and all stay or none. Rounds are few: a chain
    of refusals is what makes another one necessary. Lineage is cut before the first round and in each: pages are evaluated twice.
    """
    same = [seq, "url", "content_hash"]
    left = cut(pages.where("url is not null").select(same))
    accepted = None
    while True:
        by_url, by_hash = (left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct(seq, other)).alias(f"_{k}")) for k, other in (("url", "content_hash"), ("content_hash", "url")))
        ranked = left.join(by_url, "url").join(by_hash, "content_hash", "left")
        now = cut(ranked.where(F.struct(seq, "content_hash").eqNullSafe(F.col("_url")) & (F.col("_content_hash").isNull() | (F.struct(seq, "url") == F.col("_content_hash")))).select(same).distinct())
        accepted = now if accepted is None else accepted.unionByName(now)
        left = cut(left.join(now.select("url").distinct(), "url", "left_anti").join(now.select("content_hash").where("content_hash is not null").distinct(), "content_hash", "left_anti").select(same))
        if left.isEmpty():
            own = accepted.select(*(F.col(c).alias(f"_{c}") for c in same))
            return pages.join(own, (F.col(seq) == F.col(f"_{seq}")) & (F.col("url") == F.col("_url")) & F.col("content_hash").eqNullSafe(F.col("_content_hash")), "left_semi")


def first_writer_sql(rows: str) -> str:
    """SQL for the ids that `ingest` accepts of rows (id, url, content_hash, non-null ids), one after the other."""
    return f"""with recursive d as materialized (select id, dense_rank() over (order by url) as u, case when content_hash is not null then dense_rank() over (order by content_hash) end as h,
            row_number() over (order by id) as k from ({rows}) where url is not null),
        s as (select 0::bigint as k, []::bigint[] as us, []::bigint[] as hs, []::bigint[] as ids
            union all
            select n.k, case when n.ok then list_append(us, n.u) else us end, case when n.ok and n.h is not null then list_append(hs, n.h) else hs end, case when n.ok then list_append(ids, n.id) else ids end
            from (select s.*, d.k as dk, d.u, d.h, d.id, not list_contains(us, d.u) and (d.h is null or not list_contains(hs, d.h)) as ok from s join d on d.k = s.k + 1) as n(_k, us, hs, ids, k, u, h, id, ok))
        select unnest(ids) as id from (select ids from s order by k desc limit 1)"""


def enqueue(urls: DataFrame, queue: DataFrame, seq: str = "seq") -> DataFrame:
    """URLs to append: the first of each, if the queue has it in no status."""
    first = urls.groupBy("url").agg(F.min(seq).alias(seq))
    return first.join(queue.select("url"), "url", "left_anti").select(seq, "url", F.lit("queued").alias("status"))


def domain_limit(pages: DataFrame, host: str, order: list[str], most: int) -> DataFrame:
    """At most that many rows of each host, by the order given."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(host).orderBy(*order))).where(F.col("_n") <= most).drop("_n")

