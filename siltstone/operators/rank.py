"""Weighted ranking. The weights are given; what the factors mean is ours: see each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ascii_lower


def keyword_share(text: Column, terms: list[str]) -> Column:
    """The share of the query's terms that the text contains."""
    return sum((F.when(ascii_lower(text).contains(t.lower()), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / len(terms)


def length_factor(text: Column) -> Column:
    return F.least(F.length(text) / F.lit(500.0), F.lit(1.0))


def basic(vector: Column, keyword: Column, length: Column, domain: Column) -> Column:
    return F.lit(0.6) * vector + F.lit(0.2) * keyword + F.lit(0.1) * length + F.lit(0.1) * domain


def extended(semantic: Column, keyword: Column, authority: Column, freshness: Column, popularity: Column) -> Column:
    return F.lit(0.4) * semantic + F.lit(0.2) * keyword + F.lit(0.15) * authority + F.lit(0.15) * freshness + F.lit(0.1) * popularity


def results(hits: DataFrame, chunks: DataFrame, pages: DataFrame, top: int = 10) -> DataFrame:
    """title, url, snippet, score of the pages that hits (chunk_id, score) belong to, each once with its best chunk.

    chunks: id, page_id, chunk_text; pages: id, title, url. Equal scores go by page and chunk id.
    """
    found = hits.join(chunks.select(F.col("id").alias("chunk_id"), "page_id", "chunk_text"), "chunk_id")
    best = found.groupBy("page_id").agg(F.max_by(F.struct("chunk_text", "score"), F.struct("score", -F.col("chunk_id"))).alias("b"))
    rows = best.select(F.col("page_id").alias("id"), "b.*").join(pages.select("id", "title", "url"), "id").orderBy(F.desc("score"), "id").limit(top)
    return rows.select("title", "url", F.substring("chunk_text", 1, 200).alias("snippet"), "score")


def host_share(pages: DataFrame, host: str) -> DataFrame:
    """Each host's pages as a share of the largest host's."""
    counts = pages.groupBy(host).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("most"))), how="cross").select(host, (F.col("n") / F.col("most")).alias("domain_score"))


def freshness(crawled: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """1 for what was crawled now, half of that for each half-life of age; 0 without a time, 1 for a later one."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(crawled.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(days.isNull(), 0.0).otherwise(F.least(F.pow(F.lit(0.5), days / F.lit(float(half_life_days))), F.lit(1.0)))


def relative(value: Column, most: Column) -> Column:
    """A value as a share of the largest; 0 without one."""
    return F.coalesce(value / F.nullif(most, F.lit(0)), F.lit(0.0))
