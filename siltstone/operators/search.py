"""Keyword search, result projections and pagination over stored pages. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import like
from siltstone.operators.stats import counted


def matching(pages: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """Pages whose title or content contains the query, ASCII case ignored; an empty query matches any non-null text."""
    return pages.where(like(F.col("title"), query, literal) | like(F.col("content"), query, literal))


def search(pages: DataFrame, query: str, limit: int = 10, literal: bool = False) -> DataFrame:
    """The first hits by id, with 500 characters of content; with a negative limit all of them, in no order."""
    hits = matching(pages, query, literal)
    hits = hits.orderBy("id").limit(limit) if limit >= 0 else hits
    return hits.select("id", "url", "title", F.substring("content", 1, 500).alias("content"), F.col("content_hash").alias("hash"))


def memory_search(pages: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The first pages by id whose title or content contains the query literally, case ignored as Unicode has it."""
    hit = lambda c: F.contains(F.lower(c), F.lower(F.lit(query)))
    return page_row(pages.where(hit("title") | hit("content")).orderBy("id").limit(limit))


def log_entry(hits: DataFrame, query: str) -> DataFrame:
    """The search-log row of a search: a sink's input, never a side effect of the search."""
    return hits.agg(F.count("*").cast("int").alias("results_count")).select(F.lit(query).alias("query"), "results_count", F.current_timestamp().alias("timestamp"))


def logged(hits: DataFrame, query: str, path: str, log: str) -> DataFrame:
    """Writes the hits to `path` and appends their number to the search log, counted while they are written; returns the log's new row."""
    seen, observation = counted(hits)
    seen.write.mode("overwrite").parquet(path)
    entry = hits.sparkSession.createDataFrame([(query, observation.get["n"])], "query string, results_count int").withColumn("timestamp", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(log)
    return entry


def paginated(pages: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    return pages.orderBy("id").offset(skip).limit(limit)


def page_row(pages: DataFrame) -> DataFrame:
    return pages.select("id", "url", "title", "content", F.col("content_hash").alias("hash"))


def page_detail(pages: DataFrame) -> DataFrame:
    """With ISO crawl time, its fraction left out when zero, and the embedded flag."""
    iso = F.when(F.date_format("crawl_time", "SSSSSS") == "000000", F.date_format("crawl_time", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("crawl_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return pages.select("id", "url", "title", "content", F.col("content_hash").alias("hash"), iso.alias("crawl_time"), "embedded")


def web_snippet(pages: DataFrame) -> DataFrame:
    short = F.when(F.length("content") > 200, F.concat(F.left("content", F.lit(200)), F.lit("..."))).otherwise(F.col("content"))
    return pages.select("id", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("No title")).alias("title"), short.alias("snippet"))


def bot_snippet(pages: DataFrame, top: int = 5) -> DataFrame:
    """The first hits, ranked from 1; the window is over what the limit left."""
    short = F.when(F.length("content") > 100, F.concat(F.left("content", F.lit(100)), F.lit("..."))).otherwise(F.col("content"))
    rows = pages.orderBy("id").limit(top)
    return rows.select(F.row_number().over(Window.orderBy("id")).cast("long").alias("rank"), F.substring("title", 1, 50).alias("title"), F.substring("url", 1, 50).alias("url"), short.alias("snippet"))


def terminal_row(pages: DataFrame) -> DataFrame:
    return pages.select("id", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("NULL")).alias("title"), F.substring("content_hash", 1, 8).alias("hash8"), F.substring("content_hash", 1, 12).alias("hash12"))
