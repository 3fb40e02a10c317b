"""Sources: landed pages, crawl requests and page JSON as DataFrames, batch or stream; and sinks.

Whatever fetches (siltstone.sources.fetch, or a crawler) lands (page_id, url, html) files, and these are the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.schemas import PAGES

RAW_PAGES = "page_id long, url string, html string"
PAGE_JSON = "url string, title string, content string, hash string, language string"


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_PAGES).parquet(path)


def raw_page_stream(spark: SparkSession, path: str, files_per_trigger: int = 32) -> DataFrame:
    return spark.readStream.schema(RAW_PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def crawl_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per URL of {"urls": [...]} requests, in their order."""
    rows = spark.read.schema("urls array<string>").json(path)
    return rows.select(F.posexplode("urls").alias("seq", "url"))


def page_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pages from JSON text; a missing url, title, content or hash is '', a missing language 'en'; unreadable text is dropped."""
    rows = lines.select(F.from_json(column, PAGE_JSON, {"mode": "PERMISSIVE"}).alias("p")).where("p is not null").select("p.*")
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "content")), F.coalesce("hash", F.lit("")).alias("content_hash"), F.coalesce("language", F.lit("en")).alias("language"))


def in_memory(spark: SparkSession, rows: list[dict], schema: StructType = PAGES) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Appends to a Parquet table."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
