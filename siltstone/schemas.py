"""Tables of the engine, and views of the driver's tables in their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

PAGES = StructType(
    [
        StructField("id", LongType()), StructField("url", StringType()), StructField("title", StringType()), StructField("content", StringType()), StructField("content_hash", StringType()),
        StructField("language", StringType()), StructField("crawl_time", TimestampType()), StructField("embedded", BooleanType()),
    ]
)
CHUNKS = StructType([StructField("id", LongType()), StructField("page_id", LongType()), StructField("chunk_text", StringType()), StructField("chunk_index", IntegerType())])
EMBEDDINGS = StructType([StructField("id", LongType()), StructField("chunk_id", LongType()), StructField("vector", ArrayType(FloatType())), StructField("created_at", TimestampType())])
CRAWL_QUEUE = StructType(
    [
        StructField("id", LongType()), StructField("url", StringType()), StructField("status", StringType()), StructField("retries", IntegerType()), StructField("priority", IntegerType()),
        StructField("scheduled_at", TimestampType()), StructField("processed_at", TimestampType()),
    ]
)
SEARCH_LOGS = StructType([StructField("id", LongType()), StructField("query", StringType()), StructField("results_count", IntegerType()), StructField("timestamp", TimestampType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(documents: DataFrame) -> DataFrame:
    """documents as stored pages: url from source and id, the first 40 characters as title."""
    return documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/page/"), F.col("doc_id").cast("string")).alias("url"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("language"),
    )


#: The same in SQL, as a common table expression `stored`.
PAGES_SQL = """stored as (select doc_id as id, 'https://' || source || '.example.org/page/' || doc_id::varchar as url, substring(text, 1, 40) as title, text as content,
    sha256(text) as content_hash, lang as language from documents)"""


def queue_of(orders: DataFrame) -> DataFrame:
    """orders as a crawl queue: status, priority, schedule, and a URL for each customer's order."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderpriority").startswith("1"), "failed").otherwise("completed")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://c"), (F.col("o_custkey") % 97).cast("string"), F.lit(".example.org/o/"), F.col("o_orderkey").cast("string")).alias("url"), status.alias("status"),
        (F.col("o_orderkey") % 4).cast("int").alias("retries"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("scheduled_at"),
    )


QUEUE_SQL = """queue as (select o_orderkey as id, 'https://c' || (o_custkey % 97)::varchar || '.example.org/o/' || o_orderkey::varchar as url,
    case o_orderstatus when 'O' then 'queued' when 'P' then 'processing' else case when starts_with(o_orderpriority, '1') then 'failed' else 'completed' end end as status,
    (o_orderkey % 4)::int as retries, substring(o_orderpriority, 1, 1)::int as priority, o_orderdate as scheduled_at from orders)"""
