"""Work lists: what has no counterpart yet. Anti-joins, written as such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages_needing_chunking(pages: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages with content and without any chunk, by id."""
    out = pages.where("content is not null and content <> ''").join(chunks.select(F.col("page_id").alias("id")), "id", "left_anti")
    return out if limit is None else out.orderBy("id").limit(limit)


def pages_without_embeddings(pages: DataFrame, chunks: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages not marked embedded that have no chunk at all or one without an embedding; each once."""
    missing = chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti").select(F.col("page_id").alias("id"))
    todo = pages.where("not embedded")
    out = todo.join(missing, "id", "left_semi").unionByName(todo.join(chunks.select(F.col("page_id").alias("id")), "id", "left_anti"))
    return out if limit is None else out.orderBy("id").limit(limit)


def chunks_without_embeddings(chunks: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks with text and without an embedding, by id."""
    out = chunks.where("chunk_text is not null and chunk_text <> ''").join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return out if limit is None else out.orderBy("id").limit(limit)


def exists(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked (id) with `found`: whether there is a chunk with that id."""
    have = chunks.select("id").where("id is not null").distinct().withColumn("_have", F.lit(True))
    return asked.join(have, "id", "left").withColumn("found", F.coalesce("_have", F.lit(False))).drop("_have")


def mark_embedded(pages: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pages with `embedded` derived: it has chunks, and each has an embedding."""
    missing = chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti").select(F.col("page_id").alias("id")).distinct()
    have = chunks.select(F.col("page_id").alias("id")).distinct().join(missing, "id", "left_anti").withColumn("_all", F.lit(True))
    return pages.drop("embedded").join(have, "id", "left").withColumn("embedded", F.coalesce("_all", F.lit(False))).drop("_all")


def latest_embedding(embeddings: DataFrame) -> DataFrame:
    """One embedding a chunk: the latest, by id where times are equal."""
    return embeddings.groupBy("chunk_id").agg(F.max_by(F.struct("id", "vector"), F.struct("created_at", "id")).alias("e")).select("chunk_id", "e.id", "e.vector")


def delete_pages(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """pages without those whose id is in deleted."""
    return pages.join(deleted.select("id"), "id", "left_anti")
