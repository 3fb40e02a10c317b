"""The ingestion plan: raw pages, extracted text, deduplicated pages, chunks, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import chunk, dedup, extract, vector
from siltstone.operators.state import cut

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"lightweight": extract.lightweight, "minimal": extract.minimal, "worker": extract.worker, "body": extract.body_text, "direct": extract.direct}


def extracted(raw: DataFrame, extractor: str = "lightweight") -> DataFrame:
    """Stored-page rows of raw pages; those without any content are left out. Text is extracted once: what follows reads it back."""
    found = cut(EXTRACTORS[extractor](raw)).where("content <> ''")
    return found.join(raw.select("page_id", "url"), "page_id").select(F.col("page_id").alias("id"), "url", "title", "content", "content_hash", F.lit("en").alias("language"))


def stored(raw: DataFrame, extractor: str = "lightweight") -> DataFrame:
    return dedup.ingest(extracted(raw, extractor))


def chunks(pages: DataFrame, method: str = "sentences") -> DataFrame:
    return chunk.chunk_text(pages, method=method)


def vectors(chunked: DataFrame) -> DataFrame:
    return chunked.select("page_id", "chunk_index", vector.hashed_embedding(F.col("chunk_text")).alias("vector"))
