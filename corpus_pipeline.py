"""The training-corpus pipeline: stages over `documents`, each reading what the one before has written.

quality drops what the classifier scores below 0.7; near_duplicates keeps one document of each group of near-duplicates
(word 5-shingles, Jaccard 0.8); decontaminate drops documents that leak a benchmark item; pii masks personal data; packing
places the rest in sequences of 2048 tokens. All but the last return the columns of documents.

Defined results: rows with null or empty text are scored and kept or dropped like any other, are linked with nothing, leak
nothing, stay as they are under masking (null stays null), and are packed as the end token alone; rows without doc_id are
never dropped as copies; rows that share a doc_id stay or go together as copies; further columns, whatever their names, pass
through all stages but the last; an empty table gives no rows; ties of texts go to the smallest doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, minhash, packing, pii, quality
from siltstone.llm.common import ensure_checkpoint_dir, remove_folder

QUALITY_AT_LEAST = 0.7
#: SQL can't express the trained stages and the packing; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), trees)
    return scored.where(F.col("score") >= QUALITY_AT_LEAST).select("_row.*")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id")
    without = docs.where("doc_id is null")
    return docs.join(kept.where("doc_id is not null").distinct(), "doc_id", "left_semi").select(docs.columns).unionAll(without)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("pii", _pii),
    ("packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage returns is written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_folder(spark, f"{base}/{before}")
        before = name
    return docs
