"""Counts of what a stream handles, taken while it runs: observed metrics of each micro-batch, appended to a table by a listener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

METRICS = "query string, batch long, metric string, value long, at timestamp"


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """df with aggregates (of whole numbers) that each micro-batch reports under the name; without any, the number of rows."""
    own = metrics or {"rows": F.count(F.lit(1))}
    return df.observe(name, *(c.cast("long").alias(k) for k, c in own.items()))


class MetricSink(StreamingQueryListener):
    """Appends METRICS rows to a Parquet table; add with spark.streams.addListener. A batch that is run again is reported again: the last row counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        own = event.progress
        rows = [(name, own.batchId, metric, value) for name, row in (own.observedMetrics or {}).items() for metric, value in row.asDict().items()]
        if rows:
            entry = self.spark.createDataFrame(rows, "query string, batch long, metric string, value long").withColumn("at", F.lit(own.timestamp).cast("timestamp"))
            entry.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
