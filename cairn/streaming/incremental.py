"""Incremental runs: new artifacts of a stream are classified, and a table by path keeps the latest of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.dialect import add
from cairn.operators import meta

COLUMNS = ("path", "artifact_type", "confidence", "content_hash", "token_estimate", "strategy")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each path by ``order``, the greatest hash of equals."""
    w = Window.partitionBy("path").orderBy(F.desc(order), F.desc("content_hash"))
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def run(source: DataFrame, target: str, checkpoint: str, order: str = "modified_at") -> StreamingQuery:
    """Writes each micro-batch of (path, body, ``order``) under ``target``/batch=<id>; a batch that is tried again
    replaces its own folder, so that a restart changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        latest(add(batch, *meta.META_STEPS).select(*COLUMNS, order), order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, target: str, order: str = "modified_at") -> DataFrame:
    """The table as of all batches so far."""
    return latest(spark.read.parquet(target), order).drop("batch")
