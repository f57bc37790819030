"""Incremental ingest: new files of a landing folder are shredded, profiled and appended once each.

The request date of an upload decides what is new or changed, so late files need no watermark; tables are recomputed
from what was appended. A batch writes under its own number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.profile import nodes
from pathloom.sources.shred import shred

LANDING = "upload_id string, requested_at date, name string, text string"


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str) -> None:
    """Reads JSON Lines files of LANDING rows that weren't read before and appends their schema nodes to target."""

    def append(batch: DataFrame, number: int) -> None:
        texts = batch.select(F.col("upload_id").alias("doc_id"), "name", "text")
        found = nodes(shred(texts)).join(batch.select(F.col("upload_id").alias("doc_id"), "requested_at"), "doc_id")
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(LANDING).json(landing)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(append).start().awaitTermination()


def unexpired(sealed: DataFrame, now: str) -> DataFrame:
    """Sealed values that may still be kept."""
    return sealed.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def arrivals_per_day(spark: SparkSession, landing: str) -> DataFrame:
    """A streaming count of uploads by request date, kept whole because late uploads must count."""
    return spark.readStream.schema(LANDING).json(landing).groupBy("requested_at").agg(F.count("*").alias("uploads"))
