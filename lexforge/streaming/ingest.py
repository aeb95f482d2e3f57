"""Incremental ingest: new files of items pass the gate once and are appended; a run handles what is there and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.records import first_error

SCHEMA = "item_id long, source_url string, text_hash string, text string"


def gate(items: DataFrame) -> DataFrame:
    """items with outcome: the first check that fails, else ACCEPTED."""
    reason = first_error([(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "REJECTED: not https"), (F.char_length(F.trim(F.coalesce("text", F.lit("")))) < 50, "NEEDS_OCR: no text")])
    return items.withColumn("outcome", F.coalesce(reason, F.lit("ACCEPTED")))


def run(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """availableNow stands for a scheduled job; the checkpoint keeps an item from being handled twice."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = gate(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
