"""Gated ingest as a stream: every file of items passes allow-list, validation and change tracker once, and lands in one of three tables.

    accepted    items that are new or changed
    rejects     items that a gate refused, with stage, outcome and reason (needs_ocr too)
    log         how many items each stage let pass, refused or knew already, with reasons and time

A batch writes its own folder of each table, named by run and batch. A batch that died between two tables is planned
again by the stream's checkpoint with the same files and number, and overwrites what it had written; the tracker never
reads a batch's own folder, so the second time gives what the first would have. Later runs, with other checkpoints, know earlier
runs by their accepted items.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash
from lexforge.operators import documents as D
from lexforge.operators import registry as G
from lexforge.sources.shared import exists

#: What items have, whatever else they carry: item_id orders items of one URL.
ITEM = "item_id long, source_url string, text string, n_bytes long, pages int, code string, head string"
ACCEPTED = f"{ITEM}, text_hash string, outcome string, run string, batch long"
LOG = "stage string, outcome string, reason string, items long, duration_ms long, ended timestamp"

#: Outcomes of each stage, with the reasons that a refusal may have.
REASONS = {
    "allowlist": [("passed", None), ("rejected", "domain not allowed")],
    "validate": [("passed", None), ("needs_ocr", "thin text"), *[("rejected", r) for r in ("not %PDF-", "placeholder", "too small", "too large", "unreadable", "no pages", "no text", "regulation not named")]],
    "tracker": [("new", None), ("changed", None), ("duplicate", None)],
}


def known(spark: SparkSession, sink: str, run: str, batch: int) -> DataFrame:
    """(source_url, _hash): the text last accepted of each URL, by all batches but this one."""
    if not exists(spark, f"{sink}/accepted"):
        return spark.createDataFrame([], "source_url string, _hash string")
    rows = spark.read.schema(ACCEPTED).parquet(f"{sink}/accepted").where((F.col("run") != run) | (F.col("batch") != batch))
    return rows.groupBy("source_url").agg(F.max_by("text_hash", F.struct("run", "batch", "item_id")).alias("_hash"))


def gated(items: DataFrame, domains: DataFrame, before: DataFrame) -> DataFrame:
    """items with text_hash, stage, outcome and reason. Items of one URL are taken in the order of their ids."""
    rows = D.allowed_url(items, domains, "source_url").drop("host")
    checked = D.validate(F.col("text"), F.col("n_bytes"), F.col("pages"), F.col("code"), F.col("head"))
    rows = rows.withColumn("checked", checked).withColumn("text_hash", content_hash(F.coalesce("text", F.lit(""))))
    passes = F.col("allowed") & (F.col("checked") == "ACCEPTED")
    # only items that got through the gates before are compared with each other
    last = F.lag("text_hash").over(Window.partitionBy("source_url", passes).orderBy("item_id"))
    rows = rows.withColumn("_last", last).join(before, "source_url", "left")
    old = F.coalesce("_last", "_hash")
    change = F.when(old.isNull(), "NEW").when(old == F.col("text_hash"), "DUPLICATE").otherwise("CHANGED")
    return G.gate(rows.withColumn("change", change)).drop("allowed", "checked", "change", "_last", "_hash")


def _seen(stage: str, outcome: str, reason: str | None) -> Column:
    """Whether an item got this outcome in this stage; a stage before the one that settled it let it pass."""
    if outcome == "passed":
        return F.col("stage").isin([s for s in G.STAGES if G.STAGES.index(s) > G.STAGES.index(stage)])
    return (F.col("stage") == stage) & (F.col("outcome") == outcome) & F.col("reason").eqNullSafe(F.lit(reason))


def _write(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def land(batch: DataFrame, number: int, sink: str, run: str, domains: DataFrame, prepare: Callable[[DataFrame], DataFrame]) -> None:
    """One batch into the three tables. The log comes from counts that are observed while the items are written, without another pass."""
    spark, began = batch.sparkSession, time.monotonic()
    at = f"run={run}/batch={number}"
    counts = [(s, o, r) for s, each in REASONS.items() for o, r in each]
    watch = Observation()
    rows = gated(prepare(batch), domains, known(spark, sink, run, number))
    rows = rows.observe(watch, *[F.count_if(_seen(*c)).alias(f"n{i}") for i, c in enumerate(counts)])
    _write(rows, f"{sink}/landed/{at}")
    took, found = int(1000 * (time.monotonic() - began)), watch.get
    landed = spark.read.schema(rows.schema).parquet(f"{sink}/landed/{at}")
    taken = F.col("outcome").isin("new", "changed")
    _write(landed.where(taken).drop("stage", "reason"), f"{sink}/accepted/{at}")
    _write(landed.where(~taken & (F.col("outcome") != "duplicate")), f"{sink}/rejects/{at}")
    lines = [(*c, found[f"n{i}"], took, datetime.now(UTC)) for i, c in enumerate(counts) if found[f"n{i}"]]
    _write(spark.createDataFrame(lines, LOG).coalesce(1), f"{sink}/log/{at}")


def ingest(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, run: str, domains: DataFrame,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, files_a_batch: int | None = None,
) -> None:
    """Take in what has come to a folder of Parquet files since the checkpoint, then end: availableNow stands for a scheduled job.

    schema is the files' own; prepare turns a batch into items (item_id, source_url, text, n_bytes, pages, code, head). Names of runs sort by time.
    """
    stream = spark.readStream.schema(schema)
    if files_a_batch:
        stream = stream.option("maxFilesPerTrigger", files_a_batch)
    query = stream.parquet(source).writeStream.foreachBatch(lambda b, n: land(b, n, sink, run, domains, prepare))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """accepted, rejects or log, with run and batch; batches that are not through yet may be in it in part."""
    return spark.read.parquet(f"{sink}/{name}")
