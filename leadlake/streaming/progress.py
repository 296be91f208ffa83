"""Live progress and live metrics: the batch aggregates in update mode."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadlake.functions.search import progress_pct, stage_message
from leadlake.operators.metrics import enrichment_counters, job_counters, rate_columns
from leadlake.sources import manifests
from leadlake.sources.sinks import append_leads
from leadlake.streaming.leads import TRIGGER

# Epochs whose rows are folded into one snapshot.
FOLD_EPOCHS = 64
_POINTER = "snapshot.json"


def live_progress(leads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Running number, percentage and message per job; for tables and streams.

    ``leads`` has (job_id, n, name), ``jobs`` has (job_id, max_results).
    """
    counted = leads.groupBy("job_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max_by("name", "n").alias("_name")
    )
    joined = counted.join(jobs.select("job_id", "max_results"), "job_id", "inner")
    n, limit = F.col("n"), F.col("max_results")
    return joined.select(
        "job_id", "n", progress_pct(n, limit).alias("pct"),
        stage_message(n, limit, F.lit("extracting"), F.col("_name")).alias("msg"),
    )


def live_job_metrics(events: DataFrame, started_at: str | None = None, expire_after: str = "1 hour") -> DataFrame:
    """Counters and rates per job, kept up to date; for tables and streams.

    With ``started_at`` (an event-time column with the job's start, equal on all its
    events) the state of a stream forgets jobs that started long enough ago.
    """
    keys = ["job_id"]
    if started_at is not None:
        events = events.withWatermark(started_at, expire_after)
        keys.append(started_at)
    return events.groupBy(*keys).agg(*job_counters(), *enrichment_counters()).withColumns(rate_columns())


def write_updates(updates: DataFrame, out: str, available_now: bool = False, fold_epochs: int = FOLD_EPOCHS) -> StreamingQuery:
    """Keep each epoch's changed rows under ``out``/updates; every ``fold_epochs`` epochs become one snapshot of the latest rows."""
    def write(batch: DataFrame, epoch: int) -> None:
        append_leads(batch, f"{out}/updates", epoch)
        if (epoch + 1) % fold_epochs == 0:
            fold_updates(batch.sparkSession, out, epoch)

    writer = (
        updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()


def _snapshot(spark: SparkSession, out: str) -> dict:
    if _POINTER in manifests.names_in(spark, out):
        return manifests.load(spark, out, _POINTER)
    return {"upto": -1, "folder": None, "before": -1, "old": None}


def _epochs(spark: SparkSession, out: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in manifests.names_in(spark, f"{out}/updates") if n.startswith("epoch="))


def read_updates(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`write_updates` wrote: the last snapshot and the epochs after it, so at most a few epochs however long the stream has run."""
    snapshot = _snapshot(spark, out)
    later = [f"{out}/updates/epoch={e}" for e in _epochs(spark, out) if e > snapshot["upto"]]
    epoch = F.col("epoch").cast("long").alias("epoch")
    parts = [spark.read.parquet(f"{out}/snapshots/{snapshot['folder']}")] if snapshot["folder"] else []
    if later or not parts:
        table = spark.read.option("basePath", f"{out}/updates").parquet(*(later or [f"{out}/updates"]))
        parts.append(table.select(*[c for c in table.columns if c != "epoch"], epoch))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fold_updates(spark: SparkSession, out: str, epoch: int) -> None:
    """Put the latest row per job up to ``epoch`` into a snapshot, swap the pointer to it at once, and remove what the pointer before the last one needed.

    A repeated epoch changes nothing. Who reads under the previous pointer still finds its files.
    """
    last = _snapshot(spark, out)
    if last["upto"] >= epoch:
        return
    folder = f"upto-{epoch}-{uuid.uuid4().hex}"
    table = read_updates(spark, out).where(F.col("epoch") <= epoch)
    latest_updates(table, with_epoch=True).write.parquet(f"{out}/snapshots/{folder}")
    manifests.publish(spark, out, _POINTER, {"upto": epoch, "folder": folder, "before": last["upto"], "old": last["folder"]}, replace=True)
    for old in _epochs(spark, out):
        if old <= last["upto"]:
            manifests.remove(spark, f"{out}/updates/epoch={old}")
    if last["old"]:
        manifests.remove(spark, f"{out}/snapshots/{last['old']}")


def latest_updates(table: DataFrame, with_epoch: bool = False) -> DataFrame:
    """The most recent row per job of what :func:`read_updates` reads."""
    fields = [c for c in table.columns if c not in ("job_id", "epoch")]
    newest = table.groupBy("job_id").agg(F.max_by(F.struct(*fields), "epoch").alias("_v"), F.max("epoch").alias("_epoch"))
    return newest.select("job_id", "_v.*", *([F.col("_epoch").alias("epoch")] if with_epoch else []))
