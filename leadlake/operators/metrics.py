"""Per-job counters, rates, reports and worker liveness from an event log.

Events: (job_id, ts_us, kind, count, elapsed_ms, emails, socials, technologies, cache_hit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.operators.ordered import with_carried


def _of_kind(kind: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("bigint")


def job_counters() -> list[Column]:
    """Aggregates of one job's events, for batch and streaming groupings alike."""
    count, elapsed = F.col("count"), F.col("elapsed_ms")
    one = F.lit(1)
    return [
        _of_kind("scraped", count).alias("leads_scraped"),
        _of_kind("sent", count).alias("leads_sent"),
        _of_kind("new", count).alias("leads_new"),
        _of_kind("deduped", count).alias("leads_deduped"),
        _of_kind("cache_hit", count).alias("cache_hits"),
        _of_kind("error", count).alias("errors"),
        _of_kind("retry", count).alias("retries"),
        _of_kind("batch", one).alias("batches_sent"),
        _of_kind("batch", elapsed).alias("total_batch_ms"),
        # A phase is timed once per job: the latest record counts.
        F.coalesce(F.max_by(F.when(F.col("kind") == "phase1", elapsed), F.when(F.col("kind") == "phase1", F.col("ts_us"))), F.lit(0)).cast("bigint").alias("phase1_ms"),
        F.coalesce(F.max_by(F.when(F.col("kind") == "phase2", elapsed), F.when(F.col("kind") == "phase2", F.col("ts_us"))), F.lit(0)).cast("bigint").alias("phase2_ms"),
        _of_kind("nav", one).alias("navs"),
        _of_kind("nav", elapsed).alias("total_nav_ms"),
        F.min("ts_us").alias("started_us"),
        F.max("ts_us").alias("last_us"),
    ]


def enrichment_counters() -> list[Column]:
    hit = F.coalesce(F.col("cache_hit"), F.lit(False))
    return [
        _of_kind("enriched", F.lit(1)).alias("leads_enriched"),
        _of_kind("enriched", F.col("emails")).alias("emails_found"),
        _of_kind("enriched", F.col("socials")).alias("socials_found"),
        _of_kind("enriched", F.col("technologies")).alias("technologies_found"),
        _of_kind("enriched", hit.cast("int")).alias("enrich_cache_hits"),
        _of_kind("enriched", (~hit).cast("int")).alias("enrich_cache_misses"),
        _of_kind("enriched", F.col("elapsed_ms")).alias("total_enrich_ms"),
    ]


def job_metrics(events: DataFrame) -> DataFrame:
    """Counters per job: one partial and one final hash aggregate."""
    return events.groupBy("job_id").agg(*job_counters())


def enrichment_metrics(events: DataFrame) -> DataFrame:
    """Enrichment counters per job."""
    return events.groupBy("job_id").agg(*enrichment_counters())


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 when the divisor is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def rate_columns() -> dict[str, Column]:
    elapsed = (F.col("last_us") - F.col("started_us")) / 1e6
    per_minute = _ratio(F.col("leads_sent"), elapsed) * 60
    hit_rate = _ratio(F.col("cache_hits"), F.col("cache_hits") + F.col("leads_scraped"))
    return {
        "elapsed_s": F.bround(elapsed, 1),
        "leads_per_min": F.bround(per_minute, 1),
        "cache_hit_rate": F.bround(hit_rate * 100, 1),
        "avg_batch_ms": _ratio(F.col("total_batch_ms"), F.col("batches_sent")),
        "avg_nav_ms": F.bround(_ratio(F.col("total_nav_ms"), F.col("navs")), 0),
    }


def job_rates(metrics: DataFrame) -> DataFrame:
    """Rates of the snapshot, rounded half to even on the shortest decimal text of the number.

    A tie that only exists in that text (0.35) may differ in the last digit from rounding the binary value.
    """
    return metrics.withColumns(rate_columns())


def instant_rate(reports: DataFrame) -> DataFrame:
    """Leads per minute since the previous report of the job.

    ``reports`` has (job_id, ts_us, leads_sent, started_us); the first report is measured
    against the job start with nothing sent.
    """
    previous = with_carried(
        reports, ["job_id"], ["ts_us"], F.struct("ts_us", "leads_sent"), "_previous"
    )
    minutes = (F.col("ts_us") - F.coalesce(F.col("_previous.ts_us"), F.col("started_us"))) / 60e6
    leads = F.col("leads_sent") - F.coalesce(F.col("_previous.leads_sent"), F.lit(0))
    return previous.withColumn("instant_lpm", _ratio(leads, minutes)).drop("_previous")


# Fixed value: the report line.
_REPORT = (
    "metrics [%s] job=%s scraped=%d sent=%d new=%d deduped=%d cache_hits=%d cache_hit_rate=%.0f%% "
    "errors=%d retries=%d batches=%d avg_batch_ms=%.0f phase1_ms=%d phase2_ms=%d avg_nav_ms=%.0f navs=%d "
    "enriched=%d emails=%d socials=%d technologies=%d enrich_cache_hits=%d enrich_cache_misses=%d "
    "elapsed=%.1fs leads_per_min=%.1f instant_lpm=%.1f"
)


def metrics_report(metrics: DataFrame, final: bool = False) -> DataFrame:
    """One summary line per job.

    Needs the columns of :func:`job_metrics`, :func:`enrichment_metrics`,
    :func:`job_rates` and ``instant_lpm``.
    """
    def c(name: str, digits: int | None = None) -> Column:
        # format_string rounds halves up; rounding first keeps them to even.
        return F.col(name) if digits is None else F.bround(name, digits)

    # From the counters: the snapshot's rate is rounded already, and rounding twice may print one more.
    hit_rate = _ratio(F.col("cache_hits"), F.col("cache_hits") + F.col("leads_scraped")) * 100

    line = F.format_string(
        _REPORT, F.lit("FINAL" if final else "progress"), c("job_id"),
        c("leads_scraped"), c("leads_sent"), c("leads_new"), c("leads_deduped"),
        c("cache_hits"), F.bround(hit_rate, 0), c("errors"), c("retries"),
        c("batches_sent"), c("avg_batch_ms", 0), c("phase1_ms"), c("phase2_ms"), c("avg_nav_ms", 0), c("navs"),
        c("leads_enriched"), c("emails_found"), c("socials_found"), c("technologies_found"),
        c("enrich_cache_hits"), c("enrich_cache_misses"),
        c("elapsed_s", 1), c("leads_per_min", 1), c("instant_lpm", 1),
    )
    return metrics.select("job_id", line.alias("report"))


def region_exhausted(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Per job, whether its region has no more places to offer.

    ``jobs`` has (job_id, mode, max_results). ``found`` has one row per job with links:
    (job_id, places, stopped_without_growth, direct_match). ``pipelined``: a direct match,
    or no growth with fewer places than asked for; no links means false.
    ``sequential``: fewer places than asked for; no links means true.
    """
    joined = jobs.join(found, "job_id", "left")
    places = F.coalesce("places", F.lit(0))
    short = places < F.col("max_results")
    direct = F.coalesce("direct_match", F.lit(False))
    stuck = F.coalesce("stopped_without_growth", F.lit(False))
    exhausted = F.when(F.col("mode") == "sequential", (places == 0) | short).otherwise(
        F.when(places == 0, False).otherwise(direct | (stuck & short))
    )
    return joined.select("job_id", "mode", places.alias("places"), exhausted.alias("region_exhausted"))


def worker_liveness(
    heartbeats: DataFrame, now_us: int, online_s: int = 30, offline_s: int = 60
) -> DataFrame:
    """Latest heartbeat of each worker and its state: online, late or offline."""
    fields = [c for c in heartbeats.columns if c != "worker_id"]
    latest = heartbeats.groupBy("worker_id").agg(F.max_by(F.struct(*fields), "ts_us").alias("_last"))
    age = (F.lit(now_us) - F.col("ts_us")) / 1e6
    state = F.when(age <= online_s, "online").when(age <= offline_s, "late").otherwise("offline")
    return latest.select("worker_id", "_last.*").withColumns({"age_s": age, "state": state})
