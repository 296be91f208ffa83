"""Streams of captured pages and places to leads, and of leads under job control.

What a job has visited, kept or holds is Spark's own keyed state (:mod:`leadlake.streaming.state`); a restart goes on from the
checkpoint, and nothing that was delivered is read again. Deliveries go to one folder per epoch, so a repeated epoch replaces itself.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadlake.functions.search import classify_captcha
from leadlake.functions.text import present
from leadlake.operators.filters import city_matches
from leadlake.operators.lookup import backfill_columns
from leadlake.plans.leads import build_leads, job_context
from leadlake.schemas import LEAD
from leadlake.session import spread
from leadlake.sources.pages import extract_place_fields, place_raw
from leadlake.sources.sinks import append_leads
from leadlake.streaming.state import controlled, first_leads

log = logging.getLogger(__name__)

# Fixed value: seconds between deliveries.
TRIGGER = "3 seconds"
# Seconds after which a job without visits is forgotten.
FORGET_AFTER_S = 7 * 86_400
CARD = ("name", "rating", "reviews", "category")
OnLeads = Callable[[DataFrame, int], None]
OnLead = Callable[[dict], None]


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Run ``handle`` per micro-batch, every few seconds or once over what is there."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()


def notify(on_leads: OnLeads | None, leads: DataFrame, epoch: int) -> None:
    """Call the user's hook; its failure never stops the delivery."""
    if on_leads is None:
        return
    try:
        on_leads(leads, epoch)
    except Exception:
        log.debug("lead hook failed in epoch %d", epoch, exc_info=True)


def call_for_each(leads: DataFrame, on_lead: OnLead) -> Row:
    """Call a hook with every lead, where the lead is; (called, failed) counts.

    A failing call concerns its own lead only. Each lead is a dict of its columns.
    """
    def run(batches):
        called = failed = 0
        for batch in batches:
            for lead in batch.to_pylist():
                called += 1
                try:
                    on_lead(lead)
                except Exception:
                    failed += 1
        yield pa.RecordBatch.from_pydict({"called": [called], "failed": [failed]})

    counts = leads.mapInArrow(run, "called long, failed long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("called", "failed")]).first()


def deliver_to(out: str, on_leads: OnLeads | None, on_lead: OnLead | None) -> Callable[[DataFrame, int], None]:
    """Write each epoch's leads to ``out``/leads, then call the hooks with what was written."""
    def deliver(leads: DataFrame, epoch: int) -> None:
        append_leads(leads, f"{out}/leads", epoch)
        written = leads.sparkSession.read.schema(leads.schema).parquet(f"{out}/leads/epoch={epoch}")
        notify(on_leads, written, epoch)
        if on_lead is not None:
            counts = call_for_each(written, on_lead)
            if counts.failed:
                log.debug("lead hook failed for %d of %d leads in epoch %d", counts.failed, counts.called, epoch)

    return deliver


def with_jobs(visits: DataFrame, jobs: DataFrame, within: str = "1 hour") -> DataFrame:
    """Visits with their job's search. ``jobs`` may be a table or a stream.

    Streams are joined with bounded state: both have an event time ``at``, and a job and its visits may be ``within`` of
    each other, whichever arrives first; each side waits that long.
    """
    if not jobs.isStreaming:
        return visits.join(job_context(jobs), "job_id")
    context = job_context(jobs)
    # The job's columns under names of their own, with its time.
    searches = jobs.select(F.col("job_id").alias("_job"), F.col("at").alias("_job_at"), *[
        F.col(source).alias(name) for source, name in zip(("keyword", "city", "state", "country", "max_results"), context.columns[1:])])
    near = f"job_id = _job and _job_at between at - interval {within} and at + interval {within}"
    joined = visits.withWatermark("at", within).join(searches.withWatermark("_job_at", within), F.expr(near))
    return joined.select(*visits.columns, *context.columns[1:])


def judged_visits(places: DataFrame) -> DataFrame:
    """One row per visited place for :func:`first_leads`; ``places`` has raw place columns and the job's search.

    Columns ``card_*`` complete a lead as the batch plan does. A visit that makes no lead stays, as it counts towards the limit.
    """
    cards = [c for c in places.columns if c.startswith("card_")]
    built = build_leads(places, carry=cards)
    accepted = present(F.col("name")) & city_matches(F.col("city"), F.col("search_city")) & F.coalesce(F.col("_city_confirmed"), F.lit(True))
    judged = built.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    if cards:
        judged = judged.withColumns(backfill_columns(F.col("keyword")))
    context = [c for c in ("keyword", "search_city", "search_state", "country", "max_results") if c in judged.columns]
    lead = F.to_json(F.struct("url", *context, *LEAD.fieldNames()))
    return judged.select("job_id", "n", "url", "max_results", "accepted", "name", "city", "phone", lead.alias("lead"))


def leads_of(visits: DataFrame, forget_after_s: int | None = None) -> DataFrame:
    """The stream of delivered leads out of :func:`judged_visits`."""
    context = [T.StructField(c, T.StringType()) for c in ("url", "keyword", "search_city", "search_state", "country")]
    schema = T.StructType([*context, T.StructField("max_results", T.IntegerType()), *LEAD.fields])
    kept = first_leads(visits, forget_after_s)
    return kept.select("job_id", "n", F.from_json("lead", schema).alias("lead")).select("job_id", "n", "lead.*")


def stream_leads(
    places: DataFrame, jobs: DataFrame, out: str, on_leads: OnLeads | None = None, available_now: bool = False, on_lead: OnLead | None = None,
    forget_after_s: int = FORGET_AFTER_S,
) -> StreamingQuery:
    """Place texts in, delivered leads out (``out``/leads), each as soon as it is found.

    ``places`` is a stream with (job_id, n, url) and the raw place columns, in job order. ``on_leads`` is called
    with the leads of an epoch, ``on_lead`` with every single lead. For jobs that are a stream too see :func:`stream_visits`.
    """
    # A stream of few files or partitions would build all its leads in as few tasks.
    leads = leads_of(judged_visits(with_jobs(spread(places), jobs)), None if available_now else forget_after_s)
    return start(leads, deliver_to(out, on_leads, on_lead), f"{out}/checkpoint", available_now)


def read_captures(captures: DataFrame) -> DataFrame:
    """Raw place texts of captured pages; a missing or blocked page gives none. Card columns become ``card_*``."""
    blocked = F.coalesce(classify_captcha(F.col("html")), F.lit(True))
    cards = {c: f"card_{c}" for c in CARD if c in captures.columns}
    return place_raw(extract_place_fields(captures.withColumnsRenamed(cards).withColumn("html", F.when(~blocked, F.col("html")))))


def stream_page_leads(
    captures: DataFrame, jobs: DataFrame, out: str, on_leads: OnLeads | None = None, available_now: bool = False, on_lead: OnLead | None = None,
    forget_after_s: int = FORGET_AFTER_S,
) -> StreamingQuery:
    """Captured pages in, delivered leads out (``out``/leads): the batch plan from pages to leads as one stream.

    ``captures`` has a row per card of a job's result list, in its order: (job_id, n, url, html) and the card's name, rating,
    reviews and category. ``html`` is null where there is no page; the card counts towards the job's limit all the same.
    Pages are read in the partitions that ``captures`` has, dealt out by a join of cards with their pages.
    """
    leads = leads_of(judged_visits(with_jobs(read_captures(captures), jobs)), None if available_now else forget_after_s)
    return start(leads, deliver_to(out, on_leads, on_lead), f"{out}/checkpoint", available_now)


def stream_visits(visits: DataFrame, jobs: DataFrame, out: str, within: str = "1 hour", available_now: bool = False) -> StreamingQuery:
    """Visits joined with a stream of jobs into the table ``out``/visits, which a lead stream reads as its places.

    A step of its own, since Spark runs no other state behind a join of streams with a time bound.
    """
    joined = with_jobs(visits, jobs, within)
    writer = joined.writeStream.format("parquet").option("path", f"{out}/visits").option("checkpointLocation", f"{out}/visits-checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()


def stream_control(
    events: DataFrame, out: str, on_leads: OnLeads | None = None, available_now: bool = False, delay: str = "10 minutes",
) -> StreamingQuery:
    """Hold leads of paused jobs, release them on resume, drop them after a cancellation.

    ``events`` mixes leads (``status`` null) and status changes: (job_id, n, ts, status), ``ts`` in whole microseconds, in any order within
    ``delay`` (:func:`~leadlake.streaming.state.controlled`). Delivered leads go to ``out``/delivered with their release time;
    :func:`waiting_leads` reads what the state holds.
    """
    def deliver(leads: DataFrame, epoch: int) -> None:
        append_leads(leads, f"{out}/delivered", epoch)
        notify(on_leads, leads.sparkSession.read.schema(leads.schema).parquet(f"{out}/delivered/epoch={epoch}"), epoch)

    return start(controlled(events, delay), deliver, f"{out}/checkpoint", available_now)


def waiting_leads(spark: SparkSession, out: str) -> DataFrame:
    """(job_id, n, ts) of the leads that :func:`stream_control` holds for paused jobs."""
    state = spark.read.format("statestore").option("path", f"{out}/checkpoint").load()
    kept = F.col("value.groupState.kept")
    held = F.from_json(F.get_json_object(kept, "$[3]"), "array<array<long>>")
    return state.select(F.col("key.*"), F.explode(held).alias("_h")).select(F.col("job_id"), F.col("_h")[0].alias("n"), F.col("_h")[1].alias("ts"))
