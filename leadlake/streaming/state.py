"""Rules that Spark's keyed state carries through a stream: which leads of a job are new, and which are held.

Both rules are functions for ``applyInPandasWithState``, job control keyed by job, leads by a bucket of jobs. What they keep is
JSON text: bounded by the limits of the jobs for leads, by the delay and the pause for job control.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadlake.functions.text import absent_as_null, norm_text, phone_key

STATE = "kept string"
# Groups that the jobs of a lead stream are dealt into. A call for a group costs far more than a visit, so their number must not grow with the jobs.
JOB_BUCKETS = 1 << 14


def first_leads(found: DataFrame, forget_after_s: int | None = None) -> DataFrame:
    """The leads a job delivers, out of a stream of its visited places in order.

    ``found`` has one row per visit: (job_id, n, url, max_results, accepted, name, city, phone, lead), ``lead`` being a text that
    is handed through. The first ``max_results`` visits count; of these each link once; of accepted ones those whose name and city, and whose phone,
    no earlier kept lead of the job has. Visits of a job arrive in the order of ``n``, those of one micro-batch in any.
    When the limit is used up only the number of visits stays. A job without visits for ``forget_after_s`` seconds is forgotten;
    such a stream never ends by itself, since Spark goes on looking for jobs to forget.
    """
    # Few columns, as every one costs time per group; the job's text names it in the state, whatever the type of ``job_id``.
    visit = F.struct(
        F.col("job_id").cast("string").alias("job"), "url", "max_results", "accepted", norm_text(F.col("name")).alias("name"),
        norm_text(F.col("city")).alias("city"), absent_as_null(phone_key(F.col("phone"))).alias("phone"))
    keyed = found.select(F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)).alias("_bucket"), "job_id", "n", F.to_json(visit).alias("_visit"), "lead")
    schema = T.StructType([keyed.schema["job_id"], keyed.schema["n"], keyed.schema["lead"]])

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Per job: [its name, when it was last visited, number of visits, links, names and cities, phones].
        jobs = {job[0]: job for job in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if forget_after_s is not None else 0
        kept = []
        if not state.hasTimedOut:
            for name, visits in _first_visits(parts, jobs).items():
                job = jobs.setdefault(name, [name, now, 0, [], [], []])
                job[1] = now
                kept += _decide_job(job, *visits)
        if forget_after_s is not None:
            jobs = {name: job for name, job in jobs.items() if job[1] + forget_after_s * 1000 > now}
        if not jobs:
            state.remove()
        else:
            state.update((json.dumps([*jobs.values()]),))
            if forget_after_s is not None:
                state.setTimeoutDuration(min(job[1] for job in jobs.values()) + forget_after_s * 1000 - now)
        if kept:
            yield pd.DataFrame(kept, columns=schema.fieldNames())

    timeout = GroupStateTimeout.NoTimeout if forget_after_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return keyed.groupBy("_bucket").applyInPandasWithState(decide, schema, STATE, "append", timeout)


def _first_visits(parts: Iterable[pd.DataFrame], jobs: dict) -> dict:
    """Per job its limit and its visits, (n, job_id, visit, lead) each; of every part only the first ones within the limit are held."""
    found: dict = {}
    for part in parts:
        touched = set()
        for job_id, n, text, lead in zip(part["job_id"].tolist(), part["n"].tolist(), part["_visit"].tolist(), part["lead"].tolist()):
            visit = json.loads(text)
            name = visit.get("job")
            one = found.get(name)
            if one is None:
                one = found[name] = [0, []]
            one[0] = max(one[0], visit.get("max_results") or 0)
            one[1].append((n, job_id, visit, lead))
            touched.add(name)
        for name in touched:
            limit, visits = found[name]
            room = max(0, limit - (jobs[name][2] if name in jobs else 0))
            if len(visits) > room:
                found[name][1] = heapq.nsmallest(room, visits, key=lambda row: row[0])
    return found


def _decide_job(job: list, limit: int, visits: list[tuple]) -> list[tuple]:
    """The leads (job_id, n, lead) that one job delivers, its state ``job`` brought up to date."""
    job[2] += len(visits)
    seen, known, called = set(job[3]), {tuple(name) for name in job[4]}, set(job[5])
    kept = []
    for n, job_id, visit, lead in sorted(visits, key=lambda row: row[0]):
        url, name, phone = visit.get("url"), (visit["name"], visit["city"]), visit.get("phone")
        again = url is not None and url in seen
        seen.add(url)
        if again or not visit["accepted"] or name in known or phone is not None and phone in called:
            continue
        known.add(name)
        called.add(phone)
        kept.append((job_id, n, lead))
    # When the limit is used up only the number of visits stays.
    job[3:] = [sorted(x for x in some if x is not None) for some in (seen, known, called)] if job[2] < limit else [[], [], []]
    return kept


def controlled(events: DataFrame, delay: str) -> DataFrame:
    """Leads with their release time, out of a stream of leads and status changes in any order within ``delay``.

    ``events`` has (job_id, n, ts, status), ``status`` null for leads and ``ts`` in whole microseconds. An event waits until the
    watermark, the latest time seen less ``delay``, has passed it; then the events of a job are taken in order of time, leads
    before statuses, leads by ``n``, statuses by name. After a cancellation leads are dropped. While a job is paused they are held: until
    the next status that is no pause, with that time, or dropped if that one cancels. Events that come later than the
    watermark are dropped. A job whose events are all taken is forgotten once it is cancelled, or runs and holds nothing, except
    for its status. An event of no job only moves the watermark.
    """
    # A null number would turn the whole column into floating-point numbers.
    numbered = events.withColumns({"_at": F.timestamp_micros("ts"), "n": F.coalesce("n", F.lit(0).cast(events.schema["n"].dataType))})
    timed = numbered.withWatermark("_at", delay)
    schema = T.StructType([events.schema["job_id"], events.schema["n"], events.schema["ts"], T.StructField("release_ts", T.LongType())])

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        status, cancelled, waiting, held = json.loads(state.get[0]) if state.exists else ("running", False, [], [])
        if not state.hasTimedOut:
            for part in parts:
                for n, ts, text in zip(part["n"], part["ts"], part["status"]):
                    lead = text is None or text != text
                    waiting.append([int(ts), 0 if lead else 1, int(n) if lead else 0, "" if lead else text])
        passed_us = state.getCurrentWatermarkMs() * 1000
        ready = sorted(event for event in waiting if event[0] < passed_us)
        waiting = [event for event in waiting if event[0] >= passed_us]
        released = []
        for ts, kind, n, text in ready:
            if kind:
                if text != "paused":
                    if text != "cancelled" and not cancelled:
                        released += [(key[0], lead, at, ts) for lead, at in held]
                    held = []
                cancelled = cancelled or text == "cancelled"
                status = text
            elif not cancelled:
                if status == "paused":
                    held.append([n, ts])
                else:
                    released.append((key[0], n, ts, ts))
        state.update((json.dumps([status, cancelled, waiting, held]),))
        if waiting:
            state.setTimeoutTimestamp(min(event[0] for event in waiting) // 1000 + 1)
        if released:
            yield pd.DataFrame(released, columns=schema.fieldNames())

    return timed.groupBy("job_id").applyInPandasWithState(decide, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
