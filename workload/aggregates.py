"""Dedup, metrics and job outcomes: queries and oracles (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.operators import dedup, metrics, saturation
from workload import normalise as nz
from workload.inputs import DERIVED, derived, oracle

c = F.col
QUERIES, ORACLES = {}, {}

QUERIES["f1_dedup_urls"] = lambda spark, sf: dedup.dedup_urls(derived(spark, sf, "cards", heavy=True))
ORACLES["f1_dedup_urls"] = oracle(
    """select job_id, min(position) as position, url, arg_min(name, position) as name, arg_min(rating, position) as rating,
       arg_min(reviews, position) as reviews, arg_min(category, position) as category from @cards group by job_id, url"""
)

# Greedy dedup in SQL: step i decides the i-th row of every job, carrying the kept keys.
GREEDY = [
    ("keyed", f"""select job_id, n, {nz.sql_norm('name')} || '|' || {nz.sql_norm('city')} as nk, nullif({nz.sql_phone_key('phone')}, '') as pk,
        row_number() over (partition by job_id order by n) as i from {{source}}"""),
    ("walk", """select job_id, n, i, true as kept, [nk] as names, case when pk is null then []::varchar[] else [pk] end as phones from keyed where i = 1
        union all
        select job_id, n, i, kept, case when kept then list_append(names, nk) else names end,
               case when kept and pk is not null then list_append(phones, pk) else phones end
        from (select k.job_id, k.n, k.i, k.nk, k.pk, w.names, w.phones,
                     not list_contains(w.names, k.nk) and not coalesce(list_contains(w.phones, k.pk), false) as kept
              from walk w join keyed k on k.job_id = w.job_id and k.i = w.i + 1) s"""),
]


def greedy(source):
    return [(name, text.replace("{source}", source)) for name, text in GREEDY]


QUERIES["f2_dedup_leads"] = lambda spark, sf: dedup.dedup_leads(derived(spark, sf, "leads", heavy=True))
ORACLES["f2_dedup_leads"] = oracle(
    "select l.* from @leads l join walk using (job_id, n) where kept", *greedy("@leads"), recursive=True
)
# The same rule by set-based rounds, the way taken for a job too large for one task.
QUERIES["f2_dedup_leads_rounds"] = lambda spark, sf: dedup.dedup_leads(derived(spark, sf, "leads", heavy=True), group_rows=100)
ORACLES["f2_dedup_leads_rounds"] = ORACLES["f2_dedup_leads"]
QUERIES["f3_unique_lead_count"] = lambda spark, sf: dedup.unique_lead_count(dedup.dedup_leads(derived(spark, sf, "leads", heavy=True)))
ORACLES["f3_unique_lead_count"] = oracle(
    "select job_id, count(*) as unique_leads from walk where kept group by 1", *greedy("@leads"), recursive=True
)


def _sum(kind, value="count"):
    return f"coalesce(sum({value}) filter (where kind = '{kind}'), 0)::bigint"


_COUNTERS = {
    "leads_scraped": _sum("scraped"), "leads_sent": _sum("sent"), "leads_new": _sum("new"), "leads_deduped": _sum("deduped"),
    "cache_hits": _sum("cache_hit"), "errors": _sum("error"), "retries": _sum("retry"), "batches_sent": _sum("batch", "1"),
    "total_batch_ms": _sum("batch", "elapsed_ms"),
    "phase1_ms": "coalesce(arg_max(elapsed_ms, ts_us) filter (where kind = 'phase1'), 0)",
    "phase2_ms": "coalesce(arg_max(elapsed_ms, ts_us) filter (where kind = 'phase2'), 0)",
    "navs": _sum("nav", "1"), "total_nav_ms": _sum("nav", "elapsed_ms"), "started_us": "min(ts_us)", "last_us": "max(ts_us)",
}
_ENRICH = {
    "leads_enriched": _sum("enriched", "1"), "emails_found": _sum("enriched", "emails"), "socials_found": _sum("enriched", "socials"),
    "technologies_found": _sum("enriched", "technologies"), "enrich_cache_hits": _sum("enriched", "cache_hit::int"),
    "enrich_cache_misses": _sum("enriched", "(not cache_hit)::int"), "total_enrich_ms": _sum("enriched", "elapsed_ms"),
}


def _aggregates(columns):
    return "select job_id, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + " from @job_events group by job_id"


def _half_even(x, digits):
    return f"round_even({x}, {digits})::double"


_ELAPSED = "((last_us - started_us) / 1e6::double)"
_RATES = {
    "elapsed_s": _half_even(_ELAPSED, 1),
    "leads_per_min": _half_even(f"case when {_ELAPSED} > 0 then leads_sent / {_ELAPSED} else 0 end * 60", 1),
    "cache_hit_rate": _half_even("case when cache_hits + leads_scraped > 0 then cache_hits / (cache_hits + leads_scraped) else 0 end * 100", 1),
    "avg_batch_ms": "case when batches_sent > 0 then total_batch_ms / batches_sent else 0 end",
    "avg_nav_ms": _half_even("case when navs > 0 then total_nav_ms / navs else 0 end", 0),
}
_METRIC_CTES = [("metrics", _aggregates({**_COUNTERS, **_ENRICH})),
                ("rates", "select *, " + ", ".join(f"{v} as {k}" for k, v in _RATES.items()) + " from metrics")]

QUERIES["f4_job_metrics"] = lambda spark, sf: metrics.job_metrics(derived(spark, sf, "job_events"))
ORACLES["f4_job_metrics"] = oracle(_aggregates(_COUNTERS))
QUERIES["f5_job_rates"] = lambda spark, sf: metrics.job_rates(metrics.job_metrics(derived(spark, sf, "job_events"))).select(
    "job_id", *_RATES)
ORACLES["f5_job_rates"] = oracle(f"select job_id, {', '.join(_RATES)} from rates", *_METRIC_CTES)

# One report per "batch" event, with the leads sent so far.
DERIVED["reports"] = """
    select job_id, ts_us, leads_sent, started_us from (
        select job_id, ts_us, kind, cast(sum(case when kind = 'sent' then count else 0 end) over (partition by job_id order by ts_us) as bigint) as leads_sent,
               min(ts_us) over (partition by job_id) as started_us from @job_events) e
    where kind = 'batch'"""
_INSTANT = """select job_id, ts_us, leads_sent, started_us, case when minutes > 0 then fresh / minutes else 0 end as instant_lpm from (
    select *, (ts_us - coalesce(lag(ts_us) over w, started_us)) / 60e6::double as minutes, leads_sent - coalesce(lag(leads_sent) over w, 0) as fresh
    from @reports window w as (partition by job_id order by ts_us)) r"""
QUERIES["f6_instant_rate"] = lambda spark, sf: metrics.instant_rate(derived(spark, sf, "reports"))
ORACLES["f6_instant_rate"] = oracle(_INSTANT)
QUERIES["f7_enrichment_metrics"] = lambda spark, sf: metrics.enrichment_metrics(derived(spark, sf, "job_events"))
ORACLES["f7_enrichment_metrics"] = oracle(_aggregates(_ENRICH))


def _report(spark, sf):
    events = derived(spark, sf, "job_events")
    counted = events.groupBy("job_id").agg(*metrics.job_counters(), *metrics.enrichment_counters())
    last = metrics.instant_rate(derived(spark, sf, "reports")).groupBy("job_id").agg(F.max_by("instant_lpm", "ts_us").alias("instant_lpm"))
    full = metrics.job_rates(counted).join(last, "job_id", "left").fillna(0.0, ["instant_lpm"])
    return metrics.metrics_report(full, final=True)


QUERIES["f8_metrics_report"] = _report
ORACLES["f8_metrics_report"] = oracle(
    """select job_id, printf('metrics [FINAL] job=%s scraped=%d sent=%d new=%d deduped=%d cache_hits=%d cache_hit_rate=%.0f%% '
        || 'errors=%d retries=%d batches=%d avg_batch_ms=%.0f phase1_ms=%d phase2_ms=%d avg_nav_ms=%.0f navs=%d enriched=%d emails=%d '
        || 'socials=%d technologies=%d enrich_cache_hits=%d enrich_cache_misses=%d elapsed=%.1fs leads_per_min=%.1f instant_lpm=%.1f',
        job_id, leads_scraped, leads_sent, leads_new, leads_deduped, cache_hits, case when cache_hits + leads_scraped > 0 then 100.0::double * cache_hits / (cache_hits + leads_scraped) else 0 end, errors, retries, batches_sent, avg_batch_ms,
        phase1_ms, phase2_ms, avg_nav_ms, navs, leads_enriched, emails_found, socials_found, technologies_found, enrich_cache_hits,
        enrich_cache_misses, elapsed_s, leads_per_min, coalesce(instant_lpm, 0)) as report
       from rates left join (select job_id, arg_max(instant_lpm, ts_us) as instant_lpm from instant group by 1) i using (job_id)""",
    *_METRIC_CTES, ("instant", _INSTANT),
)

SATURATION = """select job_id, mode, max_results, stop_scroll, stop_reason, pushed, coalesce(stop_reason = 'no_growth', false) and pushed < max_results as exhausted from (
    select job_id, any_value(mode) as mode, any_value(max_results) as max_results,
           coalesce(min(scroll_no) filter (where reason is not null), max(scroll_no)) as stop_scroll,
           coalesce(arg_min(reason, scroll_no) filter (where reason is not null), 'log_end') as stop_reason,
           coalesce(arg_min(pushed, scroll_no) filter (where reason is not null), arg_max(pushed, scroll_no)) as pushed
    from (select *, case when case when mode = 'sequential' then link_count else pushed end >= max_results then 'enough'
                         when sum(still) over (partition by job_id order by scroll_no rows between 2 preceding and current row) >= 3 then 'no_growth'
                         when scroll_no = lim then 'scroll_limit' end as reason
          from (select s.*, mode, max_results, greatest(5, max_results // 5 + 4) as lim,
                       (link_count = coalesce(lag(link_count) over (partition by job_id order by scroll_no), 0))::int as still
                from @scrolls s join @supplier_jobs using (job_id)) a where scroll_no <= lim) b group by job_id) g"""
QUERIES["i5_feed_saturation"] = lambda spark, sf: saturation.feed_saturation(
    derived(spark, sf, "scrolls"), derived(spark, sf, "supplier_jobs"))
ORACLES["i5_feed_saturation"] = oracle(
    "select job_id, stop_scroll, stop_reason, pushed, exhausted from saturation", ("saturation", SATURATION)
)


def _exhausted(spark, sf):
    jobs = derived(spark, sf, "supplier_jobs")
    stops = saturation.feed_saturation(derived(spark, sf, "scrolls"), jobs)
    found = stops.select(
        "job_id", c("pushed").alias("places"), (c("stop_reason") == "no_growth").alias("stopped_without_growth"),
        (c("pushed") == 1).alias("direct_match"),
    )
    return metrics.region_exhausted(jobs, found)


QUERIES["f9_region_exhausted"] = _exhausted
ORACLES["f9_region_exhausted"] = oracle(
    """select job_id, mode, coalesce(pushed, 0) as places, case when mode = 'sequential' then coalesce(pushed, 0) < max_results
        when coalesce(pushed, 0) = 0 then false else pushed = 1 or (stop_reason = 'no_growth' and pushed < max_results) end as region_exhausted
       from @supplier_jobs left join (select job_id, pushed, stop_reason from saturation) s using (job_id)""",
    ("saturation", SATURATION),
)
_LATE = 1_706_659_020_000_000
QUERIES["f10_worker_liveness"] = lambda spark, sf: metrics.worker_liveness(
    derived(spark, sf, "heartbeats"), _LATE, online_s=3600, offline_s=7200)
ORACLES["f10_worker_liveness"] = oracle(
    f"""select *, case when age_s <= 3600 then 'online' when age_s <= 7200 then 'late' else 'offline' end as state from (
        select *, ({_LATE} - ts_us) / 1e6::double as age_s from @heartbeats
        qualify row_number() over (partition by worker_id order by ts_us desc) = 1) h"""
)
