"""Lookups, caps and cache maintenance: queries and oracles (E, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import search as sx
from leadlake.operators import cache, dedup, limits, lookup
from leadlake.schemas import RESULT_ENTRY
from leadlake.session import scratch_path
from leadlake.sources import sinks
from workload import normalise as nz
from workload.diagnose import sql_city_matches
from workload.inputs import DERIVED, NOW, NOW_SQL, derived, oracle

c = F.col
QUERIES, ORACLES = {}, {}
DAY = 86_400

# --- E ---------------------------------------------------------------------------------------

SQL_FIRST_CARD = """select job_id, url, min(position) as position, arg_min(name, position) as name, arg_min(rating, position) as rating,
    arg_min(reviews, position) as reviews, arg_min(category, position) as category from @cards group by job_id, url"""
QUERIES["e1_backfill_from_feed"] = lambda spark, sf: lookup.backfill_from_feed(
    derived(spark, sf, "part_leads", heavy=True), dedup.dedup_urls(derived(spark, sf, "cards", heavy=True))
)
ORACLES["e1_backfill_from_feed"] = oracle(
    f"""select l.job_id, l.url, keyword, case when l.name <> '' then l.name when f.name <> '' then f.name else l.name end as name,
        case when l.category = {nz.sql_title('keyword')} and f.category <> '' then f.category else l.category end as category,
        case when coalesce(l.rating, 0) = 0 then coalesce(try_cast(replace(f.rating, ',', '.') as double), l.rating) else l.rating end as rating,
        case when coalesce(review_count, 0) = 0 then coalesce(try_cast(reviews as int), review_count) else review_count end as review_count
        from @part_leads l left join first_card f on l.job_id = f.job_id and l.url = f.url""",
    ("first_card", SQL_FIRST_CARD),
)


def _place_cache(spark, sf):
    """Cache after all writes of the suppliers; the lead is the supplier's name and city."""
    writes = derived(spark, sf, "place_writes").select(
        "url", F.struct(F.concat(F.lit("Place "), c("supplier")).alias("name"),
                        F.when(c("supplier") % 3 == 0, "São Paulo").when(c("supplier") % 3 == 1, "Belém").alias("city")).alias("lead"),
        "cached_at",
    )
    empty = writes.select(F.lit("").alias("key"), "url", "lead", "cached_at", F.lit(0).alias("ttl_s")).where(F.lit(False))
    return cache.put_places(empty, writes)


SQL_PLACE_CACHE = """select sha1(lower(trim(url)))[:16] as key, arg_max(url, cached_at) as url, 'Place ' || arg_max(supplier, cached_at) as name,
    case arg_max(supplier, cached_at) % 3 when 0 then 'São Paulo' when 1 then 'Belém' end as city, max(cached_at) as cached_at, 604800 as ttl_s
    from (select url, max(supplier) as supplier, cached_at from @place_writes group by url, cached_at) w group by url"""


def _cards_with_city(spark, sf):
    jobs = derived(spark, sf, "supplier_jobs").select("job_id", c("city").alias("search_city"))
    return dedup.dedup_urls(derived(spark, sf, "cards", heavy=True)).join(jobs, "job_id")


_CARD_CITY = f"select f.*, s.city as search_city, sha1(lower(trim(url)))[:16] as key from ({SQL_FIRST_CARD}) f join @supplier_jobs s using (job_id)"
_CACHE_CTES = [("place_cache", SQL_PLACE_CACHE), ("carded", _CARD_CITY)]


def _cache_hits(spark, sf):
    hits, _ = lookup.lookup_place_cache(_cards_with_city(spark, sf), _place_cache(spark, sf), NOW)
    return hits.select("job_id", "url", c("lead.name").alias("lead_name"), c("lead.city").alias("lead_city"))


QUERIES["e2_lookup_place_cache_hits"] = _cache_hits
ORACLES["e2_lookup_place_cache_hits"] = oracle(
    f"""select job_id, f.url, p.name as lead_name, p.city as lead_city from carded f join place_cache p using (key)
        where p.cached_at + ttl_s > {NOW_SQL} and {sql_city_matches('p.city', 'search_city')}""", *_CACHE_CTES
)
QUERIES["e2_lookup_place_cache_misses"] = lambda spark, sf: lookup.lookup_place_cache(
    _cards_with_city(spark, sf), cache.expire(_place_cache(spark, sf), NOW + 6 * DAY), NOW + 6 * DAY
)[1].select("job_id", "url")
ORACLES["e2_lookup_place_cache_misses"] = oracle(
    f"""select job_id, f.url from carded f where not exists (select 1 from place_cache p where p.key = f.key
        and p.cached_at + ttl_s > {NOW_SQL} + {6 * DAY})""", *_CACHE_CTES
)


def _result_cache(spark, sf):
    searches = derived(spark, sf, "searches")
    leads = derived(spark, sf, "search_leads").select("search_id", "n", F.struct("name").alias("lead"))
    meta = spark.createDataFrame([], cache_schema(searches))
    entries = leads.select(F.lit("").alias("hash"), "search_id", F.lit(0.0).alias("cached_at"), "n", "lead").where(F.lit(False))
    return cache.put_results(meta, entries, searches, leads)


def cache_schema(_):
    from leadlake.schemas import RESULT_META

    return RESULT_META


_RESULT_CTES = [
    ("written", f"""select {nz.SQL_HASH} as hash, s.*, n_leads as count from @searches s
        join (select search_id, count(*)::int as n_leads from @search_leads group by 1) l using (search_id)"""),
    ("meta", """select * from written qualify row_number() over (partition by hash order by cached_at desc, search_id desc) = 1"""),
]
def _cached_leads(spark, sf, stored=False):
    asked = derived(spark, sf, "searches").select(c("search_id").alias("asked_by"), F.upper("keyword").alias("keyword"), "city", "state", "country")
    tables = _result_cache(spark, sf)
    if stored:
        path = scratch_path(spark, "result-cache")
        sinks.write_result_cache(tables[0], tables[1].select(*RESULT_ENTRY.fieldNames()[:-1], _full_lead()), path, part_chars=1)
        tables = sinks.read_result_cache(spark, path)
    return lookup.lookup_result_cache(asked, *tables, NOW, part_chars=1).select("asked_by", "n", c("lead.name").alias("lead_name"))


def _full_lead():
    kinds = RESULT_ENTRY["lead"].dataType
    return F.struct(c("lead.name").alias("name"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields[1:]]).alias("lead")


QUERIES["e3_lookup_result_cache"] = _cached_leads
# The same lookups over the stored cache, parts pruned by the searches.
QUERIES["e3_lookup_stored_cache"] = lambda spark, sf: _cached_leads(spark, sf, stored=True)
ORACLES["e3_lookup_result_cache"] = oracle(
    f"""select a.search_id as asked_by, n, name as lead_name from (select search_id, {nz.SQL_HASH} as hash from @searches) a
        join meta m on a.hash = m.hash join @search_leads l on l.search_id = m.search_id where cached_at + 604800 > {NOW_SQL}""",
    *_RESULT_CTES,
)
ORACLES["e3_lookup_stored_cache"] = ORACLES["e3_lookup_result_cache"]

QUERIES["e4_flag_new_leads"] = lambda spark, sf: lookup.flag_new_leads(
    derived(spark, sf, "leads", heavy=True), derived(spark, sf, "known_leads"), ["name", "city"]).select("job_id", "n", "is_new")
ORACLES["e4_flag_new_leads"] = oracle(
    "select job_id, n, k.name is null as is_new from @leads l left join @known_leads k on l.name = k.name and l.city = k.city"
)

SQL_REPLY = "coalesce(case when http_status = 200 then json_extract_string(body, '$.status') end, 'running')"
QUERIES["e5_reported_status"] = lambda spark, sf: derived(spark, sf, "status_replies").select(
    "reply_id", lookup.reported_status(c("http_status"), c("body")).alias("status"))
ORACLES["e5_reported_status"] = oracle(f"select reply_id, {SQL_REPLY} as status from @status_replies")
QUERIES["e5_effective_status"] = lambda spark, sf: lookup.effective_status(
    derived(spark, sf, "jobs"), derived(spark, sf, "status_events"))
ORACLES["e5_effective_status"] = oracle(
    """select job_id, coalesce(status, 'running') as status from @jobs
       left join (select job_id, arg_max(status, ts) as status from @status_events group by 1) s using (job_id)"""
)
SQL_CONTROL = """select job_id, n, ts,
      case when ts > cancel_ts or (before = 'paused' and after = 'cancelled') then 'dropped'
           when before = 'paused' and after is null then 'held' else 'delivered' end as disposition,
      case when not coalesce(ts > cancel_ts or (before = 'paused' and after = 'cancelled'), false)
           then case when before = 'paused' then after_ts else ts end end as release_ts
    from (select l.*, b.status as before, a.status as after, a.ts as after_ts,
                 (select min(ts) from @status_events s where s.job_id = l.job_id and status = 'cancelled') as cancel_ts
          from @timed_leads l
          asof left join @status_events b on l.job_id = b.job_id and l.ts > b.ts
          asof left join (select * from @status_events where status <> 'paused') a on l.job_id = a.job_id and l.ts <= a.ts) t"""
QUERIES["e5_apply_job_control"] = lambda spark, sf: lookup.apply_job_control(
    derived(spark, sf, "timed_leads"), derived(spark, sf, "status_events"))
ORACLES["e5_apply_job_control"] = oracle(SQL_CONTROL)

DERIVED["enrich_queue"] = "select 'lead-' || cast(o_orderkey as string) as lead_id, o_orderkey as pos from @orders where o_orderstatus <> 'P'"
DERIVED["enriched"] = "select distinct 'lead-' || cast(l_orderkey as string) as lead_id from @lineitem where l_returnflag = 'R'"
DERIVED["pause_flag"] = "select r_name = 'PAUSED' as paused from @region"
QUERIES["e6_enrichment_worklist"] = lambda spark, sf: lookup.enrichment_worklist(
    *(derived(spark, sf, t) for t in ("enrich_queue", "enriched", "pause_flag")))
ORACLES["e6_enrichment_worklist"] = oracle(
    """select lead_id, pos from @enrich_queue q where not exists (select 1 from @enriched e where e.lead_id = q.lead_id)
       and not (select coalesce(bool_or(paused), false) from @pause_flag) order by pos"""
)

# The index knows every search ever written; metadata exists only for those with leads.
_INDEX = f"select {nz.SQL_HASH} as hash, max(cached_at) as updated_at from @searches group by 1"


def _index(spark, sf):
    hashed = lookup.with_search_hash(derived(spark, sf, "searches"))
    return hashed.groupBy("hash").agg(F.max("cached_at").alias("updated_at"))


QUERIES["e7_prune_cache_index"] = lambda spark, sf: lookup.prune_cache_index(
    _index(spark, sf), _result_cache(spark, sf)[0], NOW)[0]
ORACLES["e7_prune_cache_index"] = oracle(
    f"select hash, updated_at from idx where hash in (select hash from meta where cached_at + 604800 > {NOW_SQL})",
    ("idx", _INDEX), *_RESULT_CTES,
)
QUERIES["e7_pruned_count"] = lambda spark, sf: lookup.prune_cache_index(_index(spark, sf), _result_cache(spark, sf)[0], NOW)[1]
ORACLES["e7_pruned_count"] = oracle(
    f"select count(*) as removed from idx where hash not in (select hash from meta where cached_at + 604800 > {NOW_SQL})",
    ("idx", _INDEX), *_RESULT_CTES,
)

# --- G ---------------------------------------------------------------------------------------


def _capped(largest=None):
    def query(spark, sf):
        jobs = derived(spark, sf, "jobs").select("job_id", "max_results")
        return limits.cap_by_jobs(derived(spark, sf, "places"), jobs, largest=largest).select("job_id", "n", "max_results")

    return query


QUERIES["g1_cap_per_job"] = _capped()
ORACLES["g1_cap_per_job"] = oracle(
    """select job_id, n, max_results from @places join @jobs using (job_id)
       qualify row_number() over (partition by job_id order by n) <= max_results"""
)
# The same caps by slot-wise ranks, the way taken when a job may ask for very many rows.
QUERIES["g1_cap_per_job_large_limits"] = _capped(largest=limits.GROUP_LIMIT + 1)
ORACLES["g1_cap_per_job_large_limits"] = ORACLES["g1_cap_per_job"]

QUERIES["g2_stale_entries"] = lambda spark, sf: limits.stale_entries(
    _index(spark, sf), _result_cache(spark, sf)[0], NOW, 3 * DAY).select("hash", "updated_at", "keyword", "city", "count")
ORACLES["g2_stale_entries"] = oracle(
    f"""select hash, updated_at, keyword, city, count from (select * from idx where updated_at <= {NOW_SQL} - {3 * DAY}
        order by updated_at, hash limit 50) i join meta using (hash)""",
    ("idx", _INDEX), *_RESULT_CTES,
)

# --- H ---------------------------------------------------------------------------------------

QUERIES["h1_put_places"] = lambda spark, sf: _place_cache(spark, sf).select("key", "url", "lead.name", "lead.city", "cached_at", "ttl_s")
ORACLES["h1_put_places"] = oracle("select * from place_cache", _CACHE_CTES[0])
QUERIES["h2_invalidate_places"] = lambda spark, sf: cache.invalidate_places(
    _place_cache(spark, sf),
    derived(spark, sf, "part").where("p_size < 25").select(F.concat(F.lit("https://www.google.com/maps/place/P"), c("p_partkey")).alias("url")),
).select("key", "url")
ORACLES["h2_invalidate_places"] = oracle(
    """select key, url from place_cache where key not in
       (select sha1(lower('https://www.google.com/maps/place/P' || p_partkey))[:16] from @part where p_size < 25)""", _CACHE_CTES[0]
)
_META_SHOWN = ["hash", "search_id", "keyword", "city", "state", "country", "max_results", "count", "ttl_s"]
QUERIES["h3_put_results"] = lambda spark, sf: _result_cache(spark, sf)[0].select(
    *_META_SHOWN, F.round("cached_at", 3).alias("cached_at"), F.left("cached_iso", F.lit(19)).alias("cached_second"))
ORACLES["h3_put_results"] = oracle(
    f"""select {', '.join(_META_SHOWN[:-1])}, 604800 as ttl_s, round(cached_at, 3) as cached_at,
        strftime(make_timestamp(trunc(cached_at * 1000000)::bigint), '%Y-%m-%dT%H:%M:%S') as cached_second from meta""", *_RESULT_CTES
)
QUERIES["h3_put_results_entries"] = lambda spark, sf: _result_cache(spark, sf)[1].select("hash", "search_id", "n", "lead.name")
ORACLES["h3_put_results_entries"] = oracle(
    "select hash, search_id, n, name from meta join @search_leads using (search_id)", *_RESULT_CTES
)
QUERIES["h4_expire"] = lambda spark, sf: cache.expire(_place_cache(spark, sf), NOW + DAY).select("key", "cached_at")
ORACLES["h4_expire"] = oracle(f"select key, cached_at from place_cache where cached_at + ttl_s > {NOW_SQL} + {DAY}", _CACHE_CTES[0])
QUERIES["h5_cache_meta"] = lambda spark, sf: cache.cache_meta(
    derived(spark, sf, "searches"), _result_cache(spark, sf)[0], NOW).select("asked_by", "hash", "search_id", "count", "max_results")
ORACLES["h5_cache_meta"] = oracle(
    f"""select a.search_id as asked_by, hash, m.search_id, m.count, m.max_results
        from (select search_id, {nz.SQL_HASH} as hash from @searches) a join meta m using (hash) where m.cached_at + 604800 > {NOW_SQL}""",
    *_RESULT_CTES,
)


def _stored(spark, sf):
    """Both cache tables committed as one version, split by hash prefix, and read back."""
    path = scratch_path(spark, "result-cache")
    meta, entries = _result_cache(spark, sf)
    sinks.write_result_cache(meta, entries.select(*RESULT_ENTRY.fieldNames()[:-1], _full_lead()), path, part_chars=1)
    back = sinks.read_result_cache(spark, path)[1]
    return back.groupBy("hash").agg(F.count(F.lit(1)).alias("leads"), F.min("n").alias("first_n"), F.max("lead.name").alias("last_name"))


QUERIES["a8_result_cache_table"] = _stored
ORACLES["a8_result_cache_table"] = oracle(
    "select hash, count(*) as leads, min(n) as first_n, max(name) as last_name from meta join @search_leads using (search_id) group by 1",
    *_RESULT_CTES,
)
