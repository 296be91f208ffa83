"""Delivery batches, streams, page extraction and whole plans: queries and oracles (I, J, H6)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.text import present
from leadlake.operators import batches, metrics
from leadlake.plans.leads import leads_from_pages
from leadlake.plans.refresh import refresh_cycle, refresh_stored
from leadlake.schemas import LEAD_COLUMNS, PLACE_TEXTS, RESULT_ENTRY, RESULT_META
from leadlake.session import scratch_path
from leadlake.sources import pages as page_source
from leadlake.sources import sinks
from leadlake.sources.cards import extract_feed_cards
from leadlake.sources.pages import step
from leadlake.streaming import leads as stream
from leadlake.streaming import progress
from workload import diagnose as dg
from workload import lookups as lk
from workload import normalise as nz
from workload.aggregates import _COUNTERS, _ENRICH, _METRIC_CTES, _RATES, greedy
from workload.inputs import DERIVED, NOW, NOW_SQL, derived, oracle, table

c = F.col
QUERIES, ORACLES = {}, {}

# --- I1: delivery batches --------------------------------------------------------------------

# The job starts with one delivery; then each arriving lead decides.
_FLUSH = [
    ("arrived", "select job_id, n, arrival_s as t, row_number() over (partition by job_id order by n) as i from @arrivals"),
    ("fold", """select job_id, n, i, 0 as batch_no, 1 as next_no, t as last, 0 as waiting from arrived where i = 1
        union all
        select job_id, n, i, next_no, case when due then next_no + 1 else next_no end, case when due then t else last end, case when due then 0 else waiting + 1 end
        from (select a.job_id, a.n, a.i, a.t, f.next_no, f.last, f.waiting, f.waiting + 1 >= 50 or a.t >= f.last + 3 as due
              from fold f join arrived a on a.job_id = f.job_id and a.i = f.i + 1) s"""),
]


def _flush(block_rows):
    def query(spark, sf):
        return batches.assign_flush_batches(derived(spark, sf, "arrivals"), block_rows=block_rows).select("job_id", "n", "batch_no")

    return query


QUERIES["i1_assign_flush_batches"] = _flush(batches.BLOCK_ROWS)
ORACLES["i1_assign_flush_batches"] = oracle("select job_id, n, batch_no::bigint as batch_no from fold", *_FLUSH, recursive=True)
# The same numbering with every job cut into many blocks.
QUERIES["i1_assign_flush_batches_blocks"] = _flush(120)
ORACLES["i1_assign_flush_batches_blocks"] = ORACLES["i1_assign_flush_batches"]

# --- Streams ---------------------------------------------------------------------------------


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's path itself, a file or a folder of parts (a file stream reads a folder, so a file is named by a glob)."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


def derived_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table of one driver table, as a stream."""
    base = re.search(r"@(\w+)", DERIVED[name]).group(1)
    return derived(spark, sf, name, read=lambda s, d, n: stream_table(s, d, n) if n == base else table(s, d, n))


def finish(query) -> None:
    """Wait for all available data, however long that takes."""
    query.awaitTermination()


def _streamed_leads(spark, sf):
    out = scratch_path(spark, "stream-leads")
    finish(stream.stream_leads(derived_stream(spark, sf, "places"), derived(spark, sf, "jobs"), out, available_now=True))
    return dg.flat_lead(spark.read.parquet(f"{out}/leads"), "job_id", "n")


_ACCEPTED = (
    f"select job_id, n, {dg.SQL_LEAD} from built where name <> '' and confirmed and {dg.sql_city_matches('city', 'search_city')} "
    "qualify row_number() over (partition by job_id order by n) <= max_results"
)
# A stream visits the first places of each job.
_FED = [("placed", f"select * from ({nz.PLACED}) p qualify row_number() over (partition by job_id order by n) <= max_results"), dg.CTES[1]]
QUERIES["i2_stream_leads"] = _streamed_leads
ORACLES["i2_stream_leads"] = oracle(
    "select f.* from found f join walk using (job_id, n) where kept", *_FED, ("found", _ACCEPTED), *greedy("found"), recursive=True
)


def _hooked(spark, sf):
    out = scratch_path(spark, "stream-hook")
    hook = lambda leads, epoch: leads.select("job_id", "n", "name").write.mode("overwrite").parquet(f"{out}/hook/epoch={epoch}")
    finish(stream.stream_leads(derived_stream(spark, sf, "places"), derived(spark, sf, "jobs"), out, on_leads=hook, available_now=True))
    return spark.read.parquet(f"{out}/hook").drop("epoch")


QUERIES["j1_on_lead_hook"] = _hooked
ORACLES["j1_on_lead_hook"] = oracle(
    "select f.job_id, f.n, f.name from found f join walk using (job_id, n) where kept", *_FED, ("found", _ACCEPTED), *greedy("found"),
    recursive=True,
)


def _progress(spark, sf):
    out = scratch_path(spark, "stream-progress")
    live = progress.live_progress(derived_stream(spark, sf, "places"), derived(spark, sf, "jobs"))
    finish(progress.write_updates(live, out, available_now=True))
    return progress.latest_updates(progress.read_updates(spark, out))


QUERIES["i3_live_progress"] = _progress
ORACLES["i3_live_progress"] = oracle(
    """select job_id, n, least(99, trunc(n::double / max_results * 100)::int) as pct,
        case when name = '' then 'Extraindo contatos… (' || n || '/' || max_results || ')'
          else 'Extraindo contatos: ' || case when length(name) > 28 then name[:28] || '…' else name end || ' (' || n || '/' || max_results || ')' end as msg
       from (select job_id, count(*)::int as n, arg_max(name, n) as name from @places group by job_id) p join @jobs using (job_id)"""
)


def _live_metrics(spark, sf):
    out = scratch_path(spark, "stream-metrics")
    live = progress.live_job_metrics(derived_stream(spark, sf, "job_events"))
    finish(progress.write_updates(live, out, available_now=True))
    return progress.latest_updates(progress.read_updates(spark, out)).select("job_id", *_COUNTERS, *_ENRICH, *_RATES)


QUERIES["i4_live_job_metrics"] = _live_metrics
ORACLES["i4_live_job_metrics"] = oracle(f"select job_id, {', '.join([*_COUNTERS, *_ENRICH, *_RATES])} from rates", *_METRIC_CTES)

DERIVED["control_events"] = """
    select 'job-' || cast(user_id as string) as job_id, event_id as n, EPOCH_US(ts) as ts,
           case when event_type = 'signup' then 'paused' when event_type <> 'error' then null
             when event_id % 40 = 7 then 'cancelled' else 'running' end as status
    from @events"""


def _controlled(spark, sf):
    out = scratch_path(spark, "stream-control")
    events = derived_stream(spark, sf, "control_events")
    clock = spark.createDataFrame([], events.schema)
    clock.write.parquet(f"{out}/clock")
    ticks = spark.readStream.schema(events.schema).parquet(f"{out}/clock")
    finish(stream.stream_control(events.unionByName(ticks), out, available_now=True))
    # The end of the log: an event of no job moves the watermark past the last events.
    last = derived(spark, sf, "control_events").agg((F.max("ts") + 86_400_000_000).alias("ts"))
    last.select(*[c(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(f"{out}/clock")
    finish(stream.stream_control(events.unionByName(ticks), out, available_now=True))
    return spark.read.parquet(f"{out}/delivered").select("job_id", "n", "ts", "release_ts")


QUERIES["i6_stream_control"] = _controlled
ORACLES["i6_stream_control"] = oracle(
    "select job_id, n, ts, release_ts from control where disposition = 'delivered'", ("control", lk.SQL_CONTROL)
)

# --- J2 and the plans over pages ---------------------------------------------------------------


def place_pages(spark, sf):
    """Saved place pages with the raw texts of the derived places, as the map service lays them out."""
    def when_any(text, *parts):
        return F.when(present(text), F.concat(*parts)).otherwise("")

    def lit(text):
        return F.lit(text)

    places = derived(spark, sf, "places", heavy=True)
    images = F.array_join(F.transform("photos", lambda p: F.concat(lit('<img alt="" src="'), p, lit('">'))), "")
    links = F.array_join(F.transform("instagram_links", lambda h: F.concat(lit('<a href="'), h, lit('">perfil</a>'))), "")
    spans = F.array_join(
        F.transform(F.array(c("rating_raw"), c("rating_spans")[1], c("rating_spans")[2]),
                    lambda s: F.concat(lit('<span aria-hidden="true">'), s, lit("</span>"))), "")
    html = F.concat(
        lit('<!DOCTYPE html><html><head><title>Mapa</title><script>var h1 = "<h1>";</script></head><body>'),
        lit('<div role="feed"><img src="https://lh5.googleusercontent.com/p/photo-inside-the-feed"></div><div role="main">'),
        lit('<div class="x RZ66Rb">'), images, lit("</div>"),
        lit('<h1 class="DUwDvf lfPIob"> '), c("name"), lit("</h1>"),
        lit('<div class="F7nice">'), spans, lit("</div>"),
        when_any(c("review_labels")[1], lit('<button aria-label="'), c("review_labels")[1], lit('">i</button>')),
        when_any(c("category_raw"), lit('<button class="DkEaL">'), c("category_raw"), lit("</button>")),
        when_any(c("address"), lit('<button data-item-id="address"><div><div class="Io6YTe fontBodyMedium">'), c("address"), lit("</div></div></button>")),
        when_any(c("phone_raw"), lit('<button data-item-id="phone:tel:11"><div class="Io6YTe">'), c("phone_raw"), lit("</div></button>")),
        when_any(c("site_href"), lit('<a data-item-id="authority" href="'), c("site_href"), lit('"><div class="Io6YTe">site</div></a>')),
        links,
        when_any(c("hours_raw"), lit('<div data-item-id="oh"><span class="Io6YTe">'), c("hours_raw"), lit("</span></div>")),
        lit("<p>fim<br></div></body></html>"),
    )
    return places.select("url", "n", html.alias("html"))


def _joined(name):
    return F.array_join(name, "|").alias(name)


QUERIES["j2_extract_place_fields"] = lambda spark, sf: page_source.place_raw(
    page_source.extract_place_fields(place_pages(spark, sf))
).select(
    "n", "name", "address", "phone_raw", "site_href", "rating_raw", "category_raw", "hours_raw",
    *[_joined(a) for a in ("instagram_links", "review_labels", "rating_spans", "photos")],
)
ORACLES["j2_extract_place_fields"] = oracle(
    """select n, trim(name) as name, trim(address) as address, trim(phone_raw) as phone_raw, trim(site_href) as site_href, rating_raw, category_raw,
        nullif(hours_raw, '') as hours_raw, array_to_string(instagram_links, '|') as instagram_links, review_labels[2] as review_labels,
        rating_raw || '|' || rating_spans[2] || '|' || rating_spans[3] as rating_spans, photos[1] || '|' || photos[2] || '|' || photos[2] as photos
       from @places"""
)

_NOTHING = {field: [] for field in PLACE_TEXTS.fieldNames()}
_GENERIC = {**_NOTHING, "name": [((step("h1"),),)], "site": [((step("a"),),)]}
QUERIES["j2_page_headings"] = lambda spark, sf: page_source.place_raw(
    page_source.extract_place_fields(derived(spark, sf, "pages", heavy=True).select("page_id", "html"), _GENERIC)
).select("page_id", "name", "site_href")
ORACLES["j2_page_headings"] = """
    select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
               regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g'),
               '&#39;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) as name,
           regexp_extract(html, '<a [^>]*href="([^"]+)"', 1) as site_href from pages"""

# Result-list cards of the customers' jobs; two neighbouring orders share one address.
DERIVED["place_cards"] = """
    select 'job-' || cast(o_custkey as string) as job_id, o_orderkey as position,
           'https://www.google.com/maps/place/p' || cast(o_orderkey - o_orderkey % 2 as string) as url,
           'Card ' || cast(o_orderkey as string) as name, case when o_orderkey % 3 = 0 then '' else '4,' || cast(o_orderkey % 10 as string) end as rating,
           cast(o_orderkey % 90 as string) as reviews, case when o_orderkey % 4 = 0 then '' else 'Padaria' end as category
    from @orders"""
# Result pages: the cards of a job as its list shows them, a scroll at a time.
_SCROLL = 400


def result_pages(spark, sf):
    card = F.concat(
        F.lit('<div class="Nv2PK" jsaction="mouse:card"><a class="hfpxzc" href="'), c("url"), F.lit('"></a><div class="qBF1Pd fontHeadlineSmall"> '), c("name"),
        F.lit('</div><span class="MW4etd">'), c("rating"), F.lit('</span><span class="UY7F9">('), c("reviews"),
        F.lit(')</span><div class="W4Efsd"><div class="W4Efsd"><span>aberto</span><span><span>· '), c("category"), F.lit("</span><span>rua</span></span></div></div></div>"))
    cards = derived(spark, sf, "place_cards", heavy=True).select("job_id", F.floor(c("position") / _SCROLL).alias("scroll_no"), "position", card.alias("card"))
    lists = cards.groupBy("job_id", "scroll_no").agg(F.sort_array(F.collect_list(F.struct("position", "card"))).alias("cards"))
    html = F.concat(F.lit('<html><body><div role="feed">'), F.array_join("cards.card", "<hr>"), F.lit("</div></body></html>"))
    return lists.select("job_id", "scroll_no", html.alias("html"))


QUERIES["a4_extract_feed_cards"] = lambda spark, sf: extract_feed_cards(result_pages(spark, sf), keep=["job_id", "scroll_no"], url=None)
ORACLES["a4_extract_feed_cards"] = oracle(
    f"""select job_id, scroll_no, row_number() over (partition by job_id, scroll_no order by position) - 1 as position, url as link, name, rating, reviews, category
       from (select *, position // {_SCROLL} as scroll_no from @place_cards) s""")

_FOUND = f"""
    select b.job_id, b.n, {', '.join('l.' + x for x in ['name', 'address', 'neighborhood', 'city', 'state', 'phone', 'website', 'instagram'])},
           l.score, l.digital_status, l.hours, l.photo_url, l.digital_maturity_score, l.status, l.source, l.tags, l.suggested_services,
           case when l.category = {nz.sql_title('b.keyword')} and card_category <> '' then card_category else l.category end as category,
           case when coalesce(l.rating, 0) = 0 then coalesce(try_cast(replace(card_rating, ',', '.') as double), l.rating) else l.rating end as rating,
           case when l.review_count = 0 then coalesce(try_cast(card_reviews as int), 0) else l.review_count end as review_count
    from built b join placed p using (job_id, n) join (select job_id, n, {dg.SQL_LEAD} from built) l using (job_id, n)
    where b.name <> '' and b.confirmed and {dg.sql_city_matches('b.city', 'b.search_city')}
    qualify row_number() over (partition by b.job_id order by b.n) <= b.max_results"""


def _page_ctes(jobs):
    """CTEs from cards to found leads for the jobs of a CTE or derived table."""
    visits = f"""select job_id, url, min(position) as position, arg_min(rating, position) as card_rating, arg_min(reviews, position) as card_reviews,
            arg_min(category, position) as card_category
        from (select k.*, row_number() over (partition by job_id order by position) as seen, max_results from @place_cards k join {jobs} using (job_id)) s
        where seen <= max_results group by job_id, url"""
    placed = f"""select v.job_id, v.position as n, v.url, v.card_rating, v.card_reviews, v.card_category, p.* exclude (job_id, n, url), keyword,
            j.city as search_city, j.state as search_state, country, max_results
        from visits v join @places p on p.url = v.url join {jobs} j on j.job_id = v.job_id"""
    return [("visits", visits), ("placed", placed), ("built", dg.BUILT), ("found", _FOUND)]


def pages_of(spark, sf):
    return place_pages(spark, sf).select("url", "html")


QUERIES["j3_leads_from_pages"] = lambda spark, sf: dg.flat_lead(
    leads_from_pages(derived(spark, sf, "jobs"), derived(spark, sf, "place_cards"), pages_of(spark, sf)), "job_id", "n")
ORACLES["j3_leads_from_pages"] = oracle(
    "select f.* from found f join walk using (job_id, n) where kept", *_page_ctes("@jobs"), *greedy("found"), recursive=True
)



def _streamed_pages(spark, sf):
    """The same plan as a stream of captured pages, one per card."""
    out = scratch_path(spark, "stream-pages")
    cards = derived_stream(spark, sf, "place_cards").withColumnRenamed("position", "n")
    # Merged, which deals cards and pages out by address: the tables look small enough to be broadcast while the texts of their pages are not.
    finish(stream.stream_page_leads(cards.join(pages_of(spark, sf).hint("merge"), "url", "left"), derived(spark, sf, "jobs"), out, available_now=True))
    return dg.flat_lead(spark.read.parquet(f"{out}/leads"), "job_id", "n")


QUERIES["i2_stream_page_leads"] = _streamed_pages
ORACLES["i2_stream_page_leads"] = ORACLES["j3_leads_from_pages"]

# --- H6: refresh of stale searches -------------------------------------------------------------

# The cached state before the refresh: every customer's search with its old lead count.
DERIVED["cached_searches"] = f"""
    select 'job-' || cast(c_custkey as string) as search_id, lower(c_mktsegment) || ' d''oeste' as keyword, city, state, country, max_results,
           {NOW_SQL} - (c_custkey * 7919) % 1000000 - cast(c_custkey as double) / 1024 as cached_at
    from @customer join @jobs on job_id = 'job-' || cast(c_custkey as string)"""
DERIVED["cached_leads"] = """
    select 'job-' || cast(o_custkey as string) as search_id, o_orderkey as n, 'Antigo ' || cast(o_orderkey as string) as name
    from @orders where o_orderstatus = 'F'"""


def _refreshed(spark, sf, stored=False):
    from leadlake.operators.cache import put_results

    old = derived(spark, sf, "cached_leads").select("search_id", "n", F.struct(
        "name", *[F.lit(None).cast(RESULT_ENTRY["lead"].dataType[x].dataType).alias(x) for x in LEAD_COLUMNS[1:]]).alias("lead"))
    meta, entries = put_results(
        spark.createDataFrame([], RESULT_META), spark.createDataFrame([], RESULT_ENTRY), derived(spark, sf, "cached_searches"), old)
    # The job of a refresh is the search's hash.
    cards = derived(spark, sf, "place_cards").join(meta.select("hash", c("search_id").alias("job_id")), "job_id").drop("job_id").withColumnRenamed("hash", "job_id")
    if stored:
        path = scratch_path(spark, "refreshed-cache")
        sinks.write_result_cache(meta, entries, path, part_chars=1)
        refresh_stored(spark, path, cards, pages_of(spark, sf), NOW, 2 * lk.DAY, part_chars=1)
        new_meta, new_entries = sinks.read_result_cache(spark, path)
    else:
        new_meta, new_entries = refresh_cycle(meta, entries, cards, pages_of(spark, sf), NOW, 2 * lk.DAY)
    return new_entries.join(new_meta.select("hash", "search_id", "count"), ["hash", "search_id"]).select(
        "hash", "search_id", "n", "lead.name", "count", F.round("cached_at", 3).alias("cached_at"))


_STORED = [
    ("stored", f"""select {nz.SQL_HASH} as hash, s.*, cnt as count from @cached_searches s
        join (select search_id, count(*)::int as cnt from @cached_leads group by 1) l using (search_id)
        qualify row_number() over (partition by {nz.SQL_HASH} order by cached_at desc, search_id desc) = 1"""),
    ("stale", f"select *, search_id as job_id from (select * from stored where cached_at <= {NOW_SQL} - {2 * lk.DAY} order by cached_at, hash limit 50) s"),
    # As a job, an absent limit means 20.
    ("requests", "select * exclude (max_results), case when max_results = 0 then 20 else max_results end as max_results from stale"),
]
QUERIES["h6_refresh_cycle"] = _refreshed
ORACLES["h6_refresh_cycle"] = oracle(
    f"""select hash, search_id, n, name, cnt as count, round({NOW_SQL}, 3) as cached_at from renewed join stored using (search_id)
        union all
        select hash, search_id, n, name, count, round(cached_at, 3) from stored join @cached_leads using (search_id)
        where search_id not in (select search_id from renewed)""",
    *_STORED, *_page_ctes("requests"),
    ("renewed", "select job_id as search_id, n, name, (count(*) over (partition by job_id))::int as cnt from found"),
)
# The same refresh as one commit over the stored cache, read back.
QUERIES["h6_refresh_stored"] = lambda spark, sf: _refreshed(spark, sf, stored=True)
ORACLES["h6_refresh_stored"] = ORACLES["h6_refresh_cycle"]
