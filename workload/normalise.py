"""Sources, sinks and field clean-up: queries and oracles (A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import fields as fx
from leadlake.functions import search as sx
from leadlake.functions import text as tx
from leadlake.session import scratch_path
from leadlake.sources import jobs as job_source
from leadlake.sources import pages as page_source
from leadlake.sources import sinks
from workload.inputs import BASE, DERIVED, derived, oracle, table

c = F.col

# DuckDB spellings of shared steps, for the oracles only.
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_norm(x: str) -> str:
    return f"coalesce(strip_accents(trim(lower({x}), {WS})), '')"


def sql_ascii(x: str) -> str:
    return f"trim(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), {WS})"


def sql_title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[\\p{{L}}]+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def sql_phone_key(x: str) -> str:
    d = f"regexp_replace(coalesce({x}, ''), '\\D', '', 'g')"
    return f"case when length({d}) >= 12 and starts_with({d}, '55') then {d}[3:] else {d} end"


SQL_CLEAN_PHONE = "coalesce(trim(regexp_replace(phone_raw, '[^\\d\\s()+-]', '', 'g'))[:20], '')"
SQL_SITE = (
    "nullif(split_part(regexp_replace(regexp_replace(site_href, '^https?://', ''), '/+$', ''), '?', 1), '')"
)
SQL_INSTAGRAM = (
    "regexp_replace(split_part(list_filter(instagram_links, lambda h: contains(h, 'instagram.com') and "
    "regexp_replace(h, '/+$', '') <> 'https://www.instagram.com')[1], '?', 1), '/+$', '')"
)
_RATING_VALUE = "try_cast(replace(regexp_extract(rating_raw, '([\\d,]+)', 1), ',', '.') as double)"
SQL_RATING = f"case when {_RATING_VALUE} <= 5 then {_RATING_VALUE} end"
SQL_LABEL_COUNT = (
    "coalesce(list_filter(list_transform(review_labels, lambda l: try_cast(regexp_replace(case "
    "when regexp_matches(lower(l), '[\\d.]+\\s*avaliaç') then regexp_extract(lower(l), '([\\d.]+)\\s*avaliaç', 1) "
    "when regexp_matches(lower(l), '[\\d,]+\\s*review') then regexp_extract(lower(l), '([\\d,]+)\\s*review', 1) end, "
    "'\\D', '', 'g') as int)), lambda v: v is not null)[1], 0)"
)
SQL_SPAN_COUNT = (
    "coalesce(list_filter(list_transform(rating_spans, lambda s: case when not contains(s, ',') then "
    "try_cast(regexp_replace(s, '\\D', '', 'g') as int) end), lambda v: v > 0)[1], 0)"
)
SQL_REVIEWS = f"case when {SQL_LABEL_COUNT} <> 0 then {SQL_LABEL_COUNT} else {SQL_SPAN_COUNT} end"
SQL_HOURS = "nullif(split_part(trim(hours_raw), chr(10), 1)[:60], '')"
SQL_PHOTO = (
    "regexp_replace(list_filter(photos, lambda p: (contains(p, 'googleusercontent') or contains(p, 'ggpht')) "
    "and length(p) > 30)[1], '=w\\d+.*$', '=w400-h300-k-no')"
)
_UFS = "', '".join(fx.BR_STATES)
_PAIR = "[,\\-–]\\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\\s''\\-.]{1,38}?)\\s*[,\\-–]\\s*([A-Z]{2})\\b"
SQL_PAIRS = (
    f"list_filter(list_zip(regexp_extract_all(address, '{_PAIR}', 1), regexp_extract_all(address, '{_PAIR}', 2)), "
    f"lambda p: p[2] in ('{_UFS}') and length(trim(p[1])) between 2 and 40)"
)
_BR_PAIR = f"case when country = 'BR' and address <> '' then {SQL_PAIRS}[-1] end"
SQL_CITY = f"coalesce(trim(({_BR_PAIR})[1]), search_city)"
SQL_STATE = f"coalesce(({_BR_PAIR})[2], nullif(search_state, ''), case when country = 'BR' then 'SP' else '' end)"
_PART = "-\\s*([^,\\-]+)(?:,|\\s*-)"
SQL_NEIGHBORHOOD = (
    f"case when regexp_matches(address, '{_PART}') then trim(regexp_extract(address, '{_PART}', 1)) end"
)
SQL_CONFIRMED = (
    f"case when coalesce(address, '') = '' then true when country = 'BR' then len({SQL_PAIRS}) > 0 or "
    f"({sql_ascii('address')} <> '' and contains({sql_ascii('address')}, {sql_ascii('search_city')})) else false end"
)
# A place with the parameters of its search.
PLACED = (
    "select p.*, keyword, j.city as search_city, j.state as search_state, country, max_results "
    "from @places p join @jobs j using (job_id)"
)


def placed(spark, sf):
    jobs = derived(spark, sf, "jobs").select(
        "job_id", "keyword", c("city").alias("search_city"), c("state").alias("search_state"), "country", "max_results"
    )
    return derived(spark, sf, "places", heavy=True).join(jobs, "job_id")


QUERIES, ORACLES = {}, {}


def projection(name, source, keys, build, oracle_columns, extra=()):
    """Register a query that adds columns to a derived table, with its oracle."""
    def query(spark, sf):
        rows = placed(spark, sf) if source == "placed" else derived(spark, sf, source, heavy=source in ("places", "documents"))
        return rows.select(*keys, *[col.alias(alias) for alias, col in build().items()])

    QUERIES[name] = query
    shown = ", ".join([*keys, *(f"{sql} as {alias}" for alias, sql in oracle_columns.items())])
    ORACLES[name] = oracle(
        f"select {shown} from {'placed' if source == 'placed' else '@' + source}",
        *([("placed", PLACED)] if source == "placed" else []), *extra,
    )


# --- A: sources and sinks -------------------------------------------------------------------

JOB_SQL = """select job_id, search_id, coalesce(keyword, '') as keyword, coalesce(city, '') as city, coalesce(state, '') as state,
    coalesce(country, 'BR') as country, coalesce(nullif(try_cast(max_results as int), 0), 20) as max_results
    from {source} where coalesce(job_id, '') <> ''"""
QUERIES["a1_read_search_jobs"] = lambda spark, sf: job_source.search_jobs(derived(spark, sf, "job_records"))
ORACLES["a1_read_search_jobs"] = oracle(JOB_SQL.format(source="@job_records"))

# Envelopes of the job records: jobs, pings, empty payloads and cut-off texts.
DERIVED["messages"] = """
    select c_custkey as message_id,
           case c_custkey % 7 when 0 then '{"type":"ping"}' when 1 then '{"type":"job"}'
             when 2 then '{"type":"job","payload":{"job_id":"job-' || cast(c_custkey as string)
             else '{"type":"' || case when c_custkey % 7 = 3 then 'note' else 'job' end || '","payload":{"job_id":"job-'
               || cast(c_custkey as string) || '","keyword":"' || lower(c_mktsegment) || '","max_results":'
               || cast(c_custkey % 30 as string) || '}}' end as message
    from @customer"""
QUERIES["a2_route_job_messages"] = lambda spark, sf: job_source.route_job_messages(derived(spark, sf, "messages"))
ORACLES["a2_route_job_messages"] = oracle(
    JOB_SQL.format(source="routed"),
    ("routed", """select job_id, null::varchar as search_id, keyword, null::varchar as city, null::varchar as state, null::varchar as country, max_results from (
        select json_extract_string(message, '$.payload.job_id') as job_id, json_extract_string(message, '$.payload.keyword') as keyword,
               json_extract_string(message, '$.payload.max_results') as max_results, json_extract_string(message, '$.type') as type
        from @messages where json_valid(message)) m where type = 'job'"""),
)

QUERIES["a3_read_captured_pages"] = lambda spark, sf: page_source.read_captured_pages(
    spark, f"{sf}/pages.parquet", schema=table(spark, sf, "pages").schema
).select("url", F.length("html").alias("html_chars"), F.sha1(F.encode("html", "UTF-8")).alias("html_sha1"))
ORACLES["a3_read_captured_pages"] = "select url, length(html) as html_chars, sha1(html) as html_sha1 from pages"

QUERIES["a4_extract_place_links"] = lambda spark, sf: page_source.extract_place_links(table(spark, sf, "pages"), pattern="/")
ORACLES["a4_extract_place_links"] = """
    select url, unnest(range(len(links)))::int as position, unnest(links) as link from (
        select url, list_filter(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda h: replace(h, '&amp;', '&')),
                                lambda h: contains(h, '/')) as links from pages) p"""

DERIVED["lead_batches"] = "select *, cast(floor(n / 2000) as bigint) as batch_id from @leads"
# Keys known before: what the customers of the first market segments bought.
DERIVED["known_leads"] = """
    select distinct name, city from @leads join @orders on n = o_orderkey join @customer on o_custkey = c_custkey
    where c_mktsegment = 'BUILDING' and n_is_even = 1""".replace("and n_is_even = 1", "and o_orderstatus = 'F'")


def _upsert(spark, sf):
    batch = derived(spark, sf, "lead_batches")
    return sinks.upsert_leads(batch, derived(spark, sf, "known_leads"), ["name", "city"])[1]


QUERIES["a5_upsert_leads"] = _upsert
ORACLES["a5_upsert_leads"] = oracle(
    """select job_id, batch_id, count(*) as sent, count(*) filter (where first_time and not known) as new_count from (
        select b.*, row_number() over (partition by b.name, b.city order by b.job_id, b.n) = 1 as first_time, k.name is not null as known
        from @lead_batches b left join @known_leads k on b.name = k.name and b.city = k.city) f group by all"""
)

def _delivered(spark, sf, deliveries=4, fold=3):
    """Leads committed in several deliveries, the second one twice, folded on the way and read back."""
    path = scratch_path(spark, "lead-table")
    batch = derived(spark, sf, "lead_batches")
    for d in [0, 1, 1, *range(2, deliveries)]:
        sinks.store_leads(batch.where(F.pmod("batch_id", F.lit(deliveries)) == d), path, d, ["name", "city"], fold)
    return sinks.read_leads(spark, path, batch.schema).groupBy("job_id", "batch_id").agg(
        F.count(F.lit(1)).alias("leads"), F.min("n").alias("first_n"), F.max("name").alias("last_name"))


QUERIES["a5_store_leads"] = _delivered
ORACLES["a5_store_leads"] = oracle(
    "select job_id, batch_id, count(*) as leads, min(n) as first_n, max(name) as last_name from @lead_batches group by all")

QUERIES["a6_quarantine_rejects"] = lambda spark, sf: sinks.quarantine_rejects(
    derived(spark, sf, "lead_batches"), F.length("phone") >= 16
)[2]
ORACLES["a6_quarantine_rejects"] = oracle(
    """select job_id, batch_id, count(*) filter (where ok) as sent, count(*) filter (where not ok) as errors,
        case when bool_and(ok) then 1 else 0 end::bigint as batches_sent
        from (select *, coalesce(length(phone) >= 16, false) as ok from @lead_batches) b group by all"""
)

def _place_json(spark, sf):
    leads = derived(spark, sf, "leads").withColumn("url", F.concat(F.lit("https://maps/"), c("n").cast("string")))
    cache = leads.select(
        sx.place_key(c("url")).alias("key"), "url", F.struct("name", "city").alias("lead"),
        (F.lit(1.7e9) + c("n")).alias("cached_at"), F.lit(604800).alias("ttl_s"),
    )
    back = sinks.place_cache_from_json(sinks.place_cache_to_json(cache), cache.schema)
    return back.select("key", "url", "lead.name", "lead.city", "cached_at", "ttl_s")


QUERIES["a7_place_cache_table"] = _place_json
ORACLES["a7_place_cache_table"] = oracle(
    """select sha1('https://maps/' || n::varchar)[:16] as key, 'https://maps/' || n::varchar as url, name, city,
        1.7e9 + n as cached_at, 604800 as ttl_s from @leads"""
)


def _endings(spark, sf):
    jobs = derived(spark, sf, "jobs")
    number = F.regexp_extract("job_id", r"(\d+)", 1).cast("int")
    endings = jobs.select(
        "job_id",
        (number % 7 == 2).alias("cancelled"),
        F.when(number % 11 == 4, F.repeat(F.concat(c("keyword"), F.lit(": falhou! ")), 40)).alias("error"),
        (number % 2 == 0).alias("region_exhausted"),
    )
    return sinks.job_outcomes(jobs, derived(spark, sf, "deliveries"), endings)


DERIVED["deliveries"] = """
    select 'job-' || cast(o_custkey as string) as job_id, case when o_orderstatus = 'F' then 2 else 0 end as sent,
           case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 1 else 0 end as new_count
    from @orders"""
QUERIES["a9_job_outcomes"] = _endings
ORACLES["a9_job_outcomes"] = oracle(
    """select job_id, outcome, case when outcome <> 'error' then sent end as count, case when outcome <> 'error' then new end as new_count,
        case when short then true end as region_exhausted, case when short then max_results end as requested, error[:400] as msg
       from (select *, outcome = 'complete' and region_exhausted and sent < max_results as short from (
         select job_id, max_results, coalesce(sent, 0)::bigint as sent, coalesce(new, 0)::bigint as new, error, num % 2 = 0 as region_exhausted,
                case when error is not null then 'error' when num % 7 = 2 then 'cancelled' else 'complete' end as outcome
         from (select job_id, max_results, regexp_extract(job_id, '(\\d+)', 1)::int as num,
                      case when regexp_extract(job_id, '(\\d+)', 1)::int % 11 = 4 then repeat(keyword || ': falhou! ', 40) end as error
               from @jobs) j left join (select job_id, sum(sent) as sent, sum(new_count) as new from @deliveries group by 1) d using (job_id)) o) s"""
)

# --- B: field clean-up ----------------------------------------------------------------------


def text_hash(col):
    return F.sha1(F.encode(col, "UTF-8"))


projection(
    "b01_norm_text", "documents", ["doc_id"],
    lambda: {"norm_sha1": text_hash(tx.norm_text(c("text"))), "norm_chars": F.length(tx.norm_text(c("text")))},
    {"norm_sha1": f"sha1({sql_norm('text')})", "norm_chars": f"length({sql_norm('text')})"},
)
projection(
    "b02_ascii_fold", "documents", ["doc_id"],
    lambda: {"fold_sha1": text_hash(tx.ascii_fold(c("text"))), "fold_chars": F.length(tx.ascii_fold(c("text")))},
    {"fold_sha1": f"sha1({sql_ascii('text')})", "fold_chars": f"length({sql_ascii('text')})"},
)
projection("b03_phone_key", "leads", ["n"], lambda: {"phone_key": tx.phone_key(c("phone"))}, {"phone_key": sql_phone_key("phone")})
projection("b04_clean_phone", "places", ["n"], lambda: {"phone": tx.clean_phone(c("phone_raw"))}, {"phone": SQL_CLEAN_PHONE})
projection(
    "b05_phone_out", "places", ["n"], lambda: {"phone": tx.phone_out(tx.clean_phone(c("phone_raw")))},
    {"phone": f"nullif({SQL_CLEAN_PHONE}, '')"},
)


def _phone_text():
    label = F.when(c("n") % 3 == 0, F.concat(F.lit("Telefone: "), c("phone_raw"))).when(c("n") % 3 == 1, "Sem número")
    return {"phone_text": fx.phone_from_label(F.when(c("n") % 2 == 0, c("phone_raw")), label)}


projection(
    "b06_phone_from_label", "places", ["n"],
    _phone_text,
    {"phone_text": """case when n % 2 = 0 and phone_raw <> '' then phone_raw when n % 3 = 0
        then trim(list_last(string_split('Telefone: ' || phone_raw, ':'))) when n % 3 = 1 then 'Sem número' else '' end"""},
)
projection(
    "b07_first_non_empty", "places", ["n"],
    lambda: {"chosen": fx.first_non_empty(c("category_raw"), F.concat(c("hours_raw"), F.lit(" ")), c("name"))},
    {"chosen": "coalesce(nullif(trim(category_raw), ''), nullif(trim(hours_raw), ''), nullif(trim(name), ''), '')"},
)
_HREFS = "LIST('https://www.google.com/maps', site_href, instagram_links[{first}])"
projection(
    "b08_first_external_href", "places", ["n"],
    lambda: {"href": fx.first_external_href(F.array(F.lit("https://www.google.com/maps"), c("site_href"), c("instagram_links")[0]))},
    {"href": f"""coalesce(trim(list_filter({_HREFS.format(first=1)}, lambda h: h <> '' and not starts_with(h, 'https://www.google'))[1]), '')"""},
)
projection("b09_canonical_site", "places", ["n"], lambda: {"website": fx.canonical_site(c("site_href"))}, {"website": SQL_SITE})
projection("b10_pick_instagram", "places", ["n"], lambda: {"instagram": fx.pick_instagram(c("instagram_links"))}, {"instagram": SQL_INSTAGRAM})
projection("b11_parse_rating", "places", ["n"], lambda: {"rating": fx.parse_rating(c("rating_raw"))}, {"rating": SQL_RATING})
projection("b12_parse_review_count", "places", ["n"], lambda: {"reviews": fx.parse_review_count(c("review_labels"))}, {"reviews": SQL_LABEL_COUNT})
projection(
    "b13_review_count_from_spans", "places", ["n"],
    lambda: {"reviews": fx.review_count_from_spans(fx.parse_review_count(c("review_labels")), c("rating_spans"))},
    {"reviews": SQL_REVIEWS},
)
projection(
    "b14_category_or_keyword", "placed", ["n"], lambda: {"category": fx.category_or_keyword(c("category_raw"), c("keyword"))},
    {"category": f"coalesce(nullif(category_raw, ''), {sql_title('keyword')})"},
)
projection("b15_hours_first_line", "places", ["n"], lambda: {"hours": fx.hours_first_line(c("hours_raw"))}, {"hours": SQL_HOURS})
projection("b16_pick_photo", "places", ["n"], lambda: {"photo_url": fx.pick_photo(c("photos"))}, {"photo_url": SQL_PHOTO})


def _city_state():
    found = fx.parse_city_state(c("address"), c("search_city"), c("search_state"), c("country"))
    return {"city": found["city"], "state": found["state"]}


projection("b17_parse_city_state", "placed", ["n"], _city_state, {"city": SQL_CITY, "state": SQL_STATE})
projection("b18_parse_neighborhood", "placed", ["n"], lambda: {"neighborhood": fx.parse_neighborhood(c("address"))}, {"neighborhood": SQL_NEIGHBORHOOD})
projection(
    "b19_city_confirmed", "placed", ["n"], lambda: {"confirmed": fx.city_confirmed(c("address"), c("search_city"), c("country"))},
    {"confirmed": SQL_CONFIRMED},
)
projection(
    "b20_search_query_url", "job_records", ["search_id"],
    lambda: {"url": sx.search_query_url(c("keyword"), c("city"), c("state"))},
    {"url": "'https://www.google.com/maps/search/' || replace(url_encode(concat_ws(' ', keyword, city, nullif(state, ''))), '%20', '+')"},
)
DERIVED["replies"] = """
    select doc_id, case doc_id % 4 when 0 then text || ' Unusual Traffic from your COMPUTER' when 1 then 'rc-anchor ' || text else text end as text
    from @documents"""
projection("b21_classify_captcha", "replies", ["doc_id"], lambda: {"blocked": sx.classify_captcha(c("text"))},
           {"blocked": " or ".join(f"contains(lower(text), '{m}')" for m in sx.BLOCK_MARKERS)})
projection("b22_place_key", "pages", ["page_id"], lambda: {"place_key": sx.place_key(c("url"))}, {"place_key": "sha1(lower(trim(url)))[:16]"})
SQL_HASH = "sha1(" + " || '|' || ".join(sql_norm(x) for x in ("keyword", "city", "state", "country")) + ")[:16]"
projection(
    "b23_search_hash", "job_records", ["search_id"],
    lambda: {"hash": sx.search_hash(c("keyword"), c("city"), c("state"), c("country"))}, {"hash": SQL_HASH},
)
_LIMIT = "max_results - 3"
SQL_PERCENT = f"case when {_LIMIT} > 0 then trunc(({_LIMIT} + n % 3 - 1)::double / ({_LIMIT}) * 100)::int else 0 end"
projection(
    "b24_progress_pct", "placed", ["n"],
    lambda: {"pct": sx.progress_pct(c("max_results") - 3 + c("n") % 3 - 1, c("max_results") - 3)},
    {"pct": f"least(99, {SQL_PERCENT})"},
)
_PHASES = ["init", "maps_load", "finding", "extracting", "saving", "done", "other"]


def _stage():
    phase = F.element_at(F.array(*[F.lit(p) for p in _PHASES]), (c("n") % 7 + 1).cast("int"))
    name = F.when(c("n") % 5 == 0, "").otherwise(F.concat(c("name"), F.lit(" da Rua das Flores "), c("hours_raw")))
    return {"msg": sx.stage_message((c("n") % 11).cast("int"), c("max_results"), phase, name)}


projection(
    "b25_stage_message", "placed", ["n"], _stage,
    {"msg": """(select case ph when 0 then 'Iniciando navegador…' when 1 then 'Carregando Google Maps…'
        when 2 then case when m = 0 then 'Encontrando empresas…' else 'Encontrando empresas… (' || m || ' locais encontrados)' end
        when 3 then case when full_name = '' then 'Extraindo contatos… (' || m || '/' || max_results || ')'
          else 'Extraindo contatos: ' || case when length(full_name) > 28 then full_name[:28] || '…' else full_name end || ' (' || m || '/' || max_results || ')' end
        when 4 then 'Salvando resultados… (' || m || ' leads)' when 5 then 'Concluído — ' || m || ' leads coletados'
        else case when trunc(m::double / max_results * 100) < 10 then 'Encontrando empresas…'
          when trunc(m::double / max_results * 100) < 85 then 'Extraindo contatos… (' || m || '/' || max_results || ')'
          else 'Coletando locais… (' || m || ' encontrados)' end end
        from (select n % 7 as ph, n % 11 as m, case when n % 5 = 0 then '' else name || ' da Rua das Flores ' || hours_raw end as full_name) s)"""},
)
