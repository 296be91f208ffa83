"""Lead-shaped inputs derived from the driver's tables.

Each text is SQL that Spark and DuckDB both run, so a registered query and its oracle
start from the same rows. ``@name`` refers to a driver table or another derived one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlake.session import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# A fixed "now" (seconds): 2024-01-31.
NOW = 1_706_659_200.0
NOW_SQL = "cast(1706659200 as double)"
CITIES = ["São Paulo", "Rio de Janeiro", "Niterói", "Belém", "Curitiba"]


def _choose(key: str, values: list[str]) -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {key} % {len(values)} {arms} end"


_PHONE_DIGITS = "lpad(cast((o_orderkey * 17 + o_custkey * 7) % 401 as string), 8, '0')"
_RATING = "(o_orderkey % 41 + 10)"
_REVIEWS = "cast((o_orderkey * 13) % 260 as int)"

DERIVED: dict[str, str] = {
    # Leads with colliding names and phones; 40 jobs.
    "leads": f"""
        select 'job-' || cast(o_orderkey % 40 as string) as job_id, o_orderkey as n,
               case when o_orderkey % 3 = 0 then 'Café ' else ' CAFE ' end
                 || cast((o_orderkey * 31 + o_custkey) % 19 as string) as name,
               case when o_orderkey % 2 = 0 then 'São ' else 'sao ' end || n_name as city,
               case o_orderkey % 4 when 0 then null when 1 then '(11) 9' || {_PHONE_DIGITS}
                 else '+55 11 9' || {_PHONE_DIGITS} end as phone
        from @orders join @customer on o_custkey = c_custkey join @nation on c_nationkey = n_nationkey""",
    # What is known about one business.
    "presence": f"""
        select o_orderkey as lead_id,
               case when o_orderkey % 2 = 0 then null else 'site' || cast(o_orderkey % 50 as string) || '.com.br' end as website,
               case when o_orderkey % 3 = 0 then null
                 else 'https://www.instagram.com/loja' || cast(o_orderkey % 60 as string) end as instagram,
               case when o_orderkey % 4 = 0 then null else '(11) 9' || {_PHONE_DIGITS} end as phone,
               case when o_orderkey % 7 = 0 then null when o_orderkey % 97 = 1 then cast(0 as double)
                 else cast({_RATING} as double) / 10 end as rating,
               {_REVIEWS} as review_count,
               case when o_orderkey % 5 = 0 then null else 'Aberto' end as hours
        from @orders""",
    # Raw texts of one captured place; the job is the customer.
    "places": f"""
        select 'job-' || cast(o_custkey as string) as job_id, o_orderkey as n,
               'https://www.google.com/maps/place/p' || cast(o_orderkey as string) as url,
               case when o_orderkey % 29 = 0 then '' else 'Café ' || cast((o_orderkey * 31 + o_custkey) % 19 as string) end as name,
               case when o_orderkey % 11 = 0 then '' else 'Rua das Flores, ' || cast(o_orderkey % 900 as string) || ' - Centro, '
                 || {_choose("o_orderkey", CITIES)} || ' - ' || {_choose("o_orderkey", ["SP", "RJ", "RJ", "PA", "XX"])}
                 || ', 01000-000' end as address,
               case when o_orderkey % 4 = 0 then '' else 'Tel: (11) 9' || {_PHONE_DIGITS} || ' x' end as phone_raw,
               case when o_orderkey % 2 = 0 then '' else 'https://site' || cast(o_orderkey % 50 as string) || '.com.br/'
                 || case when o_orderkey % 5 = 1 then '?utm=1' else '' end end as site_href,
               case when o_orderkey % 3 = 0 then LIST('https://www.instagram.com/')
                 else LIST('https://www.instagram.com/', 'https://www.instagram.com/loja' || cast(o_orderkey % 60 as string) || '/?hl=pt')
                 end as instagram_links,
               case when o_orderkey % 7 = 0 then '' else cast(cast(floor({_RATING} / 10) as int) as string) || ','
                 || cast({_RATING} % 10 as string) end as rating_raw,
               LIST('4,5 estrelas', case o_orderkey % 3 when 0 then '' when 1 then cast({_REVIEWS} as string) || ' avaliações'
                 else '1,' || lpad(cast({_REVIEWS} as string), 3, '0') || ' Reviews' end) as review_labels,
               LIST('4,5', case when o_orderkey % 6 = 0 then '0' else '' end, '1.' || lpad(cast({_REVIEWS} as string), 3, '0')) as rating_spans,
               case when o_orderkey % 9 = 0 then '' else 'Cafeteria' end as category_raw,
               case when o_orderkey % 5 = 0 then '' else ' Aberto até ' || cast(o_orderkey % 24 as string) || 'h\nfecha' end as hours_raw,
               LIST('https://x.y/z.png', case when o_orderkey % 8 = 0 then 'https://lh5.googleusercontent.com/a'
                 else 'https://lh5.googleusercontent.com/p/photo' || cast(o_orderkey as string)
                   || case when o_orderkey % 8 = 1 then '' else '=w80-h92-p-k-no' end end) as photos
        from @orders""".replace("\\n", "\n"),
    # Job records as they arrive: gaps, numbers as text, missing ids.
    "job_records": f"""
        select case when c_custkey % 17 = 16 then '' when c_custkey % 19 = 18 then null else 'job-' || cast(c_custkey as string) end as job_id,
               's-' || cast(c_custkey as string) as search_id,
               case when c_custkey % 13 = 5 then null else lower(c_mktsegment) || ' d''oeste' end as keyword,
               {_choose("c_custkey", ["São Paulo", "rio de janeiro", "Niteroi", "BELÉM", "Curitiba"])} as city,
               case when c_custkey % 3 = 0 then 'SP' when c_custkey % 3 = 1 then '' else null end as state,
               case when c_custkey % 10 = 7 then 'PT' when c_custkey % 10 = 8 then 'BR' else null end as country,
               case when c_custkey % 31 = 3 then null else cast(c_custkey % 30 as string) end as max_results
        from @customer""",
    # The same jobs after the defaults, for the operators that start from clean jobs.
    "jobs": f"""
        select 'job-' || cast(c_custkey as string) as job_id, 's-' || cast(c_custkey as string) as search_id,
               lower(c_mktsegment) || ' d''oeste' as keyword,
               {_choose("c_custkey", ["São Paulo", "rio de janeiro", "Niteroi", "BELÉM", "Curitiba"])} as city,
               case when c_custkey % 3 = 0 then 'SP' else '' end as state,
               case when c_custkey % 10 = 7 then 'PT' else 'BR' end as country,
               cast(c_custkey % 8 + 3 as int) as max_results
        from @customer""",
    # Result-list cards: job = supplier, link = part, in document order.
    "cards": """
        select 'job-' || cast(l_suppkey as string) as job_id, (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey as position,
               'https://www.google.com/maps/place/P' || cast(l_partkey as string) as url,
               case when l_partkey % 5 = 0 then '' else 'Card ' || cast(l_partkey as string) end as name,
               case l_partkey % 4 when 0 then '' when 1 then 'n/a' else '4,' || cast(l_partkey % 10 as string) end as rating,
               case when l_partkey % 3 = 0 then '' else cast(l_partkey % 700 as string) end as reviews,
               case when l_partkey % 7 = 0 then '' else 'Padaria' end as category
        from @lineitem""",
    "supplier_jobs": f"""
        select 'job-' || cast(s_suppkey as string) as job_id, 's-' || cast(s_suppkey as string) as search_id,
               {_choose("s_suppkey", ["padaria", "o''neil auto", "café"])} as keyword,
               {_choose("s_suppkey", ["São Paulo", "Niterói", "Belém"])} as city, 'SP' as state, 'BR' as country,
               cast(case when s_suppkey % 30 = 0 then 20 else s_suppkey % 30 end as int) as max_results,
               case when s_suppkey % 2 = 0 then 'pipelined' else 'sequential' end as mode
        from @supplier""",
    # Leads extracted for the cards of each part, before completion.
    "part_leads": """
        select distinct 'job-' || cast(l_suppkey as string) as job_id, 'https://www.google.com/maps/place/P' || cast(l_partkey as string) as url,
               case s_suppkey % 3 when 0 then 'padaria' when 1 then 'o''neil auto' else 'café' end as keyword,
               case when l_partkey % 6 = 0 then '' else p_name end as name,
               case when l_partkey % 2 = 0 then case s_suppkey % 3 when 0 then 'Padaria' when 1 then 'O''Neil Auto' else 'Café' end
                 else 'Livraria' end as category,
               case when l_partkey % 3 = 0 then null when l_partkey % 3 = 1 then cast(0 as double) else cast(4.5 as double) end as rating,
               cast(case when l_partkey % 4 = 0 then 0 else p_size end as int) as review_count
        from @lineitem join @supplier on l_suppkey = s_suppkey join @part on l_partkey = p_partkey""",
    # Counter events of jobs.
    "job_events": """
        select 'job-' || cast(user_id as string) as job_id, EPOCH_US(ts) as ts_us,
               case event_type
                 when 'view' then case when event_id % 5 = 0 then 'cache_hit' else 'scraped' end
                 when 'click' then case when event_id % 6 = 0 then 'deduped' else 'sent' end
                 when 'purchase' then case when event_id % 4 = 0 then 'enriched' else 'new' end
                 when 'error' then case when event_id % 3 = 0 then 'retry' else 'error' end
                 else case event_id % 4 when 0 then 'nav' when 1 then 'batch' when 2 then 'phase1' else 'phase2' end end as kind,
               cast(1 as bigint) as count, cast(floor(value) as bigint) as elapsed_ms,
               cast(event_id % 3 as int) as emails, cast(event_id % 2 as int) as socials,
               cast(event_id % 5 as int) as technologies, event_id % 8 < 4 as cache_hit
        from @events""",
    # Leads and status changes of jobs on one time line.
    "timed_leads": """
        select 'job-' || cast(user_id as string) as job_id, event_id as n, EPOCH_US(ts) as ts
        from @events where event_type in ('view', 'click', 'purchase')""",
    "status_events": """
        select 'job-' || cast(user_id as string) as job_id,
               case when event_type = 'signup' then 'paused' when event_id % 40 = 7 then 'cancelled' else 'running' end as status,
               EPOCH_US(ts) as ts
        from @events where event_type in ('signup', 'error')""",
    "status_replies": """
        select event_id as reply_id, cast(case event_type when 'error' then 500 when 'view' then null else 200 end as int) as http_status,
               case event_type when 'error' then null when 'view' then null when 'signup' then '{"x": 1}'
                 when 'click' then '{"status": "paused"}' else '{"status": "cancelled"}' end as body
        from @events""",
    # Leads arriving while their jobs run; seven long jobs with different pace.
    "arrivals": """
        select 'job-' || cast(user_id % 7 as string) as job_id, event_id as n,
               cast(EPOCH_US(ts) - 1704067200000000 as double) / (cast(2000000000 as double) * (1 + 4 * (user_id % 7))) as arrival_s
        from @events""",
    # Growth of result lists per scroll.
    "scrolls": """
        select job_id, scroll_no, cast(sum(grown) over (partition by job_id order by scroll_no) as bigint) as link_count,
               cast(sum(fresh) over (partition by job_id order by scroll_no) as bigint) as pushed
        from (select 'job-' || cast(l_suppkey as string) as job_id, l_linenumber as scroll_no,
                     cast(floor(sum(case when l_linenumber <= 1 + l_suppkey % 6 then 1 else 0 end) / 20) as bigint) as grown,
                     cast(floor(sum(case when l_linenumber <= 1 + l_suppkey % 6 and l_partkey % 5 <> 0 then 1 else 0 end) / 20) as bigint) as fresh
              from @lineitem group by l_suppkey, l_linenumber) per_scroll""",
    # Writes into the place cache, many per address.
    "place_writes": f"""
        select ' HTTPS://www.google.com/maps/place/P' || cast(l_partkey as string) as url,
               l_suppkey as supplier, max({NOW_SQL} - (l_orderkey % 700) * 1500 - l_linenumber - cast(l_suppkey as double) / 16384) as cached_at
        from @lineitem group by l_partkey, l_suppkey""",
    # Finished searches and their leads.
    "searches": f"""
        select 's-' || cast(c_custkey as string) as search_id, lower(c_mktsegment) as keyword,
               {_choose("c_custkey", ["São Paulo", "SAO PAULO", "Niterói", "Belém"])} || ' ' || cast(c_custkey % 97 as string) as city,
               'SP' as state, 'BR' as country, cast(c_custkey % 30 as int) as max_results,
               {NOW_SQL} - (c_custkey * 7919) % 1000000 - cast(c_custkey as double) / 1000000 as cached_at
        from @customer""",
    "search_leads": """
        select 's-' || cast(o_custkey as string) as search_id, o_orderkey as n, 'Lead ' || cast(o_orderkey as string) as name
        from @orders where o_orderstatus <> 'P'""",
    "heartbeats": """
        select 'w-' || cast(user_id % 12 as string) as worker_id, EPOCH_US(ts) as ts_us, value as cpu_usage,
               value / 2 as ram_usage, cast(event_id % 3 as int) as active_jobs, '1.0.' || cast(event_id % 4 as string) as version
        from @events""",
}

_NAME = re.compile(r"@(\w+)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False, read: Callable[..., DataFrame] = table) -> DataFrame:
    """A derived (or driver) table as a DataFrame; ``heavy`` prepares small files for costly expressions, ``read`` opens driver tables."""
    if name in BASE:
        return spread(read(spark, sf_dir, name)) if heavy else read(spark, sf_dir, name)
    text = DERIVED[name].replace("LIST(", "array(").replace(
        "EPOCH_US(ts)", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
    )
    text = re.sub(r"[{}]", lambda m: m.group() * 2, text)
    used = sorted(set(_NAME.findall(text)))
    return spark.sql(_NAME.sub(r"{\1}", text), **{n: derived(spark, sf_dir, n, heavy, read) for n in used})


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in _NAME.findall(text):
        if name not in BASE and name not in seen:
            _needed(DERIVED[name], seen)
            seen.append(name)
    return seen


def oracle(sql: str, *ctes: tuple[str, str], recursive: bool = False) -> str:
    """DuckDB text for ``sql``: derived tables become common table expressions."""
    parts = [(n, DERIVED[n]) for n in _needed(" ".join([*(t for _, t in ctes), sql]), [])] + list(ctes)
    head = ",\n".join(f"{name} as ({text})" for name, text in parts)
    text = (f"with {'recursive ' if recursive else ''}{head}\n" if head else "") + sql
    text = text.replace("LIST(", "list_value(").replace("EPOCH_US(ts)", "epoch_us(ts)")
    return _NAME.sub(r"\1", text)
