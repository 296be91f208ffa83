"""Diagnosis and filters: queries and oracles (C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import diagnosis as dx
from leadlake.operators import filters
from leadlake.plans.leads import accepted_leads, build_leads
from workload import normalise as nz
from workload.inputs import DERIVED, derived, oracle, table

c = F.col
QUERIES, ORACLES = {}, {}

SITE, INSTA, PHONE = "coalesce(website, '') <> ''", "coalesce(instagram, '') <> ''", "coalesce(phone, '') <> ''"
SQL_SCORE = f"""least(99, 50 + case when coalesce(rating, 0) <> 0 then trunc(least(rating * 6, 30))::int else 0 end
    + case when {SITE} then 0 else 12 end + case when {PHONE} then 0 else 5 end
    + case when {INSTA} then 0 else 5 end + case when review_count < 20 then 5 else 0 end)"""
SQL_STATUS = f"case when {SITE} and {INSTA} then 'excellent' when {SITE} or {INSTA} then 'good' when {PHONE} then 'poor' else 'none' end"
SQL_MATURITY = f"""case when {SITE} then 30 else 0 end + case when {INSTA} then 20 else 0 end + case when {PHONE} then 15 else 0 end
    + case when review_count >= 20 then 15 when review_count >= 5 then 8 else 0 end
    + case when rating >= 4 then 10 when rating >= 3 then 5 else 0 end + case when coalesce(hours, '') <> '' then 10 else 0 end"""
SQL_NEEDS = {
    "needs_website": f"not ({SITE})",
    "needs_seo": f"({SITE}) and (review_count < 20 or coalesce(rating < 4, false))",
    "needs_social_media": f"not ({INSTA})",
    "needs_google_business": "review_count < 10 or coalesce(rating < 3.5, false)",
    "needs_paid_traffic": f"({SITE}) and review_count < 15",
    "needs_redesign": f"({SITE}) and not ({INSTA}) and review_count < 10",
    "needs_automation": f"({SITE}) and ({PHONE}) and review_count >= 10",
}


def _sql_list(entries):
    arms = ", ".join(f"case when {cond} then '{text}' end" for cond, text in entries)
    return f"list_filter([{arms}], lambda t: t is not null)"


SQL_TAGS = _sql_list([
    (f"not ({SITE})", "sem site"), (f"not ({PHONE})", "sem telefone"), (f"not ({INSTA})", "sem instagram"),
    ("review_count < 20", "poucas avaliações"), (f"{SQL_SCORE} >= 80", "alto potencial"),
])
SQL_SERVICES = _sql_list([
    (SQL_NEEDS["needs_website"], "Criação de site"),
    (f"not ({INSTA}) and ({SITE} or {PHONE})", "Gestão de redes sociais"),
    (SQL_NEEDS["needs_seo"], "SEO / Otimização para buscas"),
    (SQL_NEEDS["needs_paid_traffic"], "Tráfego pago (Google Ads)"),
    (SQL_NEEDS["needs_google_business"], "Google Meu Negócio"),
    (f"not ({PHONE})", "WhatsApp Business"),
    (SQL_NEEDS["needs_redesign"], "Redesign de site"),
    (SQL_NEEDS["needs_automation"], "Automação de atendimento"),
    ("review_count < 10", "Gestão de avaliações"),
])


def joined(col, sql):
    """Lists travel as joined texts, which compare the same in every engine."""
    return F.array_join(col, "; "), f"array_to_string({sql}, '; ')"


def _presence(name, build, columns):
    def query(spark, sf):
        return derived(spark, sf, "presence").select("lead_id", *[v.alias(k) for k, v in build().items()])

    QUERIES[name] = query
    ORACLES[name] = oracle("select lead_id, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + " from @presence")


def _links():
    return c("website"), c("instagram"), c("phone")


def _measured():
    return *_links(), c("rating"), c("review_count")


def _tags():
    return dx.lead_tags(*_links(), c("review_count"), dx.lead_score(*_measured()))


_presence("c1_lead_score", lambda: {"score": dx.lead_score(*_measured())}, {"score": SQL_SCORE})
_presence("c2_digital_status", lambda: {"digital_status": dx.digital_status(*_links())}, {"digital_status": SQL_STATUS})
_presence("c3_lead_tags", lambda: {"tags": F.array_join(_tags(), "; ")}, {"tags": f"array_to_string({SQL_TAGS}, '; ')"})
_presence("c4_need_flags", lambda: dx.need_flags(*_measured()), SQL_NEEDS)
_presence("c5_digital_maturity", lambda: {"maturity": dx.digital_maturity(*_measured(), c("hours"))}, {"maturity": SQL_MATURITY})
_presence(
    "c6_suggested_services", lambda: {"services": F.array_join(dx.suggested_services(*_measured()), "; ")},
    {"services": f"array_to_string({SQL_SERVICES}, '; ')"},
)


def _diagnosis(spark, sf):
    found = derived(spark, sf, "presence").select(
        "lead_id", dx.digital_diagnosis(*_measured(), c("hours"), _tags()).alias("d")
    )
    flags = [c(f"d.{name}").alias(name) for name in SQL_NEEDS]
    return found.select(
        "lead_id", *flags, "d.digital_maturity_score",
        F.array_join("d.issues", "; ").alias("issues"), F.array_join("d.suggested_services", "; ").alias("suggested_services"),
    )


QUERIES["c7_digital_diagnosis"] = _diagnosis
ORACLES["c7_digital_diagnosis"] = oracle(
    "select lead_id, " + ", ".join(f"{v} as {k}" for k, v in SQL_NEEDS.items())
    + f", {SQL_MATURITY} as digital_maturity_score, array_to_string({SQL_TAGS}, '; ') as issues, "
    f"array_to_string({SQL_SERVICES}, '; ') as suggested_services from @presence"
)

# Flagship: how well the businesses of each nation are present on the web.
def presence_by_nation(spark, sf):
    orders, customers, nations = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    cities = (
        orders.select(c("o_orderkey").alias("lead_id"), "o_custkey")
        .join(customers.select(c("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .join(nations.select(c("n_nationkey").alias("c_nationkey"), c("n_name").alias("city")), "c_nationkey")
    )
    scored = derived(spark, sf, "presence").select(
        "lead_id", dx.digital_status(*_links()).alias("digital_status"),
        dx.lead_score(*_measured()).alias("score"), dx.digital_maturity(*_measured(), c("hours")).alias("maturity"),
    )
    return cities.join(scored, "lead_id").groupBy("city", "digital_status").agg(
        F.count(F.lit(1)).alias("leads"), F.sum("score").alias("score_sum"), F.sum("maturity").alias("maturity_sum"),
        F.round(F.avg("score"), 4).alias("score_mean"),
    )


QUERIES["c0_presence_by_nation"] = presence_by_nation
ORACLES["c0_presence_by_nation"] = oracle(
    f"""select n_name as city, {SQL_STATUS} as digital_status, count(*) as leads, sum({SQL_SCORE})::bigint as score_sum,
        sum({SQL_MATURITY})::bigint as maturity_sum, round(avg({SQL_SCORE}), 4) as score_mean
        from @orders join @customer on o_custkey = c_custkey join @nation on c_nationkey = n_nationkey join @presence on lead_id = o_orderkey
        group by 1, 2"""
)

# The lead record in SQL, for every query that ends in leads.
BUILT = (
    f"""select job_id, n, url, keyword, search_city, max_results, name, coalesce(nullif(category_raw, ''), {nz.sql_title('keyword')}) as category,
        coalesce(address, '') as address, {nz.SQL_NEIGHBORHOOD} as neighborhood, {nz.SQL_CITY} as city, {nz.SQL_STATE} as state,
        nullif({nz.SQL_CLEAN_PHONE}, '') as phone, {nz.SQL_SITE} as website, {nz.SQL_INSTAGRAM} as instagram, {nz.SQL_RATING} as rating,
        {nz.SQL_REVIEWS} as review_count, {nz.SQL_HOURS} as hours, {nz.SQL_PHOTO} as photo_url, {nz.SQL_CONFIRMED} as confirmed from placed"""
)
LEAD_SCALARS = [
    "name", "category", "address", "neighborhood", "city", "state", "phone", "website", "instagram", "rating", "review_count",
    "score", "digital_status", "hours", "photo_url", "digital_maturity_score", "status", "source",
]
SQL_LEAD = ", ".join(
    {"score": f"{SQL_SCORE} as score", "digital_status": f"{SQL_STATUS} as digital_status",
     "digital_maturity_score": f"{SQL_MATURITY} as digital_maturity_score", "status": "'new' as status",
     "source": "'google_maps' as source"}.get(name, name)
    for name in LEAD_SCALARS
) + f", array_to_string({SQL_TAGS}, '; ') as tags, array_to_string({SQL_SERVICES}, '; ') as suggested_services"
CTES = [("placed", nz.PLACED), ("built", BUILT)]


def flat_lead(df, *keys):
    return df.select(
        *keys, *LEAD_SCALARS, F.array_join("tags", "; ").alias("tags"),
        F.array_join("suggested_services", "; ").alias("suggested_services"),
    )


def placed_with_state(spark, sf):
    return nz.placed(spark, sf)


QUERIES["c8_build_leads"] = lambda spark, sf: flat_lead(build_leads(nz.placed(spark, sf)), "job_id", "n")
ORACLES["c8_build_leads"] = oracle(f"select job_id, n, {SQL_LEAD} from built", *CTES)

QUERIES["d0_accepted_leads"] = lambda spark, sf: flat_lead(accepted_leads(build_leads(nz.placed(spark, sf))), "job_id", "n")


def sql_city_matches(a, b):
    return (
        f"(coalesce({a}, '') = '' or coalesce({b}, '') = '' or contains({nz.sql_ascii(a)}, {nz.sql_ascii(b)}) "
        f"or contains({nz.sql_ascii(b)}, {nz.sql_ascii(a)}))"
    )


ORACLES["d0_accepted_leads"] = oracle(
    f"select job_id, n, {SQL_LEAD} from built where name <> '' and confirmed and {sql_city_matches('city', 'search_city')}", *CTES
)

# The captured pages, some of them blocked.
DERIVED["captured"] = """
    select page_id, url, case page_id % 5 when 0 then html || '<p>Detected UNUSUAL traffic</p>'
      when 1 then html || '<div class="g-reCAPTCHA"></div>' else html end as html from @pages"""
QUERIES["d1_drop_captcha_pages"] = lambda spark, sf: filters.drop_captcha_pages(derived(spark, sf, "captured")).select("page_id", "url")
ORACLES["d1_drop_captcha_pages"] = oracle("select page_id, url from @captured where not ({})".format(
    " or ".join(f"contains(lower(html), '{m}')" for m in nz.sx.BLOCK_MARKERS)
))
QUERIES["d2_drop_nameless"] = lambda spark, sf: filters.drop_nameless(derived(spark, sf, "places")).select("job_id", "n", "name")
ORACLES["d2_drop_nameless"] = oracle("select job_id, n, name from @places where name <> ''")
QUERIES["d3_city_matches"] = lambda spark, sf: filters.keep_city_matches(
    derived(spark, sf, "leads").join(derived(spark, sf, "jobs").select("job_id", c("city").alias("job_city")), "job_id")
    .withColumn("search_city", F.when(c("n") % 3 == 0, F.substring("city", 1, 8)).when(c("n") % 3 == 1, c("job_city")).otherwise("")),
).select("job_id", "n", "city", "search_city")
ORACLES["d3_city_matches"] = oracle(
    f"""select job_id, n, city, search_city from (
        select l.job_id, n, l.city, case n % 3 when 0 then l.city[:8] when 1 then j.city else '' end as search_city
        from @leads l join @jobs j using (job_id)) s where {sql_city_matches('city', 'search_city')}"""
)
QUERIES["d4_drop_unconfirmed"] = lambda spark, sf: filters.drop_unconfirmed(build_leads(nz.placed(spark, sf))).select("job_id", "n", "city")
ORACLES["d4_drop_unconfirmed"] = oracle("select job_id, n, city from built where confirmed", *CTES)
QUERIES["d5_valid_refresh_request"] = lambda spark, sf: filters.valid_refresh_request(
    derived(spark, sf, "job_records")).select("search_id", "keyword", "city")
ORACLES["d5_valid_refresh_request"] = oracle(
    "select search_id, keyword, city from @job_records where coalesce(keyword, '') <> '' and coalesce(city, '') <> ''"
)
