"""From search jobs and captured pages to delivered leads, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import diagnosis as dx
from leadlake.functions import fields as fx
from leadlake.functions.text import clean_phone, phone_out
from leadlake.operators.dedup import dedup_leads, dedup_urls
from leadlake.operators.filters import drop_captcha_pages, drop_nameless, drop_unconfirmed, keep_city_matches
from leadlake.operators.limits import cap_by_jobs
from leadlake.operators.lookup import backfill_from_feed, lookup_place_cache
from leadlake.schemas import LEAD_COLUMNS
from leadlake.session import materialize
from leadlake.sources.pages import extract_place_fields, place_raw

# Columns that travel with a lead but are not part of it.
CONTEXT = ["job_id", "n", "url", "keyword", "search_city", "search_state", "country", "max_results"]


def job_context(jobs: DataFrame) -> DataFrame:
    """Search parameters under names that do not clash with lead columns."""
    return jobs.select(
        "job_id", "keyword", F.col("city").alias("search_city"), F.col("state").alias("search_state"),
        "country", "max_results",
    )


def build_leads(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Lead fields from place texts plus the job context; one projection, no Python.

    ``raw`` has the raw place columns and (keyword, search_city, search_state, country); its columns ``carry`` come along.
    """
    c = F.col
    labelled = fx.parse_review_count(c("review_labels"))
    search = (c("search_city"), c("search_state"), c("country"))
    # Intermediate columns that several fields share are computed once, in a projection of their own.
    shared = raw.withColumns({"_places": fx.address_places(c("address"), c("country")), "_labelled": labelled})
    first = shared.withColumns(
        {
            "category": fx.category_or_keyword(c("category_raw"), c("keyword")),
            "address": F.coalesce("address", F.lit("")),
            "neighborhood": fx.parse_neighborhood(c("address")),
            "_place": fx.city_state_of(c("_places"), *search),
            "phone": phone_out(clean_phone(c("phone_raw"))),
            "website": fx.canonical_site(c("site_href")),
            "instagram": fx.pick_instagram(c("instagram_links")),
            "rating": fx.parse_rating(c("rating_raw")),
            "review_count": fx.review_count_from_spans(c("_labelled"), c("rating_spans")),
            "hours": fx.hours_first_line(c("hours_raw")),
            "photo_url": fx.pick_photo(c("photos")),
            "_city_confirmed": fx.confirmed_by(c("_places"), c("address"), c("search_city"), c("country")),
        }
    )
    presence = (c("website"), c("instagram"), c("phone"))
    measured = (*presence, c("rating"), c("review_count"))
    scored = first.withColumns(
        {
            "city": c("_place.city"),
            "state": c("_place.state"),
            "score": dx.lead_score(*measured),
            "digital_status": dx.digital_status(*presence),
            "digital_maturity_score": dx.digital_maturity(*measured, c("hours")),
            "suggested_services": dx.suggested_services(*measured),
            "status": F.lit("new"),
            "source": F.lit("google_maps"),
        }
    )
    tagged = scored.withColumn("tags", dx.lead_tags(*presence, c("review_count"), c("score")))
    full = tagged.withColumn("digital_diagnosis", dx.digital_diagnosis(*measured, c("hours"), c("tags")))
    context = [name for name in CONTEXT if name in raw.columns]
    return full.select(*context, *carry, *LEAD_COLUMNS, "_city_confirmed")


def accepted_leads(built: DataFrame) -> DataFrame:
    """Named leads of the searched city whose address supports it."""
    return drop_unconfirmed(keep_city_matches(drop_nameless(built))).drop("_city_confirmed")


def feed_links(cards: DataFrame, jobs: DataFrame, largest: int) -> DataFrame:
    """The links a job visits: the first ``max_results`` of its feed, each once, with the job context."""
    capped = cap_by_jobs(cards, job_context(jobs), order=("position",), largest=largest)
    return dedup_urls(capped).withColumn("n", F.col("position"))


def extract_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Raw place texts of the wanted addresses, each page parsed once whatever the number of jobs.

    Of several captures of an address the latest one that is not blocked counts.
    """
    moment = F.col("captured_at") if "captured_at" in pages.columns else F.lit(None).cast("timestamp")
    needed = drop_captcha_pages(pages.select("url", "html", moment.alias("_captured"))).join(wanted.select("url").distinct(), "url", "left_semi")
    mark = F.struct(F.col("_captured"), F.xxhash64("html").alias("content"))
    marked = needed.withColumn("_mark", mark).drop("_captured")
    latest = marked.groupBy("url").agg(F.max("_mark").alias("_latest"))
    chosen = marked.join(latest, "url").where(F.col("_mark") == F.col("_latest")).select("url", "html").dropDuplicates(["url"])
    return place_raw(extract_place_fields(chosen))


def leads_from_pages(
    jobs: DataFrame,
    cards: DataFrame,
    pages: DataFrame,
    place_cache: DataFrame | None = None,
    now: float = 0.0,
) -> DataFrame:
    """All leads a set of jobs delivers, in the order of their feeds.

    Feed cap, link dedup, cache lookup, extraction of the misses, city and address
    filters, completion from the cards, lead dedup. The feed cap comes first and nothing
    adds rows after it, so capping the found and the kept leads again could never bind.
    """
    largest = largest_request(jobs)
    return dedup_leads(found_leads(jobs, cards, pages, place_cache, now, largest), largest=largest)


def largest_request(jobs: DataFrame) -> int:
    return jobs.agg(F.max("max_results")).first()[0] or 0


def found_leads(
    jobs: DataFrame, cards: DataFrame, pages: DataFrame, place_cache: DataFrame | None, now: float, largest: int
) -> DataFrame:
    """Leads of the jobs before the lead dedup.

    Written once: later steps read them more than once, and parsing pages again would
    cost far more than the table.
    """
    links = feed_links(cards, jobs, largest)
    hits, misses = (None, links) if place_cache is None else lookup_place_cache(links, place_cache, now)
    context = misses.select(*CONTEXT)
    raw = context.join(extract_pages(pages, misses), "url", "inner")
    found = backfill_from_feed(accepted_leads(build_leads(raw)), misses)
    if hits is not None:
        cached = hits.select(*CONTEXT, *[F.col(f"lead.{name}").alias(f"_{name}") for name in LEAD_COLUMNS])
        renamed = cached.select(*CONTEXT, *[F.col(f"_{name}").alias(name) for name in LEAD_COLUMNS])
        found = found.unionByName(renamed.select(*found.columns))
    return materialize(found, "found-leads")
