"""Lookups against caches, known leads, job control and the enrichment queue.

All joins keep the large side on the left, where AQE may split a skewed key; whether
the right side is broadcast is left to its measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.search import place_key, search_hash
from leadlake.functions.text import absent_as_null, present, title_case
from leadlake.operators.filters import keep_city_matches
from leadlake.operators.ordered import Carried, with_ordered
from leadlake.session import materialize

# Leading characters of a search hash that name its part of a stored cache.
PART_CHARS = 2


def alive(cached_at: Column, ttl_s: Column, now: float) -> Column:
    return cached_at + ttl_s > F.lit(now)


def backfill_columns(keyword: Column) -> dict[str, Column]:
    """Lead fields completed from the result-list card (columns ``card_*``)."""
    name, category, rating, reviews = (F.col(f"card_{c}") for c in ("name", "category", "rating", "reviews"))
    generic = F.col("category") == title_case(keyword)
    unrated = F.coalesce(F.col("rating") == 0, F.lit(True))
    uncounted = F.coalesce(F.col("review_count") == 0, F.lit(True))
    card_rating = F.replace(absent_as_null(rating), F.lit(","), F.lit(".")).try_cast("double")
    card_reviews = absent_as_null(reviews).try_cast("int")
    return {
        "name": F.when(present(F.col("name")), F.col("name")).otherwise(F.coalesce(absent_as_null(name), F.col("name"))),
        "category": F.when(generic & present(category), category).otherwise(F.col("category")),
        "rating": F.when(unrated, F.coalesce(card_rating, F.col("rating"))).otherwise(F.col("rating")),
        "review_count": F.when(uncounted, F.coalesce(card_reviews, F.col("review_count"))).otherwise(
            F.col("review_count")
        ),
    }


def backfill_from_feed(
    leads: DataFrame, cards: DataFrame, keyword: str = "keyword", on: Sequence[str] = ("job_id", "url")
) -> DataFrame:
    """Complete missing fields from the card of the same (job, link).

    A generic category (the title-cased keyword) counts as missing, a rating of 0.0 too.
    Derived fields such as the score stay as they are. ``cards`` is unique on ``on``.
    """
    slim = cards.select(*on, *[F.col(c).alias(f"card_{c}") for c in ("name", "category", "rating", "reviews")])
    joined = leads.join(slim, list(on), "left")
    return joined.withColumns(backfill_columns(F.col(keyword))).select(*leads.columns)


def lookup_place_cache(cards: DataFrame, cache: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Split cards into (hits with their cached lead, misses).

    ``cache`` has (key, lead struct, cached_at, ttl_s) with unique keys. Hits skip
    extraction and the address check, but must match the searched city.
    """
    live = cache.where(alive(F.col("cached_at"), F.col("ttl_s"), now)).select(F.col("key").alias("_key"), "lead")
    keyed = cards.withColumn("_key", place_key(F.col("url")))
    hits = keyed.join(live, "_key", "inner").drop("_key")
    hits = hits.withColumn("_lead_city", F.col("lead.city"))
    misses = keyed.join(live, "_key", "left_anti").drop("_key")
    return keep_city_matches(hits, "_lead_city", "search_city").drop("_lead_city"), misses


def with_search_hash(searches: DataFrame) -> DataFrame:
    return searches.withColumn(
        "hash", search_hash(F.col("keyword"), F.col("city"), F.col("state"), F.col("country"))
    )


def lookup_result_cache(
    searches: DataFrame, meta: DataFrame, entries: DataFrame, now: float, part_chars: int = PART_CHARS
) -> DataFrame:
    """Cached leads of equal searches, one row per (search, lead); a miss yields no row.

    ``meta`` holds one row per search hash, ``entries`` one row per cached lead. Where they carry their ``part``, the first
    ``part_chars`` characters of the hash, only the parts asked for are read: the searches are written first, so that their
    size is known, and as long as they are few Spark broadcasts them and prunes both scans by them.
    """
    if not ({"part"} <= set(meta.columns) & set(entries.columns)):
        meta, entries = meta.drop("part"), entries.drop("part")
        live = meta.where(alive(F.col("cached_at"), F.col("ttl_s"), now)).select("hash", "cached_at")
        return entries.join(with_search_hash(searches).join(live, "hash", "inner"), ["hash", "cached_at"], "inner")
    asked = materialize(with_search_hash(searches).withColumn("part", F.left("hash", F.lit(part_chars))), "asked-searches")
    # The comparison holds for every hash; it tells the planner that pruning by this side pays.
    asked = asked.where(F.length("part") == part_chars)
    live = meta.where(alive(F.col("cached_at"), F.col("ttl_s"), now)).select("part", "hash", "cached_at")
    wanted = materialize(live.join(asked, ["part", "hash"], "inner"), "wanted-searches").where(F.length("part") == part_chars)
    return entries.join(wanted, ["part", "hash", "cached_at"], "inner").drop("part")


def flag_new_leads(batch: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``is_new``: no known lead has the same key. Copies in ``known`` do not multiply rows.

    The keys asked for are written first: while they are few, ``known`` is scanned against them where it lies and not shuffled.
    """
    asked = materialize(batch.select(*on).distinct(), "asked-keys")
    # Only the known leads the batch asks for are made distinct.
    seen = known.select(*on).join(asked, list(on), "left_semi").distinct().withColumn("_seen", F.lit(True))
    return batch.join(seen, list(on), "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def reported_status(http_status: Column, body: Column) -> Column:
    """Job status carried by one status reply; anything but a good reply means running."""
    status = F.get_json_object(F.when(http_status == 200, body), "$.status")
    return F.coalesce(status, F.lit("running"))


def effective_status(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """Latest status of each job; a job without one is running. Of statuses at one time the last by name counts."""
    latest = status.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))
    joined = jobs.select("job_id").join(latest, "job_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("running")))


def apply_job_control(
    leads: DataFrame, status: DataFrame, order: str = "n", ts: str = "ts"
) -> DataFrame:
    """Add ``disposition`` and ``release_ts`` to each lead of a job under control.

    A lead counts before a status of the same time. After a job's first cancellation
    leads are ``dropped``. While paused they wait: until the next status that is not a
    pause (``delivered`` then; ``dropped`` if that one cancels), or ``held`` without one.
    Otherwise they are ``delivered`` at their own time. ``ts`` is whole microseconds. Statuses at
    one time follow each other by name.
    """
    events = leads.select("job_id", ts, F.lit(0).alias("_kind"), order, F.lit(None).cast("string").alias("_status"))
    control = status.select(
        "job_id", F.col("ts").alias(ts), F.lit(1).alias("_kind"), F.lit(0).cast(leads.schema[order].dataType).alias(order),
        F.col("status").alias("_status"),
    )
    timeline = events.unionByName(control)
    resumed = F.when(F.col("_status") != "paused", F.struct(ts, "_status"))
    timeline = with_ordered(timeline, ["job_id"], [ts, "_kind", order, "_status"], {
        "_before": Carried(F.col("_status")), "_after": Carried(resumed, backwards=True),
    })
    cancels = status.where(F.col("status") == "cancelled").groupBy("job_id").agg(F.min("ts").alias("_cancel_ts"))

    cancelled = F.coalesce(F.col(ts) > F.col("_cancel_ts"), F.lit(False))
    paused = F.coalesce(F.col("_before") == "paused", F.lit(False))
    release = F.when(paused, F.col(f"_after.{ts}")).otherwise(F.col(ts))
    disposition = (
        F.when(cancelled | (paused & (F.col("_after._status") == "cancelled")), "dropped")
        .when(paused & F.col("_after").isNull(), "held")
        .otherwise("delivered")
    )
    decided = (
        timeline.where(F.col("_kind") == 0)
        .join(cancels, "job_id", "left")
        .select("job_id", order, disposition.alias("disposition"), release.alias("_release"))
        .withColumn("release_ts", F.when(F.col("disposition") == "delivered", F.col("_release")))
        .drop("_release")
    )
    return leads.join(decided, ["job_id", order], "inner")


def enrichment_worklist(queue: DataFrame, done: DataFrame, flag: DataFrame) -> DataFrame:
    """Leads waiting for enrichment in queue order; none while the pause flag is set.

    ``flag`` is a table of pause markers: a row with ``paused`` true stops the list.
    """
    waiting = queue.join(done.select("lead_id").distinct(), "lead_id", "left_anti")
    # One row whatever the size of ``flag``: an aggregate without grouping.
    paused = flag.agg(F.coalesce(F.bool_or("paused"), F.lit(False)).alias("_paused"))
    return (
        waiting.withColumn("_paused", F.lit(False))
        .join(F.broadcast(paused), "_paused", "left_semi")
        .drop("_paused")
        .orderBy("pos")
    )


def enrichment_succeeded(ok: Column, paused: Column) -> Column:
    """Success of one enrichment reply: ok and not paused."""
    return F.coalesce(ok, F.lit(False)) & ~F.coalesce(paused, F.lit(False))


def prune_cache_index(index: DataFrame, meta: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(index without entries whose data expired, one-row count of removed entries)."""
    live = meta.where(alive(F.col("cached_at"), F.col("ttl_s"), now)).select("hash")
    kept = index.join(live, "hash", "left_semi")
    removed = index.join(live, "hash", "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    return kept, removed
