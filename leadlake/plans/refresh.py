"""Scheduled refresh of stale search-cache entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.operators.cache import CACHE_TTL_S, put_results, refresh_index
from leadlake.operators.filters import valid_refresh_request
from leadlake.operators.limits import STALE_BATCH, stale_entries
from leadlake.operators.lookup import PART_CHARS
from leadlake.plans.leads import found_leads, largest_request
from leadlake.schemas import LEAD_COLUMNS
from leadlake.session import materialize
from leadlake.sources.jobs import search_jobs
from leadlake.sources.sinks import cache_version, read_result_cache, write_result_cache


def refresh_requests(meta: DataFrame, now: float, age_s: int, limit: int = STALE_BATCH) -> DataFrame:
    """Search jobs for the stale entries; the search hash is the job id, as an entry need not have a search id."""
    stale = valid_refresh_request(stale_entries(refresh_index(meta), meta, now, age_s, limit))
    return search_jobs(stale.withColumn("job_id", F.col("hash")))


def refresh_cycle(
    meta: DataFrame,
    entries: DataFrame,
    cards: DataFrame,
    pages: DataFrame,
    now: float,
    age_s: int,
    limit: int = STALE_BATCH,
    ttl_s: int = CACHE_TTL_S,
) -> tuple[DataFrame, DataFrame]:
    """Recompute the stale searches and store them; returns the new (meta, entries).

    The job of a card is the hash of its search. Refreshed leads skip the lead dedup. Entries that yield no leads stay as they are.
    """
    # At most ``limit`` searches; written so that the stale list is chosen once.
    jobs = materialize(refresh_requests(meta, now, age_s, limit), "refresh-requests")
    leads = found_leads(jobs, cards, pages, None, now, largest_request(jobs)).select(
        "job_id", "n", F.struct(*LEAD_COLUMNS).alias("lead")
    )
    searches = jobs.withColumn("cached_at", F.lit(now))
    return put_results(meta, entries, searches, leads, ttl_s, by="job_id")


def refresh_stored(
    spark: SparkSession, path: str, cards: DataFrame, pages: DataFrame, now: float, age_s: int, limit: int = STALE_BATCH,
    ttl_s: int = CACHE_TTL_S, part_chars: int = PART_CHARS,
) -> int:
    """:func:`refresh_cycle` over a stored cache, as one commit; returns the number of the new version.

    Meta and entries change together: readers see the version before until the new one is complete. Only the
    parts of refreshed searches are written. If another writer commits meanwhile, nothing changes and the commit fails.
    """
    version = cache_version(spark, path)
    meta, entries = read_result_cache(spark, path, version or None)
    fresh = refresh_cycle(meta, entries, cards, pages, now, age_s, limit, ttl_s)
    return write_result_cache(*fresh, path, part_chars, changed_since=now, based_on=version)
