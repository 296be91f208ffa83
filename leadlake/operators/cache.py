"""Place and search caches as tables with expiry.

Place cache: (key, url, lead, cached_at, ttl_s), one row per key. Search cache: ``meta``
with one row per search hash and ``entries`` with one row per cached lead, so a search
with very many leads never has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.search import place_key
from leadlake.operators.lookup import alive, with_search_hash

# Fixed value: seven days.
CACHE_TTL_S = 604_800

META_COLUMNS = [
    "hash", "search_id", "keyword", "city", "state", "country", "max_results", "count", "cached_at", "cached_iso", "ttl_s",
]


def put_places(cache: DataFrame, leads: DataFrame, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """Upsert extracted places; the last write of a key wins.

    ``leads`` has (url, lead, cached_at).
    """
    written = leads.select(
        place_key(F.col("url")).alias("key"), "url", "lead", "cached_at", F.lit(ttl_s).alias("ttl_s")
    )
    merged = cache.select(*written.columns).unionByName(written)
    # The whole value breaks ties of equal times, so that the outcome does not depend on partitions.
    latest = merged.groupBy("key").agg(F.max(F.struct("cached_at", "url", "lead", "ttl_s")).alias("_v"))
    return latest.select("key", "_v.url", "_v.lead", "_v.cached_at", "_v.ttl_s")


def invalidate_places(cache: DataFrame, urls: DataFrame) -> DataFrame:
    """Remove the entries of the given addresses."""
    keys = urls.select(place_key(F.col("url")).alias("key"))
    return cache.join(keys, "key", "left_anti")


def expire(table: DataFrame, now: float) -> DataFrame:
    """Drop rows older than their time to live."""
    return table.where(alive(F.col("cached_at"), F.col("ttl_s"), now))


def put_results(
    meta: DataFrame, entries: DataFrame, searches: DataFrame, leads: DataFrame, ttl_s: int = CACHE_TTL_S, by: str = "search_id"
) -> tuple[DataFrame, DataFrame]:
    """Store the leads of finished searches; returns the new (meta, entries).

    ``searches`` has (search_id, keyword, city, state, country, max_results, cached_at);
    ``leads`` has (search_id, n, lead); ``by`` names another column that links the two. The last
    write of a hash replaces the earlier one as a whole, so writing the same search again changes
    nothing; a search without leads writes nothing.
    """
    counted = leads.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("count"))
    moment = F.timestamp_micros((F.col("cached_at") * 1_000_000).cast("bigint"))
    # The text is in UTC whatever the time zone of the session.
    iso = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    written = with_search_hash(searches.join(counted, by, "inner")).withColumns(
        {"cached_iso": iso, "ttl_s": F.lit(ttl_s)}
    )
    rows = meta.select(*META_COLUMNS).unionByName(written.select(*META_COLUMNS))
    value = F.struct(*META_COLUMNS[1:])
    latest = rows.groupBy("hash").agg(F.max_by(value, F.struct("cached_at", "search_id")).alias("_v")).select("hash", "_v.*")

    # One write per hash: the one that is the latest now, if it is of this call.
    versions = written.groupBy("hash").agg(F.max(F.struct("cached_at", F.col("search_id").alias("_id"), F.col(by).alias("_by"))).alias("_v")).select(
        "hash", "_v._by", "_v._id", F.col("_v.cached_at").alias("_at"))
    current = latest.select("hash", "search_id", "cached_at")
    winners = current.join(versions, "hash").where((F.col("cached_at") == F.col("_at")) & F.col("search_id").eqNullSafe(F.col("_id")))
    columns = ["hash", "search_id", "cached_at", "n", "lead"]
    added = leads.select(F.col(by).alias("_by"), "n", "lead").join(winners.select("_by", "hash", "search_id", "cached_at"), "_by")
    untouched = entries.select(*columns).join(winners.select("hash"), "hash", "left_anti").join(
        current.select("hash", "cached_at"), ["hash", "cached_at"], "left_semi")
    return latest, untouched.select(*columns).unionByName(added.select(*columns))


def refresh_index(meta: DataFrame) -> DataFrame:
    """(hash, updated_at): when each cached search was last written."""
    return meta.select("hash", F.col("cached_at").alias("updated_at"))


def cache_meta(searches: DataFrame, meta: DataFrame, now: float) -> DataFrame:
    """Metadata of equal cached searches that have not expired."""
    asked = with_search_hash(searches).select(F.col("search_id").alias("asked_by"), "hash")
    return asked.join(expire(meta, now), "hash", "inner")
