"""Declared schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _LONG, _DOUBLE, _FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_STRINGS = T.ArrayType(_STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SEARCH_JOB = _struct(
    job_id=_STRING, search_id=_STRING, keyword=_STRING, city=_STRING, state=_STRING, country=_STRING, max_results=_INT
)
# As records arrive: the limit may be a number or a text.
SEARCH_JOB_RECORD = _struct(
    job_id=_STRING, search_id=_STRING, keyword=_STRING, city=_STRING, state=_STRING, country=_STRING, max_results=_STRING
)
FEED_CARD = _struct(
    job_id=_STRING, scroll_no=_INT, position=_LONG, url=_STRING, name=_STRING, rating=_STRING, reviews=_STRING,
    category=_STRING,
)
CAPTURED_PAGE = _struct(url=_STRING, html=_STRING, captured_at=T.TimestampType())
DIAGNOSIS = _struct(
    needs_website=_FLAG, needs_seo=_FLAG, needs_social_media=_FLAG, needs_google_business=_FLAG,
    needs_paid_traffic=_FLAG, needs_redesign=_FLAG, needs_automation=_FLAG,
    digital_maturity_score=_INT, issues=_STRINGS, suggested_services=_STRINGS,
)
LEAD = _struct(
    name=_STRING, category=_STRING, address=_STRING, neighborhood=_STRING, city=_STRING, state=_STRING, phone=_STRING,
    website=_STRING, instagram=_STRING, rating=_DOUBLE, review_count=_INT, score=_INT, digital_status=_STRING,
    tags=_STRINGS, hours=_STRING, photo_url=_STRING, digital_diagnosis=DIAGNOSIS, digital_maturity_score=_INT,
    suggested_services=_STRINGS, status=_STRING, source=_STRING,
)
LEAD_COLUMNS = LEAD.fieldNames()
# What the selectors found on one page: candidate texts in selector order, before any cleaning.
PLACE_TEXTS = _struct(
    name=_STRINGS, address=_STRINGS, phone=_STRINGS, phone_label=_STRING, site=_STRINGS, instagram=_STRINGS,
    rating=_STRINGS, review_labels=_STRINGS, rating_spans=_STRINGS, category=_STRINGS, hours=_STRING, photos=_STRINGS,
)
PLACE_RAW = _struct(
    url=_STRING, name=_STRING, address=_STRING, phone_raw=_STRING, site_href=_STRING, instagram_links=_STRINGS,
    rating_raw=_STRING, review_labels=_STRINGS, rating_spans=_STRINGS, category_raw=_STRING, hours_raw=_STRING,
    photos=_STRINGS,
)
PLACE_CACHE = _struct(key=_STRING, url=_STRING, lead=LEAD, cached_at=_DOUBLE, ttl_s=_INT)
RESULT_META = _struct(
    hash=_STRING, search_id=_STRING, keyword=_STRING, city=_STRING, state=_STRING, country=_STRING, max_results=_INT,
    count=_INT, cached_at=_DOUBLE, cached_iso=_STRING, ttl_s=_INT,
)
RESULT_ENTRY = _struct(hash=_STRING, search_id=_STRING, cached_at=_DOUBLE, n=_LONG, lead=LEAD)
JOB_STATUS = _struct(job_id=_STRING, status=_STRING, ts=_LONG)
JOB_EVENT = _struct(
    job_id=_STRING, ts_us=_LONG, kind=_STRING, count=_LONG, elapsed_ms=_LONG, emails=_INT, socials=_INT,
    technologies=_INT, cache_hit=_FLAG,
)
HEARTBEAT = _struct(
    worker_id=_STRING, ts_us=_LONG, cpu_usage=_DOUBLE, ram_usage=_DOUBLE, active_jobs=_INT, version=_STRING
)
