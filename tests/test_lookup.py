import random

import pytest
from pyspark.sql import functions as F

from leadlake.functions.search import place_key
from leadlake.operators import filters
from leadlake.operators.lookup import (
    apply_job_control,
    backfill_from_feed,
    effective_status,
    enrichment_succeeded,
    enrichment_worklist,
    flag_new_leads,
    lookup_place_cache,
    reported_status,
)

c = F.col


def test_reported_status(column):
    rows = [(200, '{"status":"running"}'), (200, '{"status":"paused"}'), (200, '{"status":"cancelled"}'), (None, None), (500, None),
            (500, '{"status":"paused"}'), (200, "{}"), (200, "broken")]
    assert column(lambda: reported_status(c("h"), c("b")), rows, "h int, b string") == [
        "running", "paused", "cancelled", "running", "running", "running", "running", "running"]


def test_effective_status_defaults_to_running(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    status = spark.createDataFrame([("a", "paused", 1), ("a", "cancelled", 2)], "job_id string, status string, ts bigint")
    assert {tuple(r) for r in effective_status(jobs, status).collect()} == {("a", "cancelled"), ("b", "running")}


def control(leads, status):
    """Sequential account of one job: what becomes of each lead and when."""
    events = sorted([(t, 0, n, None) for n, t in leads] + [(t, 1, 0, s) for t, s in status])
    state, waiting, fate = "running", [], {}
    for t, kind, n, s in events:
        if kind == 0:
            if state == "cancelled":
                fate[n] = ("dropped", None)
            elif state == "paused":
                waiting.append(n)
            else:
                fate[n] = ("delivered", t)
        elif state != "cancelled":
            state = s if s in ("paused", "cancelled") else "running"
            if state != "paused":
                fate.update({w: ("delivered", t) if state == "running" else ("dropped", None) for w in waiting})
                waiting = []
    fate.update({w: ("held", None) for w in waiting})
    return fate


@pytest.mark.parametrize("seed", [5, 1000])
def test_job_control_equals_sequential_account(spark, seed):
    rng = random.Random(seed)
    leads, status, expected = [], [], {}
    for j in range(12):
        times = rng.sample(range(100), 30)
        mine = [(n, t) for n, t in enumerate(times[:20])]
        changes = [(t, rng.choice(["paused", "paused", "running", "cancelled" if t > 60 else "running"])) for t in times[20:]]
        if j == 0:
            changes = []
        leads += [(f"j{j}", n, t) for n, t in mine]
        status += [(f"j{j}", s, t) for t, s in changes]
        expected.update({(f"j{j}", n): f for n, f in control(mine, changes).items()})
    found = apply_job_control(
        spark.createDataFrame(leads, "job_id string, n bigint, ts bigint"),
        spark.createDataFrame(status, "job_id string, status string, ts bigint"))
    assert {(r.job_id, r.n): (r.disposition, r.release_ts) for r in found.collect()} == expected


def test_place_cache_split(spark):
    cards = spark.createDataFrame([("j", "U1", "São Paulo"), ("j", "u2", "São Paulo"), ("j", "u3", "São Paulo"), ("j", "u4", "")], "job_id string, url string, search_city string")
    cache = spark.createDataFrame([("u1", "sao paulo", 100.0), ("u2", "Recife", 100.0), ("u3", "São Paulo", 10.0), ("u4", "Recife", 100.0)], "url string, city string, cached_at double")
    cache = cache.select(place_key(c("url")).alias("key"), F.struct("city").alias("lead"), "cached_at", F.lit(50).alias("ttl_s"))
    hits, misses = lookup_place_cache(cards, cache, now=120.0)
    assert sorted(r.url for r in hits.collect()) == ["U1", "u4"]
    assert [r.url for r in misses.collect()] == ["u3"]


def test_backfill(spark):
    schema = "job_id string, url string, keyword string, name string, category string, rating double, review_count int"
    leads = spark.createDataFrame(
        [("j", "a", "bar legal", "", "Bar Legal", None, 0), ("j", "b", "bar legal", "N", "Bar", 0.0, 5), ("j", "c", "bar legal", "N", "Bar Legal", 4.0, 0)], schema)
    cards = spark.createDataFrame(
        [("j", "a", "Card", "4,7", "12", "Boteco"), ("j", "b", "Card", "x", "9", "Boteco"), ("j", "c", "Card", "3,0", "", "")],
        "job_id string, url string, name string, rating string, reviews string, category string")
    found = sorted(tuple(r)[1:] for r in backfill_from_feed(leads, cards).collect())
    assert found == [("a", "bar legal", "Card", "Boteco", 4.7, 12), ("b", "bar legal", "N", "Bar", 0.0, 5), ("c", "bar legal", "N", "Bar Legal", 4.0, 0)]


def test_flag_new_leads_with_repeated_known(spark):
    batch = spark.createDataFrame([("a",), ("b",)], "k string")
    known = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(tuple(r) for r in flag_new_leads(batch, known, ["k"]).collect()) == [("a", False), ("b", True)]


def test_enrichment(spark, column):
    queue = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "lead_id string, pos int")
    done = spark.createDataFrame([("a",)], "lead_id string")
    for flags, expected in (([(False,)], ["b", "c"]), ([(True,), (False,)], []), ([], ["b", "c"])):
        flag = spark.createDataFrame(flags, "paused boolean")
        assert [r.lead_id for r in enrichment_worklist(queue, done, flag).collect()] == expected
    rows = [(True, False), (True, None), (True, True), (None, None)]
    assert column(lambda: enrichment_succeeded(c("o"), c("p")), rows, "o boolean, p boolean") == [True, True, False, False]


def test_city_filters(column):
    rows = [("São Paulo", "sao paulo"), ("Paulo", "São Paulo"), ("São Paulo - Zona Sul", "SAO PAULO"), ("Recife", "Natal"), ("", "Natal"), (None, "x"), ("x", None)]
    assert column(lambda: filters.city_matches(c("a"), c("b")), rows, "a string, b string") == [True, True, True, False, True, True, True]
