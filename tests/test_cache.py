from pyspark.sql import functions as F

from leadlake.operators import cache
from leadlake.operators.lookup import lookup_result_cache, prune_cache_index
from leadlake.schemas import PLACE_CACHE, RESULT_ENTRY, RESULT_META
from leadlake.sources import sinks

LEAD = RESULT_ENTRY["lead"].dataType
SEARCH = "search_id string, keyword string, city string, state string, country string, max_results int, cached_at double"


def leads_of(spark, rows):
    """(search_id, n, name) rows with a full lead record."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in LEAD.fields[1:]]
    return spark.createDataFrame(rows, "search_id string, n bigint, name string").select("search_id", "n", F.struct("name", *blank).alias("lead"))


def stored(spark, searches, leads, before=None):
    meta, entries = before or (spark.createDataFrame([], RESULT_META), spark.createDataFrame([], RESULT_ENTRY))
    return cache.put_results(meta, entries, spark.createDataFrame(searches, SEARCH), leads_of(spark, leads), ttl_s=100)


def test_last_write_of_a_search_replaces_the_whole(spark):
    first = stored(spark, [("1", "Bar", "São Paulo", "", "BR", 20, 10.0), ("2", "x", "y", "", "BR", 20, 10.0)], [("1", 1, "a"), ("1", 2, "b")])
    assert [(r.search_id, r["count"]) for r in first[0].collect()] == [("1", 2)]
    meta, entries = stored(spark, [("3", "BAR ", "Sao Paulo", "", "br", 5, 20.0)], [("3", 1, "c")], first)
    assert [(r.search_id, r["count"], r.cached_iso) for r in meta.collect()] == [("3", 1, "1970-01-01T00:00:20.000000+00:00")]
    assert [r.lead.name for r in entries.collect()] == ["c"]

    asked = spark.createDataFrame([("bar", "SÃO PAULO", "", "BR")], "keyword string, city string, state string, country string")
    assert [r.lead.name for r in lookup_result_cache(asked, meta, entries, now=119.0).collect()] == ["c"]
    assert lookup_result_cache(asked, meta, entries, now=120.0).isEmpty()
    index = meta.select("hash").unionByName(spark.createDataFrame([("gone",)], "hash string"))
    kept, removed = prune_cache_index(index, meta, now=50.0)
    assert kept.count() == 1 and removed.first().removed == 1


def test_cached_iso_is_utc_in_every_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        meta, _ = stored(spark, [("1", "Bar", "X", "", "BR", 20, 10.25)], [("1", 1, "a")])
        assert meta.first().cached_iso == "1970-01-01T00:00:10.250000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_result_cache_files(spark, tmp_path):
    meta, entries = stored(spark, [("1", "Bar", "X", "", "BR", 20, 10.0)], [("1", 1, "a"), ("1", 2, "b")])
    sinks.write_result_cache(meta, entries, str(tmp_path), part_chars=1)
    meta2, entries2 = sinks.read_result_cache(spark, str(tmp_path))
    assert meta2.columns == [*RESULT_META.fieldNames(), "part"]
    assert meta2.drop("part").collect() == meta.collect() and sorted(entries2.drop("part").collect()) == sorted(entries.select(*RESULT_ENTRY.fieldNames()).collect())


def test_refresh_rewrites_only_touched_parts(spark, tmp_path):
    searches = [(str(i), f"k{i}", "X", "", "BR", 20, 10.0) for i in range(12)]
    old = stored(spark, searches, [(s[0], 1, "a") for s in searches])
    sinks.write_result_cache(*old, str(tmp_path), part_chars=1)
    before = sinks._cache_snapshot(spark, str(tmp_path))["entries"]
    new = stored(spark, [("new", "k3", "X", "", "BR", 20, 99.0)], [("new", 1, "b"), ("new", 2, "c")], sinks.read_result_cache(spark, str(tmp_path)))
    assert sinks.write_result_cache(*new, str(tmp_path), part_chars=1, changed_since=99.0) == 2
    after = sinks._cache_snapshot(spark, str(tmp_path))["entries"]
    assert before.keys() == after.keys() and sum(before[p] != after[p] for p in before) == 1
    meta, entries = sinks.read_result_cache(spark, str(tmp_path))
    assert meta.count() == 12 and sorted(r.lead.name for r in entries.where("search_id = 'new'").collect()) == ["b", "c"]
    assert entries.count() == 13


def test_place_cache(spark, tmp_path):
    rows = [("U1", "old", 1.0), ("u1 ", "new", 5.0), ("u2", "z", 2.0)]
    writes = leads_of(spark, [(u, 0, n) for u, n, _ in rows]).join(spark.createDataFrame(rows, "search_id string, name string, cached_at double"), "search_id")
    writes = writes.select(F.col("search_id").alias("url"), "lead", "cached_at")
    table = cache.put_places(spark.createDataFrame([], PLACE_CACHE), writes, ttl_s=10)
    assert sorted((r.url, r.lead.name) for r in table.collect()) == [("u1 ", "new"), ("u2", "z")]
    again = cache.put_places(table, writes.where("url = 'u2'").withColumn("cached_at", F.lit(0.5)))
    assert sorted(r.cached_at for r in again.collect()) == [2.0, 5.0]
    assert [r.url for r in cache.expire(table, now=12.5).collect()] == ["u1 "]
    gone = spark.createDataFrame([(" U2",)], "url string")
    assert [r.url for r in cache.invalidate_places(table, gone).collect()] == ["u1 "]
    json = sinks.place_cache_to_json(table)
    broken = json.unionByName(spark.createDataFrame([("k", "{oops"), ("m", None)], "key string, value string"))
    assert sorted(r.key for r in sinks.place_cache_from_json(broken).collect()) == sorted(r.key for r in table.collect())
    sinks.write_place_cache(table, str(tmp_path / "pc"))
    assert sinks.read_place_cache(spark, str(tmp_path / "pc")).count() == 2


def test_upsert_quarantine_outcomes(spark):
    batch = spark.createDataFrame([("j", 0, 1, "a"), ("j", 0, 2, "b"), ("j", 1, 3, "a"), ("k", 0, 4, None)], "job_id string, batch_id int, n int, key string")
    known = spark.createDataFrame([("b",)], "key string")
    rows, totals = sinks.upsert_leads(batch, known, ["key"])
    assert {(r.n, r.is_new) for r in rows.collect()} >= {(1, True), (2, False), (3, False)}
    assert {tuple(r) for r in totals.collect()} >= {("j", 0, 2, 1), ("j", 1, 1, 0)}
    good, bad, counters = sinks.quarantine_rejects(batch, F.col("key").isNotNull())
    assert good.count() == 3 and [r.n for r in bad.collect()] == [4]
    assert {tuple(r) for r in counters.collect()} == {("j", 0, 2, 0, 1), ("j", 1, 1, 0, 1), ("k", 0, 0, 1, 0)}

    jobs = spark.createDataFrame([("j", 5), ("k", 5), ("m", 5), ("o", 2)], "job_id string, max_results int")
    endings = spark.createDataFrame([("j", False, None, True), ("k", True, None, True), ("m", False, "e" * 500, None), ("o", None, None, True)],
                                    "job_id string, cancelled boolean, error string, region_exhausted boolean")
    sent = spark.createDataFrame([("j", 1, 1), ("j", 2, 0), ("o", 2, 2)], "job_id string, sent int, new_count int")
    found = {r.job_id: tuple(r)[1:] for r in sinks.job_outcomes(jobs, sent, endings).collect()}
    assert found["j"] == ("complete", 3, 1, True, 5, None) and found["k"] == ("cancelled", 0, 0, None, None, None)
    assert found["m"] == ("error", None, None, None, None, "e" * 400) and found["o"] == ("complete", 2, 2, None, None, None)


def test_writing_a_search_twice_changes_nothing(spark):
    search, leads = [("1", "Bar", "X", "", "BR", 20, 10.0)], [("1", 1, "a"), ("1", 2, "b")]
    first = stored(spark, search, leads)
    for searches in (search, search * 2):
        meta, entries = stored(spark, searches, leads, first)
        assert [r["count"] for r in meta.collect()] == [2]
        assert sorted(r.lead.name for r in entries.collect()) == ["a", "b"]
    older = stored(spark, [("0", "Bar", "X", "", "BR", 20, 5.0)], [("0", 1, "old")], first)
    assert sorted(r.lead.name for r in older[1].collect()) == ["a", "b"]


def test_entries_without_a_search_id_are_refreshed(spark):
    from leadlake.plans.refresh import refresh_requests

    meta, _ = stored(spark, [(None, "Bar", "X", "", "BR", 20, 10.0)], [])
    row = ("h1", None, "bar", "X", "", "BR", 20, 1, 10.0, "", 100)
    jobs = refresh_requests(spark.createDataFrame([row], RESULT_META), 1000.0, 10).collect()
    assert meta.isEmpty() and [(j.job_id, j.search_id, j.keyword) for j in jobs] == [("h1", None, "bar")]


def test_a_missing_path_means_no_state(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("job_id string, epoch int")
    assert sinks.read_before(spark, str(tmp_path / "nowhere"), schema, 3).isEmpty()
    spark.createDataFrame([("a",)], "job_id string").write.parquet(str(tmp_path / "state" / "epoch=1"))
    assert sinks.read_before(spark, str(tmp_path / "state"), schema, 3).count() == 1
    assert sinks.read_before(spark, str(tmp_path / "state"), schema, 1).isEmpty()
