"""Commits of leads and of the result cache: replays, crashes, readers beside writers, pruned reads."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from leadlake.operators.lookup import flag_new_leads, lookup_result_cache
from leadlake.schemas import RESULT_ENTRY, RESULT_META
from leadlake.sources import manifests, sinks
from tests.test_cache import stored

SCHEMA = "job_id string, batch_id int, n bigint, name string"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows_of(spark, path, schema):
    return sorted(str(tuple(r)) for r in sinks.read_leads(spark, path, schema).collect())


def delivery(spark, d, rows=3):
    return spark.createDataFrame([("j" if i % 2 else None, d, 10 * d + i, f"name {i}") for i in range(rows)], SCHEMA)


def test_deliveries_fold_by_level(spark, tmp_path):
    path, wanted = str(tmp_path / "leads"), []
    schema = delivery(spark, 0).schema
    assert rows_of(spark, path, schema) == []
    for d in range(10):
        batch = delivery(spark, d)
        wanted += [tuple(r) for r in batch.collect()]
        sinks.store_leads(batch, path, d, ["name"], fold=3)
        live = sinks._segments(manifests.names_in(spark, f"{path}/log"))
        # As many segments as the digits of the number of deliveries to the base 3 add up to.
        assert len(live) == sum((d + 1) // 3**k % 3 for k in range(4))
        assert rows_of(spark, path, schema) == sorted(map(str, wanted))
    before = sorted(os.listdir(tmp_path / "leads" / "files"))
    sinks.store_leads(delivery(spark, 4), path, 4, ["name"], fold=3)
    assert sorted(os.listdir(tmp_path / "leads" / "files")) == before
    sinks.clear_folded(spark, path)
    assert len(os.listdir(tmp_path / "leads" / "files")) == 2
    assert sinks.read_leads(spark, path, schema).count() == len(wanted)


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "leads"), delivery(spark, 0).schema
    sinks.store_leads(delivery(spark, 0), path, 0)

    def crash(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "publish", crash)
        for d, rows in ((1, 3), (0, 1)):
            with pytest.raises(RuntimeError):
                sinks.store_leads(delivery(spark, d, rows), path, d)
    assert sinks.read_leads(spark, path, schema).count() == 3
    sinks.store_leads(delivery(spark, 1), path, 1)
    sinks.clear_folded(spark, path)
    assert sinks.read_leads(spark, path, schema).count() == 6 and len(os.listdir(tmp_path / "leads" / "files")) == 2


def test_a_manifest_is_published_once(spark, tmp_path):
    folder = str(tmp_path)
    manifests.publish(spark, folder, "a.json", {"v": 1})
    with pytest.raises(manifests.CommitConflict):
        manifests.publish(spark, folder, "a.json", {"v": 2})
    assert manifests.load(spark, folder, "a.json") == {"v": 1} and manifests.names_in(spark, folder) == ["a.json"]
    manifests.publish(spark, folder, "a.json", {"v": "ção"}, replace=True)
    assert manifests.load(spark, folder, "a.json") == {"v": "ção"}
    assert manifests.names_in(spark, f"{folder}/nowhere") == []


def searches(n, at=10.0):
    return [(str(i), f"k{i}", "X", "", "BR", 20, at) for i in range(n)]


def test_readers_keep_their_version_and_emptied_parts_go(spark, tmp_path):
    path = str(tmp_path)
    old = stored(spark, searches(12), [(str(i), 1, "old") for i in range(12)])
    assert sinks.cache_version(spark, path) == 0
    assert sinks.write_result_cache(*old, path, part_chars=1) == 1
    reading = sinks.read_result_cache(spark, path)
    # All but the searches of one part expire; k3 is written again.
    renewed = stored(spark, [("n", "k3", "X", "", "BR", 20, 50.0)], [("n", 1, "new")], sinks.read_result_cache(spark, path))
    lone = renewed[0].where("keyword = 'k3'").first().hash[0]
    keep = F.left("hash", F.lit(1)) == lone
    assert sinks.write_result_cache(renewed[0].where(keep), renewed[1].where(keep), path, part_chars=1, changed_since=50.0, based_on=1) == 2
    assert {r.lead.name for r in reading[1].collect()} == {"old"} and reading[0].count() == 12
    meta, entries = sinks.read_result_cache(spark, path)
    assert {r.part for r in meta.collect()} == {r.part for r in entries.collect()} == {lone}
    assert "new" in {r.lead.name for r in entries.collect()}
    with pytest.raises(manifests.CommitConflict):
        sinks.write_result_cache(*renewed, path, part_chars=1, changed_since=50.0, based_on=1)
    with pytest.raises(manifests.CommitConflict):
        sinks.write_result_cache(*renewed, path, part_chars=1)
    shown = sorted(map(str, entries.collect()))
    sinks.clear_old_versions(spark, path)
    assert sorted(map(str, sinks.read_result_cache(spark, path)[1].collect())) == shown and len(os.listdir(tmp_path / "entries")) == 1


def test_an_empty_cache_is_stored_and_read(spark, tmp_path):
    none = spark.createDataFrame([], RESULT_META), spark.createDataFrame([], RESULT_ENTRY)
    assert sinks.write_result_cache(*none, str(tmp_path)) == 1
    meta, entries = sinks.read_result_cache(spark, str(tmp_path))
    assert meta.isEmpty() and entries.isEmpty()
    asked = spark.createDataFrame([("k1", "X", "", "BR")], "keyword string, city string, state string, country string")
    assert lookup_result_cache(asked, meta, entries, 5.0).isEmpty()


def test_a_lookup_reads_only_the_parts_asked_for(spark, tmp_path):
    n = 60
    tables = stored(spark, searches(n), [(str(i), 1, f"lead {i}") for i in range(n)])
    sinks.write_result_cache(*tables, str(tmp_path), part_chars=1)
    asked = spark.createDataFrame([("k7", "X", "", "BR"), ("K8 ", "x", "", "br"), ("k99", "X", "", "BR")], "keyword string, city string, state string, country string")
    found = lookup_result_cache(asked, *sinks.read_result_cache(spark, str(tmp_path)), 20.0, part_chars=1)
    assert "dynamicpruning" in plan_of(found)
    assert sorted(r.lead.name for r in found.collect()) == ["lead 7", "lead 8"]
    plain = lookup_result_cache(asked, *tables, 20.0)
    assert sorted(found.columns) == sorted(plain.columns) and sorted(r.lead.name for r in plain.collect()) == ["lead 7", "lead 8"]


def test_known_leads_are_not_shuffled(spark, tmp_path):
    spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k")).write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    batch = spark.createDataFrame([("k1",), ("x",), (None,)], "k string")
    plan = plan_of(flag_new_leads(batch, known, ["k"]).where("is_new"))
    assert "BroadcastHashJoin LeftSemi" in plan and "SortMergeJoin LeftSemi" not in plan
