import random

from pyspark.sql import functions as F

from leadlake.operators.lookup import apply_job_control
from leadlake.streaming import progress
from leadlake.plans.leads import leads_from_pages
from leadlake.streaming.leads import (
    call_for_each, deliver_to, judged_visits, leads_of, start, stream_control, stream_leads, stream_page_leads, stream_visits, waiting_leads,
)
from leadlake.streaming.state import first_leads
from tests.test_dedup import random_rows, sequential
from workload.inputs import derived
from workload.streams import finish, pages_of

SF = "/root/testdata/sf0.001"


def in_files(df, path, order, files):
    """Split a table by order into one file per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // files)
    for i in range(files):
        part = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def kept_rows(df):
    return sorted((r.job_id, r.n) for r in df.select("job_id", "n").collect())


def test_first_leads_over_batches_equals_sequential(spark, tmp_path):
    rows = random_rows(21, 240, hot=0.5)
    capped, seen = [], {}
    for r in rows:
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] <= 25:
            capped.append(r[:5])
    visits = spark.createDataFrame([(*r[:5], f"u{r[1]}", 25, True, f"lead {r[1]}") for r in rows],
                                   "job_id string, n bigint, name string, city string, phone string, url string, max_results int, accepted boolean, lead string")
    for files in (1, 4):
        stream = in_files(visits, str(tmp_path / f"in{files}"), "n", files)
        out = str(tmp_path / f"out{files}")
        finish(first_leads(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(out))
        found = spark.read.parquet(out)
        assert kept_rows(found) == sequential(capped)
        assert all(r.lead == f"lead {r.n}" for r in found.collect())


def test_a_link_counts_once_but_uses_the_limit(spark, tmp_path):
    schema = "job_id string, n bigint, url string, max_results int, accepted boolean, name string, city string, phone string, lead string"
    rows = [("j", 1, "a", 4, True, "x", "c", None, "1"), ("j", 2, "a", 4, True, "y", "c", None, "2"), ("j", 3, None, 4, False, "z", "c", None, "3"),
            ("j", 4, None, 4, True, "Z", "c", "11", "4"), ("j", 5, "b", 4, True, "v", "c", None, "5"), ("k", 9, "a", None, True, "v", "c", None, "9")]
    stream = in_files(spark.createDataFrame(rows, schema), str(tmp_path / "in"), "n", 3)
    finish(first_leads(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")))
    assert [r.lead for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()] == ["1", "4"]


def test_stream_equals_batch_and_survives_failing_hooks(spark, tmp_path):
    from leadlake.operators.dedup import dedup_leads
    from leadlake.operators.limits import cap_by_jobs
    from leadlake.plans.leads import accepted_leads, build_leads, job_context
    from leadlake.schemas import LEAD_COLUMNS

    places = derived(spark, SF, "places")
    expected = dedup_leads(accepted_leads(build_leads(cap_by_jobs(places, job_context(derived(spark, SF, "jobs"))))))
    calls, seen = [], tmp_path / "seen"
    seen.mkdir()

    def hook(leads, epoch):
        calls.append(epoch)
        raise ValueError("hook")

    def on_lead(lead, folder=str(seen)):
        open(f"{folder}/{lead['job_id']}-{lead['n']}", "w").close()
        if lead["n"] % 3 == 0:
            raise ValueError("lead")

    stream = in_files(places, str(tmp_path / "in"), "n", 3)
    out = str(tmp_path / "out")
    finish(stream_leads(stream, derived(spark, SF, "jobs"), out, on_leads=hook, on_lead=on_lead, available_now=True))
    found = spark.read.parquet(f"{out}/leads").drop("epoch")
    columns = ["job_id", "n", *LEAD_COLUMNS]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    assert calls == [0, 1, 2]
    # Every lead was handed over, whether or not others failed.
    assert sorted(p.name for p in seen.iterdir()) == sorted(f"{j}-{n}" for j, n in kept_rows(expected))


def test_failed_calls_are_counted(spark):
    def on_lead(lead):
        if lead["n"] % 3 == 0:
            raise ValueError("lead")

    assert tuple(call_for_each(spark.range(10).withColumnRenamed("id", "n"), on_lead)) == (10, 4)
    assert tuple(call_for_each(spark.range(0).withColumnRenamed("id", "n"), on_lead)) == (0, 0)


def captures_of(spark):
    cards = derived(spark, SF, "place_cards").withColumnRenamed("position", "n")
    return cards.join(pages_of(spark, SF), "url", "left")


def test_pages_in_many_batches_and_after_a_restart_equal_the_plan(spark, tmp_path):
    jobs = derived(spark, SF, "jobs")
    expected = kept_rows(leads_from_pages(jobs, derived(spark, SF, "place_cards"), pages_of(spark, SF)))
    captures = captures_of(spark).cache()
    for files in (1, 3, 10):
        stream = in_files(captures, str(tmp_path / f"in{files}"), "n", files)
        out = str(tmp_path / f"out{files}")
        finish(stream_page_leads(stream, jobs, out, available_now=True))
        assert kept_rows(spark.read.parquet(f"{out}/leads")) == expected
    # Half of the pages, then a new query on the same checkpoint.
    rows = captures.orderBy("n").collect()
    half, path, out = len(rows) // 2, str(tmp_path / "halves"), str(tmp_path / "restarted")
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, captures.schema).coalesce(1).write.mode("append").parquet(path)
        finish(stream_page_leads(spark.readStream.schema(captures.schema).parquet(path), jobs, out, available_now=True))
    assert kept_rows(spark.read.parquet(f"{out}/leads")) == expected


def test_jobs_and_visits_meet_in_either_order(spark, tmp_path):
    places = derived(spark, SF, "places").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") % 600))
    jobs = derived(spark, SF, "jobs").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200)))
    static = str(tmp_path / "static")
    finish(stream_leads(in_files(places, str(tmp_path / "p"), "n", 1), jobs.drop("at"), static, available_now=True))
    for first in ("jobs", "places"):
        out, folders = str(tmp_path / first), {"jobs": str(tmp_path / f"{first}-j"), "places": str(tmp_path / f"{first}-p")}
        tables = {"jobs": jobs, "places": places}
        for name, table in tables.items():
            table.limit(0).write.parquet(folders[name])
        streams = lambda: [spark.readStream.schema(tables[n].schema).parquet(folders[n]) for n in ("places", "jobs")]
        for name in (first, "places" if first == "jobs" else "jobs"):
            tables[name].coalesce(1).write.mode("append").parquet(folders[name])
            finish(stream_visits(*streams(), out, available_now=True))
        visits = spark.read.parquet(f"{out}/visits")
        stream = spark.readStream.schema(visits.schema).parquet(f"{out}/visits")
        finish(stream_leads_of(stream, out))
        assert kept_rows(spark.read.parquet(f"{out}/leads")) == kept_rows(spark.read.parquet(f"{static}/leads"))


def stream_leads_of(visits, out):
    """Leads of visits that have their job's search already."""
    return start(leads_of(judged_visits(visits)), deliver_to(out, None, None), f"{out}/checkpoint", True)


def test_control_of_shuffled_events_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for t in range(300):
        status = rng.choice(["paused", "paused", "running", "cancelled" if t > 200 else "running"]) if rng.random() < 0.2 else None
        rows.append((f"j{rng.randrange(6)}", t if status is None else None, (t + 1) * 1_000_000, status))
    schema = "job_id string, n bigint, ts bigint, status string"
    events = spark.createDataFrame(rows, schema)
    batch = apply_job_control(events.where("status is null").drop("status"), events.where("status is not null").select("job_id", "status", "ts"))
    expected = {(r.job_id, r.n): r.release_ts for r in batch.where("disposition = 'delivered'").collect()}
    held = {(r.job_id, r.n) for r in batch.where("disposition = 'held'").collect()}
    assert expected and held
    for name, key in (("ordered", lambda r: r[2]), ("shuffled", lambda r: r[2] + rng.randrange(20_000_000))):
        arriving, path, out = sorted(rows, key=key), str(tmp_path / f"{name}-in"), str(tmp_path / name)
        for i in range(0, 300, 60):
            spark.createDataFrame(arriving[i : i + 60], schema).coalesce(1).write.mode("append").parquet(path)
            finish(stream_control(spark.readStream.schema(schema).parquet(path), out, delay="30 seconds", available_now=True))
        # The clock event ends the log; an event behind the watermark comes too late.
        for last in ([(None, None, 10**10, None)], [("j0", 999, 0, None)]):
            spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(path)
            finish(stream_control(spark.readStream.schema(schema).parquet(path), out, delay="30 seconds", available_now=True))
        assert {(r.job_id, r.n): r.release_ts for r in spark.read.parquet(f"{out}/delivered").collect()} == expected
        assert {(r.job_id, r.n) for r in waiting_leads(spark, out).collect()} == held


def test_live_metrics_and_progress_equal_batch(spark, tmp_path):
    events = derived(spark, SF, "job_events").withColumn("started_at", F.timestamp_micros(F.lit(1_704_067_200_000_000)))
    stream = in_files(events, str(tmp_path / "e"), "ts_us", 3)
    out = str(tmp_path / "m")
    finish(progress.write_updates(progress.live_job_metrics(stream, "started_at"), out, available_now=True))
    live = progress.latest_updates(spark.read.parquet(f"{out}/updates")).drop("started_at")
    batch = progress.live_job_metrics(events)
    assert sorted(live.select(*batch.columns).collect()) == sorted(batch.collect())

    places, jobs = derived(spark, SF, "places"), derived(spark, SF, "jobs")
    out = str(tmp_path / "p")
    finish(progress.write_updates(progress.live_progress(in_files(places, str(tmp_path / "l"), "n", 2), jobs), out, available_now=True))
    batch = progress.live_progress(places, jobs)
    assert sorted(progress.latest_updates(spark.read.parquet(f"{out}/updates")).select(*batch.columns).collect()) == sorted(batch.collect())


def test_replayed_batches_change_nothing(spark, tmp_path):
    from leadlake.sources.sinks import read_leads, store_leads, upsert_leads

    schema = "job_id string, batch_id int, n bigint, name string"
    path, batches = str(tmp_path / "leads"), [[("j", 0, 1, "a"), ("j", 0, 2, "b")], [("j", 1, 3, "b"), ("j", 1, 4, "c"), ("k", 0, 1, "a")]]
    outcomes = []
    for d in [0, 1, 1, 0]:
        batch = spark.createDataFrame(batches[d], schema)
        known = read_leads(spark, path, batch.schema)
        _, totals = upsert_leads(batch, known, ["name"])
        outcomes.append(sorted((r.job_id, r.batch_id, r.sent, r.new_count) for r in totals.collect()))
        store_leads(batch, path, d)
    assert outcomes[1] == outcomes[2] == [("j", 1, 2, 1), ("k", 0, 1, 0)]
    stored = read_leads(spark, path, batch.schema)
    assert sorted((r.job_id, r.batch_id, r.n) for r in stored.collect()) == [("j", 0, 1), ("j", 0, 2), ("j", 1, 3), ("j", 1, 4), ("k", 0, 1)]


def test_updates_fold_into_a_snapshot(spark, tmp_path):
    out = str(tmp_path / "live")
    rows = spark.createDataFrame([(f"j{i % 3}", i, f"name {i}") for i in range(1, 22)], "job_id string, n bigint, name string")
    jobs = spark.createDataFrame([(f"j{i}", 10) for i in range(3)], "job_id string, max_results int")
    live = progress.live_progress(in_files(rows, str(tmp_path / "in"), "n", 7), jobs)
    finish(progress.write_updates(live, out, available_now=True, fold_epochs=2))
    found = progress.read_updates(spark, out)
    # Three snapshots were made: one row per job, and the one epoch after it; what only the first two needed is gone.
    assert found.where("epoch <= 5").count() == 3 and {r.epoch for r in found.where("epoch > 5").collect()} <= {6}
    assert progress._epochs(spark, out) == [4, 5, 6] and len(list((tmp_path / "live" / "snapshots").iterdir())) == 2
    expected = sorted(tuple(r) for r in progress.live_progress(rows, jobs).collect())
    assert sorted(tuple(r) for r in progress.latest_updates(found).collect()) == expected
    progress.fold_updates(spark, out, 5)
    assert sorted(tuple(r) for r in progress.latest_updates(progress.read_updates(spark, out)).collect()) == expected
