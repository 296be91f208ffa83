import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators.batches import assign_flush_batches
from leadlake.operators.limits import GROUP_LIMIT, cap_by_jobs, cap_per_job, stale_entries
from leadlake.operators.ordered import with_carried, with_rank, with_running_total


def random_rows(seed, count=400):
    rng = random.Random(seed)
    orders = rng.sample(range(-50, 2000), count)
    return [("hot" if rng.random() < 0.5 else f"j{rng.randrange(5)}", o, rng.choice([None, "a", "b"]), rng.randrange(5)) for o in orders]


def grouped(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_pieces_give_the_plain_results(spark, parts):
    rows = random_rows(parts)
    df = spark.createDataFrame(rows, "job string, o bigint, v string, x int")
    ranked = with_rank(df, ["job"], ["o"], "r", parts)
    summed = with_running_total(ranked, ["job"], ["o"], F.col("x"), "s", parts)
    back = with_carried(summed, ["job"], ["o"], F.col("v"), "before", parts)
    both = with_carried(back, ["job"], ["o"], F.col("v"), "after", parts, backwards=True)
    found = {(r.job, r.o): (r.r, r.s, r.before, r.after) for r in both.collect()}
    assert len(found) == len(rows)
    for group in grouped(rows).values():
        for i, row in enumerate(group):
            before = next((r[2] for r in reversed(group[:i]) if r[2] is not None), None)
            after = next((r[2] for r in group[i + 1:] if r[2] is not None), None)
            assert found[row[0], row[1]] == (i + 1, sum(r[3] for r in group[:i]), before, after)


@pytest.mark.parametrize("largest", [None, GROUP_LIMIT + 1])
def test_cap_per_job(spark, largest):
    rows = [(job, o, len(job)) for job, o, _, _ in random_rows(3)]
    df = spark.createDataFrame(rows, "job_id string, n bigint, max_results int")
    expected = sorted((r[0], r[1]) for g in grouped(rows).values() for r in g[: g[0][2]])
    assert sorted((r.job_id, r.n) for r in cap_per_job(df, largest=largest).collect()) == expected
    jobs = df.select("job_id", "max_results").distinct()
    capped = cap_by_jobs(df.drop("max_results"), jobs, largest=largest)
    assert sorted((r.job_id, r.n) for r in capped.collect()) == expected


def test_stale_entries_limits_before_dropping(spark):
    index = spark.createDataFrame([(f"h{i:02}", float(i)) for i in range(60)], "hash string, updated_at double")
    meta = spark.createDataFrame([(f"h{i:02}", "k") for i in range(60) if i % 2], "hash string, keyword string")
    found = sorted(r["hash"] for r in stale_entries(index, meta, now=1000.0, age_s=945, limit=50).collect())
    assert found == [f"h{i:02}" for i in range(50) if i % 2]


def fold(arrivals, size=50, timeout=3.0):
    numbers, number, waiting, last = [], 0, 0, None
    for t in arrivals:
        numbers.append(number)
        waiting += 1
        if last is None or waiting >= size or t >= last + timeout:
            number, waiting, last = number + 1, 0, t
    return numbers


def test_flush_golden(spark):
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate([1.0, 2.0, 3.0, 4.5, 5.0])], "job_id string, n int, arrival_s double")
    assert [r.batch_no for r in assign_flush_batches(df).orderBy("n").collect()] == [0, 1, 1, 1, 2]


@pytest.mark.parametrize("size,block_rows", [(50, 100_000), (4, 4), (4, 9), (7, 50)])
def test_flush_equals_fold(spark, size, block_rows):
    rng = random.Random(size * block_rows)
    rows, expected = [], {}
    for job, count, pace in (("a", 300, 0.3), ("b", 5, 2.0), ("c", 1, 1.0), ("d", 120, 2.5), ("e", 64, 0.01)):
        t, arrivals = 0.0, []
        for _ in range(count):
            t += rng.choice([0.0, pace, 2 * pace, 4.0 if rng.random() < 0.05 else pace])
            arrivals.append(t)
        order = sorted(rng.sample(range(10_000), count))
        rows += [(job, n, t) for n, t in zip(order, arrivals)]
        expected.update({(job, n): b for n, b in zip(order, fold(arrivals, size))})
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id string, n bigint, arrival_s double")
    found = assign_flush_batches(df, size=size, block_rows=block_rows)
    assert {(r.job_id, r.n): r.batch_no for r in found.collect()} == expected


def test_nulls_are_groups_on_both_sides_of_the_limit(spark):
    rows = [(None, 1, 2), (None, None, 2), (None, 3, 2), ("a", None, 1), ("a", 5, 1)]
    df = spark.createDataFrame(rows, "job_id string, n bigint, max_results int")
    wanted = [(None, None), (None, 1), ("a", None)]
    for largest in (5, GROUP_LIMIT + 1):
        found = [(r.job_id, r.n) for r in cap_per_job(df, largest=largest).collect()]
        assert sorted(found, key=str) == sorted(wanted, key=str)


def test_sparse_order_has_one_summary_per_piece(spark, monkeypatch):
    from leadlake.operators import ordered

    written = []
    keep = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    df = spark.range(20_000).select(F.lit("hot").alias("job"), (F.col("id") * 1_000_003).alias("o"))
    assert with_rank(df, ["job"], ["o"], "r", 8).agg(F.count_distinct("r"), F.max("r")).first() == (20_000, 20_000)
    assert written[0].select("_piece", "job").distinct().count() <= 8


def test_batches_of_leads_without_a_job(spark):
    from leadlake.operators.batches import assign_flush_batches

    rows = [(job, n, n * 0.7) for job in (None, "j") for n in range(230)]
    df = spark.createDataFrame(rows, "job_id string, n bigint, arrival_s double")
    for block_rows in (1_000, 60):
        found = {(r.job_id, r.n): r.batch_no for r in assign_flush_batches(df, block_rows=block_rows).collect()}
        assert len(found) == 460 and all(found[None, n] == found["j", n] for n in range(230))
