import random
import re

import pytest
from pyspark.sql import functions as F

from leadlake.operators.dedup import dedup_leads, dedup_urls, unique_lead_count

SCHEMA = "job_id string, n bigint, name string, city string, phone string"


def sequential(rows):
    kept, names, phones = [], set(), set()
    for job, n, name, city, phone in sorted(rows, key=lambda r: (r[0], r[1])):
        if (job, name, city) in names or (phone and (job, phone) in phones):
            continue
        names.add((job, name, city))
        if phone:
            phones.add((job, phone))
        kept.append((job, n))
    return kept


def kept_rows(df):
    return sorted((r.job_id, r.n) for r in df.select("job_id", "n").collect())


@pytest.mark.parametrize("group_rows", [200_000, 1])
def test_order_matters(spark, group_rows):
    rows = [("j", 1, "a", "x", "1"), ("j", 2, "b", "x", "1"), ("j", 3, "b", "x", "2"), ("j", 4, "a", "x", "3"), ("j", 5, "c", "x", "3"),
            ("j", 6, "", "", None), ("j", 7, None, None, ""), ("k", 8, "a", "x", "1")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert kept_rows(dedup_leads(df, group_rows=group_rows)) == [("j", 1), ("j", 3), ("j", 5), ("j", 6), ("k", 8)]


def random_rows(seed, count, hot):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < hot else f"j{rng.randrange(4)}", n, f"n{rng.randrange(12)}", "x",
         None if rng.random() < 0.3 else "7" if rng.random() < 0.4 else str(rng.randrange(30)))
        for n in range(count)
    ]


@pytest.mark.parametrize("seed,group_rows", [(1, 200_000), (2, 5), (3, 20), (4, 1)])
def test_equals_sequential_loop(spark, seed, group_rows):
    rows = random_rows(seed, 300, hot=0.4)
    expected = sequential(rows)
    for partitions in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        assert kept_rows(dedup_leads(df, group_rows=group_rows)) == expected


def test_result_is_stable_under_repetition(spark):
    df = spark.createDataFrame(random_rows(9, 200, hot=0.5), SCHEMA)
    once = dedup_leads(df)
    assert kept_rows(dedup_leads(once)) == kept_rows(once)
    counts = {r.job_id: r.unique_leads for r in unique_lead_count(once).collect()}
    assert sum(counts.values()) == len(kept_rows(once))


def test_chain_of_conflicts(spark):
    rows = [("j", n, f"n{n // 2}", "x", f"p{(n + 1) // 2}") for n in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert kept_rows(dedup_leads(df, group_rows=3)) == sequential(rows)


@pytest.mark.parametrize("group_rows", [200_000, 7, 1])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_rows_without_a_job_are_a_job_of_their_own(spark, group_rows, kind):
    rows = random_rows(11, 200, hot=0.5)
    ids = {job: n for n, job in enumerate(sorted({r[0] for r in rows} - {"hot"}))}
    jobs = {r[0]: None if r[0] == "hot" else ids[r[0]] if kind == "bigint" else r[0] for r in rows}
    df = spark.createDataFrame([(jobs[r[0]], *r[1:]) for r in rows], SCHEMA.replace("job_id string", f"job_id {kind}"))
    found = {(r.job_id, r.n) for r in dedup_leads(df, group_rows=group_rows).select("job_id", "n").collect()}
    assert found == {(jobs[job], n) for job, n in sequential(rows)}


def test_stars_and_random_keys_take_few_rounds(spark, monkeypatch):
    from leadlake.operators import dedup

    rounds, blocks = [], []
    winners, ranked = dedup._round_winners, dedup.with_rank
    monkeypatch.setattr(dedup, "_round_winners", lambda *a: rounds.append(1) or winners(*a))
    monkeypatch.setattr(dedup, "with_rank", lambda *a: blocks.append(1) or ranked(*a))
    rng = random.Random(12)
    # One phone under many names, one name under many phones, and pairs of them.
    star = [("j", n, "hub" if n % 3 == 0 else f"n{n}", "x", "7" if n % 3 == 1 else str(1000 + n // 2)) for n in range(600)]
    mixed = [("j", n, f"n{rng.randrange(150)}", "x", str(rng.randrange(150))) for n in range(2_000)]
    for rows in (star, mixed):
        del rounds[:], blocks[:]
        df = spark.createDataFrame(rows, SCHEMA)
        assert kept_rows(dedup_leads(df, group_rows=10)) == sequential(rows)
        assert len(rounds) <= 10 and not blocks


def test_dedup_urls(spark):
    cards = spark.createDataFrame([("j", 2, "u", "b"), ("j", 1, "u", "a"), ("j", 3, "v", "c"), ("k", 1, "u", "d")], "job_id string, position int, url string, name string")
    assert sorted(tuple(r) for r in dedup_urls(cards).collect()) == [("j", 1, "u", "a"), ("j", 3, "v", "c"), ("k", 1, "u", "d")]


def test_first_cards_are_sorted_by_a_number_before_the_links(spark, capsys):
    cards = spark.createDataFrame([("j", 2, "u", "b")], "job_id string, position int, url string, name string")
    dedup_urls(cards).explain()
    sorts = re.findall(r"Sort \[(\w+)#", capsys.readouterr().out)
    assert sorts and set(sorts) == {"_hash_first"}


def test_first_cards_keep_null_keys_apart(spark):
    cards = spark.createDataFrame([(None, 2, "u", "b"), (None, 1, "u", "a"), ("j", 3, None, "c"), ("j", 1, None, "d"), (None, 5, None, "e")],
                                  "job_id string, position int, url string, name string")
    assert {tuple(r) for r in dedup_urls(cards).collect()} == {(None, 1, "u", "a"), ("j", 1, None, "d"), (None, 5, None, "e")}


def test_long_chain_takes_one_step_per_block(spark, monkeypatch):
    from leadlake.operators import dedup

    count, steps = 20_000, []
    decide = dedup._decide_in_order
    monkeypatch.setattr(dedup, "_decide_in_order", lambda *a: steps.append(1) or decide(*a))
    chain = spark.range(count).select(
        F.lit("j").alias("job_id"), F.col("id").alias("n"), F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("name"), F.lit("x").alias("city"),
        F.concat(F.lit("9"), F.lpad(F.floor((F.col("id") + 1) / 2).cast("string"), 8, "0")).alias("phone"))
    kept = {r.n for r in dedup_leads(chain, group_rows=5_000).select("n").collect()}
    names, phones, expected = set(), set(), set()
    for n in range(count):
        if n // 2 not in names and (n + 1) // 2 not in phones:
            names.add(n // 2), phones.add((n + 1) // 2), expected.add(n)
    assert kept == expected and len(steps) <= 1 + count // 5_000
