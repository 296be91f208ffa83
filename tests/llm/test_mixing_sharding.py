import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlake.llm.mixing import fit_lengths, mix_sources, repeated
from leadlake.llm.sharding import kd_shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, budget int"


def rows(seed, n=300):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        text = " ".join(rng.choice(["a", "bb", "ccc"]) for _ in range(rng.choice([0, 1, 5, 20, 60])))
        if i % 7 == 0:
            text = "same text for all of these"
        made.append((i, None if i % 31 == 0 else text, rng.choice(["en", None]), rng.choice(["s0", "s0", "s0", "s1", "é", None]), len(text), 1, "x", 2))
    return made + made[:3]


def water(sizes, weights, cap):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [cap * s if i in capped else rest * w / share for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, t in enumerate(targets) if t > cap * sizes[i]} - capped
        if not over:
            return targets
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    made = rows(seed)
    df = spark.createDataFrame(made, SCHEMA)
    found = mix_sources(df).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in made)
    sizes = Counter()
    for r in made:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = dict(zip(order, water([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], 3)))
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert 0 <= r.times <= 3 and r.taken == r.times * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= 6
    again = mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


def test_mix_of_nothing_and_of_empty_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0, 1, "", 1), (2, "", None, "s", 0, 1, "", 1)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_repeated_rows_follow_the_mix(spark):
    df = spark.createDataFrame(rows(5)[:300], SCHEMA)
    mixed = mix_sources(df)
    want = Counter({r.doc_id: r.times for r in mixed.collect() if r.times})
    out = repeated(df, mixed)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == want


@pytest.mark.parametrize("seed", range(20))
def test_knapsack_is_as_good_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), 6, replace=False)).astype(np.int64)
    counts = rng.integers(1, 5, 6).astype(np.int64)
    budget = int(rng.integers(1, (lengths * counts).sum() + 10))
    reach = {0}
    for length, count in zip(lengths, counts):
        reach = {s + k * int(length) for s in reach for k in range(count + 1)}
    best = max(s for s in reach if s <= budget)
    taken = fit_lengths(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    got = int((taken * lengths).sum())
    assert got <= budget and best - got <= int(lengths.min())
    assert (fit_lengths(lengths, counts, budget, knapsack=5) * lengths).sum() <= budget


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards_are_even_and_keep_texts_together(spark, shards):
    rng = random.Random(shards)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 200))) for _ in range(1500)]
    made = [(i, None if i == 9 else t, rng.choice(["en", "de", None]), f"src{rng.randrange(9)}", len(t), 0, "", 0) for i, t in enumerate(texts)]
    made += [(2000 + i, texts[5], "en", "src1", 7, 0, "", 0) for i in range(12)] + [(4000 + i, "hot " * 20, "en", "src1", 7, 0, "", 0) for i in range(900)]
    made += made[:2]
    found = kd_shards(spark.createDataFrame(made, SCHEMA), shards).collect()
    by_id = {r[0]: (r[1] or "").encode() for r in made}
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in made)
    weight, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert (r.size, r.text_crc32) == (len(by_id[r.doc_id]) + 1, zlib.crc32(by_id[r.doc_id]))
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[by_id[r.doc_id]].add(r.shard)
    assert sorted(weight) == list(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(weight.values()) - min(weight.values()) <= 0.05 * sum(weight.values()) / shards
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith(b"hot"))


def test_shards_of_nothing(spark):
    assert kd_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    one = kd_shards(spark.createDataFrame([(None, None, None, None, None, 1, "", 1)], SCHEMA)).collect()
    assert [(r.size, r.slot) for r in one] == [(1, 0)]


def test_native_plans_have_no_python(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    plan = kd_shards(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
