import hashlib
import random

import numpy as np
import pytest

from leadlake.llm.embeddings import near_vectors
from leadlake.llm.graph import components
from leadlake.llm.near_dedup import near_duplicates, similarity
from leadlake.llm.repeats import intervals, maximal_repeats, remove_repeats

SCHEMA = "doc_id bigint, text string, lang string, node string, rank int, row string, key int, block int"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "n", 1, "r", 2, 3) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    want = roots({x for link in links if link[0] != link[1] for x in link}, links)
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5])]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(20)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [float("inf")] + [1.0] * 15), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, unit_no string")
    found = {r.vec_id: r for r in near_vectors(df).collect()}
    x = np.array([np.float32(v) for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(range(len(rows)), zip(*np.nonzero(near)))
    for i in range(len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (near[i].sum(), want[i], want[i] == i)
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(900, 906))
    assert (found[906].n_links, found[907].component_id) == (1, 906)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "".join(rng.choice("klmnop") for _ in range(4))
    return out


@pytest.mark.parametrize("limits", [{}, {"tile_rows": 2, "tiles_together": 2}, {"tile_rows": 2, "tiles_together": 1, "partings": 1}])
def test_classes_equal_brute_force(spark, limits):
    rng = random.Random(11)
    texts, passage = [], words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.choice([40, 120, 300]))
        texts += [" ".join(edited(rng, base, e)) for e in (0, 0, 1, 2, 5, 9)]
    texts += [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(30)]
    texts += [None, "", "  ", "two words", "Two   words", "other pair", " ".join(["same"] * 500)]
    found = {r.doc_id: r for r in near_duplicates(table(spark, texts), **limits).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    assert {i: r.class_id for i, r in found.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in found.items())


def test_repeated_rows_are_copies(spark):
    df = table(spark, ["a b c d e f g", "a b c d e f g", None, "q"], [4, 4, None, 1])
    rows = near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in rows) == [(-1, True), (1, True), (4, False), (4, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alignment_follows_the_order():
    a = np.arange(100, dtype=np.uint64)
    assert similarity(a, a, 0.8) == 1.0
    assert similarity(a, np.roll(a, 50), 0.8) < 0.8
    assert abs(similarity(a, np.delete(a, slice(40, 50)), 0.8) - 0.9) < 1e-12


def test_stack_scan_finds_the_intervals():
    text = "banana$bandana#an"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [len(np.flatnonzero(np.cumprod([x == y for x, y in zip(text[i:], text[j:])]))) for i, j in zip(order, order[1:])]
    found = {(text[order[a] : order[a] + d], b - a + 1) for a, b, d in intervals(np.array(lcp), 1)}
    want = set()
    for i in range(len(text)):
        for n in range(1, len(text) - i + 1):
            part = text[i : i + n]
            starts = [j for j in range(len(text)) if text.startswith(part, j)]
            if len(starts) > 1 and len({text[j + n : j + n + 1] or j for j in starts}) > 1:
                want.add((part, len(starts)))
    assert found == want


def repeat_texts(seed):
    rng = random.Random(seed)
    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passage, other = noise(260), noise(130)
    texts = [noise(rng.randrange(300)) + passage[rng.randrange(60) : 200 + rng.randrange(60)] + noise(rng.randrange(200)) for _ in range(12)]
    texts += [other + noise(50) + other, noise(40) + other + passage, "ab" * 300, "xyz" * 50 + "ab" * 100, "z" * 99, "z" * 99, "z" * 100, None, "", texts[3], texts[3], "z" * 450]
    rng.shuffle(texts)
    return texts


def cut(texts, window):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            part = data[p : p + window]
            if part in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(part)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed,together", [(1, 20_000), (2, 20_000), (3, 1)])
def test_removed_repeats_equal_brute_force(spark, seed, together):
    texts = repeat_texts(seed)
    found = remove_repeats(table(spark, texts).repartition(3), together=together).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == cut(texts, 100)


def test_repeat_groups_hold_all_occurrences(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(110))
    texts = ["".join(rng.choice("ijklmn") for _ in range(80)) + passage + "".join(rng.choice("opqrst") for _ in range(80)) for _ in range(5)]
    found = maximal_repeats(table(spark, texts)).collect()
    covered = {(r.doc_id, i) for r in found for i in range(r.start, r.start + r.length)}
    assert covered >= {(d, i) for d in range(5) for i in range(80, 190)}
    for r in found:
        first = texts[r.first_doc].encode()[r.first_start : r.first_start + r.length]
        assert r.length >= 100 and texts[r.doc_id].encode()[r.start : r.start + r.length] == first
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_lose_all_but_one(spark):
    found = remove_repeats(table(spark, ["q" * 10 + "w" * 95, "q" * 10 + "w" * 95, "short", "short"], [3, 3, None, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, 0), (3, 0), (3, 105)]
