"""Runs and Lyndon arrays against their definitions."""

import hashlib
import random
import zlib

import numpy as np

from leadlake.llm.periodic import Searcher, find_runs, lyndon_lengths, runs_of
from leadlake.llm.queries import QUERIES


def plain_lyndon(word):
    lengths = []
    for i in range(len(word)):
        ends = [j for j in range(i + 1, len(word) + 1) if all(word[i:j] < word[k:j] for k in range(i + 1, j))]
        lengths.append(max(ends) - i)
    return lengths


def plain_runs(word, least):
    word, found = np.array(word), []
    for q in range(1, len(word) // 2 + 1):
        same = np.concatenate([[False], word[q:] == word[:-q], [False]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            whole = word[start : end + q]
            if end - start >= q and len(whole) >= least and not any((whole[p:] == whole[:-p]).all() for p in range(1, q)):
                found.append((start, len(whole), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_word(rng, most=40):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(1, most)
    word = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.4:
        p = rng.randrange(1, max(2, n // 3))
        word = [word[i % p] if i > n // 4 else word[i] for i in range(n)]
    return word


def test_grouping_gives_the_longest_lyndon_words():
    rng = random.Random(1)
    for _ in range(600):
        word = random_word(rng)
        assert lyndon_lengths(word) == plain_lyndon(word)
    assert lyndon_lengths([]) == []


def test_runs_equal_the_definition():
    rng = random.Random(2)
    for _ in range(600):
        word = random_word(rng)
        for least in (2, 4, 12):
            assert runs_of(word, least) == plain_runs(word, least)


def collapsed(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_only_repeating_stretches_are_searched_and_nothing_is_lost():
    rng = random.Random(3)
    search = Searcher(12)
    for _ in range(400):
        texts = [" ".join(f"w{x}" for x in random_word(rng, 90)).encode() for _ in range(rng.randrange(4))] + [b"", b" \n "]
        for text, (runs, left) in zip(texts, search(texts)):
            ids = {}
            words = text.split()
            want = plain_runs([ids.setdefault(w, len(ids)) for w in words], 12) if words else []
            assert runs == want and left == collapsed(words, want)


def test_long_texts_and_letter_case():
    words = [f"w{i}" for i in random.Random(4).sample(range(200_000), 100_000)]
    text = " ".join(words + words + words[:7] + ["A", "a"] * 3 + ["b"] * 100_000).encode()
    [(runs, left)] = Searcher(12)([text])
    assert runs == [(0, 200_007, 100_000), (200_013, 100_000, 1)]
    assert left == " ".join(words + ["A", "a"] * 3 + ["b"]).encode()


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids = {}
    runs = plain_runs([ids.setdefault(w, len(ids)) for w in words], 12) if words else []
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def test_the_query_equals_plain_python(spark, tmp_path):
    for sf in ("/root/testdata/sf0.001", str(tmp_path)):
        if sf == str(tmp_path):
            rows = [(None, "a b " * 30), (1, None), (2, ""), (3, "x"), (4, "a a\ta\n" * 5), (4, "a a\ta\n" * 5), (9, " é è " * 12)]
            rows += [(i, " ".join(f"w{i * j % 7}" for j in range(i % 50))) for i in range(10, 200)]
            spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        found = QUERIES["op12_lyndon_runs"](spark, sf)
        assert sorted(map(tuple, found.collect()), key=str) == sorted((digest(*r) for r in rows), key=str)


def test_rows_come_along_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "z " * 20, "r", 5)], "doc_id long, text string, runs string, n_words int")
    [row] = find_runs(docs).collect()
    assert row.document.asDict() == {"doc_id": 1, "text": "z " * 20, "runs": "r", "n_words": 5}
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed_text) == (20, [(0, 20, 1)], "z")
    assert find_runs(docs.limit(0)).count() == 0
