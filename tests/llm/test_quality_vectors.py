"""Subword embeddings: held-out accuracy, features against a plain count, defined cases."""

import zlib

import numpy as np
import pytest

from leadlake.llm import quality_vectors as qv
from leadlake.llm.queries import QUERIES
from leadlake.llm.quality_vectors import BUCKETS, descend, features, score_quality, start_weights, totals

TEXTS = [b"", b"a", b"a a a", b"  x y ", "naïve été\nà".encode(), b"", b"it is so " * 50]


def plain_number(text):
    words, n = text.split(), 0
    for word in words:
        padded = b" " + word + b" "
        n += sum(1 for k in qv.NGRAMS for i in range(len(padded) - k + 1) if not (padded[i] == 32 and padded[i + k - 1] == 32))
    return n + len(words) + max(0, len(words) - 1)


def test_features_are_words_pairs_and_ngrams_of_each_text_alone():
    value = np.random.default_rng(3).normal(size=BUCKETS).astype(np.float32)
    together, counts = totals(TEXTS, value)
    assert counts.tolist() == [plain_number(t) for t in TEXTS]
    for n, text in enumerate(TEXTS):
        alone, count = totals([text], value)
        assert count[0] == counts[n] and abs(alone[0] - together[n]) < 1e-4
    assert [len(x) for x in totals([], value)] == [0, 0]
    assert all(b.min(initial=0) >= 0 and b.max(initial=0) < BUCKETS for b, _, _ in features(TEXTS))


def test_a_step_goes_down_the_gradient():
    weights = start_weights()
    weights[1][:] = np.random.default_rng(1).normal(size=weights[1].shape)
    buckets, shares = np.array([3, 70, 900]), np.array([0.5, 0.25, 0.25], np.float32)

    def loss():
        logits = weights[1] @ (shares @ weights[0][buckets]) + weights[2]
        return np.log(np.exp(logits).sum()) - logits[1]

    before, vector = loss(), weights[0][70].astype(float)
    # The change of one vector equals the numerical derivative of the loss.
    slope = []
    for d in range(qv.DIMENSION):
        kept = weights[0][70, d]
        weights[0][70, d] = kept + 1e-2
        high = loss()
        weights[0][70, d] = kept - 1e-2
        slope.append((high - loss()) / 2e-2)
        weights[0][70, d] = kept
    descend(weights, buckets, shares, 1, 0.1)
    assert loss() < before
    assert np.allclose(vector - 0.1 * np.array(slope), weights[0][70], atol=1e-3)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_held_out_labels_are_found(spark, sf):
    rows = QUERIES["op13_subword_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([a == b for a, b, _ in held]) > 0.95
    good, bad = ([s for a, _, s in held if a == kind] for kind in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", "p"), (2, "b@d $$$ w@rds", "q"), (None, None, "r"), (4, "", "s"), (4, "", "s"), (5, "good " * 50_000, "t")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in score_quality(docs, none).collect()} == {(0.0, 0)}
    one_kind = spark.createDataFrame([(1, 1), (1, None)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in score_quality(docs, one_kind).collect()} == {(1.0, 1)}
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (5, 1), (4, None)], "doc_id long, quality int")
    rows = score_quality(docs, labels).collect()
    by_name = {r.document.score: r for r in rows}
    assert len(rows) == 6 and by_name["p"].predicted == 1 and by_name["q"].predicted == 0 and by_name["t"].predicted == 1
    assert by_name["r"].score == by_name["s"].score
    assert sorted((str(r.document.doc_id), r.score) for r in rows) == sorted((str(r.document.doc_id), r.score) for r in score_quality(docs, labels).collect())
    assert score_quality(docs.limit(0), labels).count() == 0
