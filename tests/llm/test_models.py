import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadlake.llm.common import id_bucket
from leadlake.llm.lm import learn_weights, score_texts
from leadlake.llm.toxicity import Measurer, score_toxicity

SCHEMA = "doc_id bigint, text string, source string, block string, role int, x int, features string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "s", "b", 1, 2, "f") for i, t in enumerate(texts)], SCHEMA)


def score(df):
    fold = id_bucket("doc_id", 5)
    return {r.doc_id: r for r in score_texts(df, fold != 1, fold == 0).collect()}


def corpus(seed, n=400):
    rng = random.Random(seed)
    follow = {w: [rng.choice("abcdefghij") * 3 for _ in range(3)] for w in (c * 3 for c in "abcdefghij")}
    texts = []
    for _ in range(n):
        out = [rng.choice("abcdefghij") * 3]
        for _ in range(rng.randrange(40)):
            out.append(rng.choice(follow.get(out[-1], ["aaa"])) if rng.random() < 0.9 else f"w{rng.randrange(500)}")
        texts.append(" ".join(out).title())
    return texts + [None, "", "\t\n", "ÀÉ é\x85x É", "word" * 30_000, "end " * 3000]


def test_base_scores_equal_brute_force(spark):
    texts = corpus(1)
    found = score(table(spark, texts).repartition(3))
    tokens = [WORD.findall((t or "").translate(LOW)) + [None] for t in texts]
    learned = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    counts = Counter(w for t, yes in zip(tokens, learned) if yes for w in t)
    total = sum(counts.values())
    assert len(found) == len(texts)
    for i, t in enumerate(tokens):
        r = found[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), total, not learned[i])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    # The followers are learnable, so the model must beat single words by far on held-out texts.
    held = [r for r in found.values() if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_probabilities_sum_to_at_most_one(spark):
    texts = ["a b a c", "a b", "b a c c"] * 20
    df = table(spark, texts)
    rows = {r.doc_id: r.score for r in score_texts(df.withColumn("t", F.lit(True)), F.lit(True), F.col("doc_id") % 4 == 0).collect()}
    assert rows[0] == pytest.approx(rows[3]) and all(v < 0 for v in rows.values())


def test_weights_follow_the_held_out_counts():
    import pandas as pd

    strong = pd.DataFrame({"bucket": [5], "r2": [80], "r1": [8], "n": [1000]})
    weak = pd.DataFrame({"bucket": [5], "r2": [-999], "r1": [40], "n": [1000]})
    assert learn_weights(strong)[5][0] > 0.9 and learn_weights(weak)[5][1] > 0.9
    assert abs(learn_weights(weak).sum(axis=1) - 1).max() < 1e-9
    assert learn_weights(weak.iloc[:0]).shape[1] == 3


def test_scores_without_training_or_rows(spark):
    df = table(spark, ["a b", None])
    found = score_texts(df, F.lit(False), F.lit(False)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0 for r in found)
    assert score(spark.createDataFrame([], SCHEMA)) == {}


BAD = ["glorp", "snarfel", "wubbed", "zixt"]


def toxic_corpus(seed, n=900):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ing", ","]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts + [None, "", "x" * 300_000], labels


def test_toxicity_on_held_out_labels(spark):
    texts, labels = toxic_corpus(2)
    marks = spark.createDataFrame(labels + labels[:5] + [(3, None)], "doc_id long, toxic int").withColumn("score", F.lit("clash"))
    held = id_bucket("doc_id", 4) == 2
    rows = score_toxicity(table(spark, texts), marks.where(~held)).withColumn("held_out", held).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = dict(labels)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in out)
    caught = [r.predicted for r in out if truth[r.doc_id]]
    assert right >= 0.97 * len(out) and sum(caught) >= 0.9 * len(caught)
    assert {r.predicted for r in rows if r.doc_id >= 901} == {0}
    assert rows[0].document.source == "s"


def test_toxicity_without_labels_of_both_kinds(spark):
    df = table(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in score_toxicity(df, none).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(df, one).collect()] == [1.0, 1.0]
    assert score_toxicity(spark.createDataFrame([], SCHEMA), one).count() == 0


def test_features_see_hidden_words():
    measure = Measurer({"idiot": 3.0, "glorp*": 2.0})
    plain, hidden = measure("you idiot, glorping about"), measure("you 1d10t and id*iot!")
    assert plain[0] == 2 and plain[7] >= 1 and hidden[0] == 0 and hidden[5] == 2
    assert measure("")[0] == 0 and measure("unidiot")[0] == 0
