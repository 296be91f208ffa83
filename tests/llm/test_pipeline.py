import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SCHEMA = "doc_id bigint, text string, source string, lang string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def test_survivors_are_rows_not_ids(spark):
    rng = random.Random(1)
    base = words(rng, 200)
    own = [words(rng, 60) for _ in range(6)]
    rows = [(1, base, "s", "a"), (4, base + " end", "s", "b"), (4, own[0], "s", "c"), (4, own[1], "s", "d"), (None, own[2], "s", "e"), (None, own[3], "t", "f"),
            (None, own[2], "t", "g"), (None, None, "t", "h"), (5, own[4], None, "i"), (5, own[4], None, "i")]
    kept = pipeline.keep_one_of_each_class(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), "")
    assert kept.columns == ["doc_id", "text", "source", "lang"]
    assert sorted(r.lang for r in kept.collect()) == ["a", "c", "d", "e", "f", "h", "i"]


def test_redaction_marks_each_row_by_its_own_text(spark):
    rows = [(None, "mail a@b.org now", "s", "a"), (None, "nothing here at all", "s", "b"), (7, "mail long.name@example.org now", "s", "c"), (7, "at 10.1.2.3 it runs", "s", "d"),
            (7, "at 10.1.2.3 it runs", "s", "e"), (None, None, "s", "f"), (7, "", "s", "g")]
    clean = pipeline.redact_personal_data(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert {r.lang: r.text for r in clean} == {
        "a": "mail [email] now", "b": "nothing here at all", "c": "mail [email] now", "d": "at [ip] it runs", "e": "at [ip] it runs", "f": None, "g": ""}
    assert len(clean) == len(rows)


def test_mix_repeats_rows_not_ids(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 else 9, words(rng, 5 + i % 4), rng.choice("sst"), str(i)) for i in range(60)]
    taken = pipeline.mix_to_weights(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert taken.columns == ["doc_id", "text", "source", "lang"]
    found = Counter((r.doc_id, r.text, r.source, r.lang) for r in taken.collect())
    assert set(found) <= set(rows) and max(found.values()) <= 3
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    total = sum(sizes.values())
    # Weights 1 and 2; no source is taken more than three times.
    t = min(3 * sizes["t"], total * 2 / 3)
    for source, target in (("s", total - t), ("t", t)):
        got = sum(n * len(r[1].split()) for r, n in found.items() if r[2] == source)
        assert abs(got - target) <= 8


def labels(spark, tmp_path, toxic):
    spark.createDataFrame([(1, toxic), (7, toxic)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_equals_plain_python(spark, tmp_path):
    """One kind of label rejects nothing, and one source is taken once, so what stays is known row by row."""
    rng = random.Random(3)
    own = [words(rng, 40) for _ in range(4)]
    rows = [(1, own[0], "s", "a"), (7, own[1], "s", "b"), (7, own[2] + " a@b.org", "s", "c"), (None, own[3], "s", "d"), (None, own[0], "s", "e"), (None, "at 10.1.2.3", "s", "f")]
    folder = labels(spark, tmp_path, 0)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in ((1, own[0]), (7, own[1]), (7, own[2] + " [email]"), (None, own[3]), (None, "at [ip]")):
        want[doc_id, len(plain.encode(text, add_special_tokens=False).ids) + 1] += 1
    pieces = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))


def test_toxic_rows_go_whatever_their_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "s", "a"), (None, "b", "s", "b"), (None, "b", "s", "c"), (7, None, "s", "d"), (7, "e", "s", "e")], SCHEMA)
    kept = pipeline.drop_toxic(spark, docs, labels(spark, tmp_path / "good", 0))
    assert kept.columns == docs.columns and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert pipeline.drop_toxic(spark, docs, labels(spark, tmp_path / "bad", 1)).count() == 0


CLASHING = ["_row", "row", "document", "_pii_key", "key", "found", "_pii_spans", "_mix_key", "_mix_times", "picked", "times", "_bytes", "raw"]


def test_extra_columns_pass_through_under_any_name(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i if i % 3 else None, words(rng, 40) + (" a@b.org" if i % 2 else ""), "s", str(i)) for i in range(9)]
    docs = spark.createDataFrame([(*r, *[f"{c} of {r[3]}" for c in CLASHING]) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHING))
    folder = labels(spark, tmp_path, 0)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert len(found) == len(rows), name
        for r in found:
            assert [r[c] for c in CLASHING] == [f"{c} of {r.lang}" for c in CLASHING], name
    from leadlake.llm.sharding import kd_shards

    assert kd_shards(docs, 2).count() == len(rows)


def test_packed_ids_are_the_text(spark):
    rng = random.Random(6)
    texts = ["", words(rng, 30), words(rng, 9000), "at [ip] it runs"]
    docs = spark.createDataFrame([(None, t, "s", "a") for t in texts] + [(None, None, "s", "a")], SCHEMA)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(tuple(plain.encode(t, add_special_tokens=False).ids) + (2,) for t in [*texts, ""])
    ends = Counter()
    for r in pipeline.pack(spark, docs, "").collect():
        assert len(r.ids) == r.length
        if r.start + r.length == r.doc_tokens:
            ends[r.doc_tokens, r.ids[-1]] += 1
        if r.start == 0 and r.length == r.doc_tokens:
            assert tuple(r.ids) in want
    assert ends == Counter((len(t), 2) for t in want.elements())
    whole = sorted((r.start, r.ids) for r in pipeline.pack(spark, docs.where("length(text) > 9000"), "").collect())
    assert sum((ids for _, ids in whole), []) == [*plain.encode(texts[2], add_special_tokens=False).ids, 2]


def test_empty_tables_give_no_rows(spark, tmp_path):
    folder = labels(spark, tmp_path, 0)
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, folder).isEmpty(), name
