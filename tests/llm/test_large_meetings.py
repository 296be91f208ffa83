import random

from leadlake.llm.near_dedup import near_duplicates, order_sketches
from leadlake.llm.words import document_words, labelled_shingles

SCHEMA = "doc_id bigint, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def sketch(text):
    _, labelled, _ = labelled_shingles(*document_words([text.encode()]), 5)
    return int(order_sketches(labelled, 1, 1)[0])


def test_pairs_with_one_shared_bucket_meet_in_large_meetings(spark):
    """One sketch of one shingle, so each pair shares a single bucket; pairs of texts are similar, all of them meet."""
    rng = random.Random(5)
    plain = [" ".join(words(rng, 5)) for _ in range(40)]
    texts = []
    for passage in plain:
        group, want = [], sketch(passage)
        for _ in range(60):
            base = words(rng, 25)
            pair = [f"{passage} {' '.join(base)}", f"{passage} {' '.join(base)} {rng.choice(['x', 'y'])}"]
            group += [pair] if all(sketch(t) == want for t in pair) else []
        texts = max(texts, group, key=len)
    texts = [t for pair in texts[:20] for t in pair]
    assert len(texts) == 40
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for limits in ({}, {"tile_rows": 4, "tiles_together": 2}):
        found = {r.doc_id: r.class_id for r in near_duplicates(df, sketches=1, picked=1, **limits).collect()}
        assert found == {i: i - i % 2 for i in range(40)}, limits


def test_documents_without_an_id_read_their_own_text_only(spark):
    """Many texts under one id, or none: each node reads one text, and classes are those of numbered rows."""
    import random

    from pyspark.sql import functions as F

    from leadlake.llm import near_dedup

    rng = random.Random(8)
    base = [" ".join(str(rng.randrange(9999)) for _ in range(60)) for _ in range(20)]
    rows = [(None if i % 2 else 7, base[i % 20] + f" tail{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    read = []
    real = near_dedup.node_sequences

    def counted(wanted, docs, nodes, k):
        out = real(wanted, docs, nodes, k)
        read.append((docs.join(nodes, [docs.doc_id.eqNullSafe(nodes.doc_id), docs.raw == nodes.raw]).count(), out.count()))
        return out

    near_dedup.node_sequences = counted
    try:
        plain = near_duplicates(docs).collect()
    finally:
        near_dedup.node_sequences = real
    assert read == [(60, 60)]
    numbered = near_duplicates(docs.withColumn("no", F.monotonically_increasing_id()), row="no").collect()
    assert sorted(r.class_size for r in plain) == sorted(r.class_size for r in numbered) == [3] * 60
    assert sum(r.kept for r in plain) == 20
