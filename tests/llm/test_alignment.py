"""Tokenizer alignment against a plain walk over both token lists, with whole texts and corpus-wide counts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from leadlake.llm import alignment
from leadlake.llm.alignment import PairTable, align_tokenizers, bin_of, counted_pairs, one_row, pair_rows, perfect_levels
from leadlake.llm.packing import byte_letters
from leadlake.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a b  c"), (5, "x ▁ y"), (6, "<|endoftext|> and </s>"), (7, "日本語 ß é́ 　 x\n\n y"), (8, "a" * 3000 + " " * 500 + "^" * 900),
    (9, "a b  c"), (9, "a b  c"), (10, "<unk> <0x41>"), (11, "tab\t x \r\n z "), (None, "it's a 'quoted' word; don't"), (12, "a\x00b \x1c c"), (13, "word " * 4000),
]


def plain(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: i for i, c in enumerate(byte_letters())}
    aligned = []
    for _, text in rows:
        aligned.append(None)
        if not text:
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        spelled = [[bytes(back[c] for c in first.id_to_token(i)) for i in a],
                   [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            continue
        i = j = at_a = at_b = 0
        links, groups, group = [], [], ([], [])
        new_a = new_b = True
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            if new_a:
                group[0].append(a[i])
                at_a += len(spelled[0][i])
            if new_b:
                group[1].append(b[j])
                at_b += len(spelled[1][j])
            new_a, new_b = at_a <= at_b, at_b <= at_a
            i, j = i + new_a, j + new_b
            if new_a and new_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
        aligned[-1] = (len(a), len(b), groups, links)
    counts = Counter(link for found in aligned if found for link in set(found[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    result = []
    for (doc_id, _), found in zip(rows, aligned):
        if found is None:
            result.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        result.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return result, counts


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_odd_texts_equal_the_plain_walk(spark, most):
    docs = spark.createDataFrame([(*row, "x", 1) for row in ODD], "doc_id long, text string, keys string, n_a int").repartition(3)
    found = align_tokenizers(docs, A, B, broadcast_pairs=most, with_groups=True)
    rows = found.collect()
    assert sorted_rows(r[:8] for r in rows) == sorted_rows(plain(ODD)[0])
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows if r.groups_sha256)


def test_the_query_equals_the_plain_walk(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted_rows(QUERIES["op11_hash_alignment"](spark, sf).collect()) == sorted_rows(plain(rows)[0])


def test_forgetting_stretches_and_small_batches_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choice(["the", "of", "naïve", "x1,", "word.\nNext", "été"]) for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted_rows(plain(rows)[0])
    assert sorted_rows(align_tokenizers(docs, A, B).collect()) == want

    class Forgetful(alignment.Stretches):
        def full(self):
            return True

    known = Forgetful(A, B)
    for texts in ([t for _, t in rows], ["a", "b c", " d", ""]):
        places, sizes, apart = known.of([t for t in texts if t])
        assert len(places) == sizes.sum() and not apart
        known.reset()


def test_pair_counts_are_document_counts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(4)
    counts = plain(ODD)[1]
    assert {(r.a, r.b): r.n for r in pair_rows(counted_pairs(docs, A, B)).collect()} == counts


def test_an_empty_table_gives_no_rows(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_every_key_has_a_slot_of_its_own_and_foreign_keys_are_noticed():
    random_keys = np.unique(np.random.default_rng(5).integers(0, 1 << 47, 30_000))
    bits, sizes = perfect_levels(random_keys)
    row = {"sizes": sizes.tobytes(), "bits": bits.tobytes()}
    slots = PairTable([row], one_row).ranks(random_keys)
    assert sorted(slots.tolist()) == list(range(len(random_keys)))
    placed = np.empty(len(random_keys), dtype=np.int64)
    placed[slots] = random_keys
    table = PairTable([row | {"keys": placed.tobytes()}], one_row)
    assert (table.slots(random_keys) == slots).all()
    with pytest.raises(KeyError):
        table.slots(np.array([1 << 50]))
    assert bin_of(random_keys).min() >= 0 and bin_of(random_keys).max() < alignment.BINS
