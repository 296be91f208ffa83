"""Language-model scores by deleted interpolation of n-gram estimates.

A token's probability mixes its bigram and unigram maximum-likelihood estimates and a uniform floor.
The weights depend on how often the context was seen: contexts fall into buckets by the logarithm of
their count, and each bucket's weights are learned by expectation-maximisation on held-out
counts, from training documents that the estimates used there leave out. Scores then use the
counts of all training documents.

Texts are cut into blocks. A block asks for the counts of its distinct words and bigrams, each once;
requests are dealt by hash range, summed there over all blocks, and answered in the same order.
So no table of counts is ever sent to a driver or to every task, and a word found everywhere
is one request per block. Hash ranges and blocks hold the same amount of text whatever the corpus.

Defined cases: a null text is the empty text, one end token. Only A-Z are lowered. Without training
documents all counts are 0 and every token has probability 1 / (V + 1) with V = 0. Rows repeated in full are scored and
counted as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.session import materialize

BLOCK_BYTES = 1 << 23
# Text behind one hash range.
RANGE_BYTES = 1 << 23
SLICE_BYTES = 1 << 21
# Bits kept of a hash inside its range: about a million keys meet there, so few in a million share one.
KEY_BITS = 40
CONTEXT_BUCKETS = 24
EM_ROUNDS, EM_SETTLED = 200, 1e-7
# Probability ratios are counted in steps of a quarter octave for expectation-maximisation.
RATIO_STEP = 4
COUNTS, TUNING, HELD = 0, 1, 2

_random = np.random.default_rng(20240229)
LETTERS = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS[65:91] = LETTERS[97:123]
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LETTERS[SPACES] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words in some bytes; case of A-Z does not matter."""
    starts, hashes = [], []
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and not SPACES[data[end]]:
            step = np.flatnonzero(SPACES[data[end : end + SLICE_BYTES]])
            end = end + int(step[0]) if len(step) else min(end + SLICE_BYTES, len(data))
        part = data[at:end]
        gap = np.concatenate([[True], SPACES[part], [True]])
        first, last = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        powers = np.full(len(part) + 1, BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(LETTERS[part] * powers[:-1], out=sums[1:])
        inverse = np.full(len(part) + 1, INVERSE)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        hashes.append(mixed((sums[last] - sums[first]) * inverse[first]))
        starts.append(first + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def block_tokens(texts: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, bigram hash) of every token; each document ends with an end token."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    start, word = word_hashes(np.frombuffer(texts, np.uint8))
    of = np.searchsorted(bounds, start, "right") - 1
    n = len(sizes)
    doc = np.concatenate([of, np.arange(n)])
    token = np.concatenate([word, np.full(n, END)])
    order = np.argsort(doc, kind="stable")
    doc, token = doc[order], token[order]
    before = np.concatenate([[START], token[:-1]]) if len(token) else token
    before[np.concatenate([[True], doc[1:] != doc[:-1]])] = START
    return doc, token, mixed(before * np.uint64(0xD6E8FEB86659FD93) + token * np.uint64(0xA0761D6478BD642F) + np.uint64(1))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text, role) to blocks of one role: ids, sizes and compressed texts, each followed by a space."""
    part, n = TaskContext.get().partitionId(), 0
    waiting: dict[int, tuple[list, list]] = {}
    filled = {COUNTS: 0, TUNING: 0, HELD: 0}

    def block(role: int, kind: pa.DataType) -> pa.RecordBatch:
        nonlocal n
        ids, texts = waiting.pop(role)
        blob = b" ".join([*texts, b""])
        row = [
            pa.array([part << 32 | n], pa.int64()), pa.array([role], pa.int32()), pa.array([ids], pa.list_(kind)),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pa.compress(blob, codec="zstd", asbytes=True)], pa.binary()),
        ]
        n += 1
        return pa.RecordBatch.from_arrays(row, names=["block", "role", "ids", "sizes", "texts"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc_id, text, role in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            ids, texts = waiting.setdefault(role, ([], []))
            ids.append(doc_id)
            texts.append(text or b"")
            filled[role] += len(texts[-1]) + 1
            if filled[role] >= BLOCK_BYTES:
                filled[role] = 0
                yield block(role, kind)
    for role in list(waiting):
        yield block(role, kind)


def unpacked(sizes, texts: bytes):
    sizes = np.asarray(sizes, dtype=np.int64)
    return block_tokens(pa.decompress(texts, decompressed_size=int(sizes.sum() + len(sizes)), codec="zstd", asbytes=True), sizes)


def in_range(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash range, remaining bits) of sorted keys."""
    place = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return place, (keys >> np.uint64(64 - bits - KEY_BITS)) & np.uint64((1 << KEY_BITS) - 1)


def narrow(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes() + (values >> np.uint64(32)).astype("u1").tobytes()


def wide(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)


def packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def counts_in(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")


def asker(bits: int):
    """Blocks to requests: one row per block and hash range, with the counts that the block itself has."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                doc, word, bigram = unpacked(row.sizes, row.texts)
                words, pairs = np.unique(np.append(word, np.full(len(row.sizes), START)), return_counts=True), np.unique(bigram, return_counts=True)
                cuts = []
                for keys, n in (words, pairs):
                    place, rest = in_range(keys, bits)
                    cuts.append((np.searchsorted(place, np.arange((1 << bits) + 1)), rest, n, keys))
                out = []
                for r in range(1 << bits):
                    parts = [(c[1][c[0][r] : c[0][r + 1]], c[2][c[0][r] : c[0][r + 1]]) for c in cuts]
                    if len(parts[0][0]) + len(parts[1][0]):
                        start = np.flatnonzero(words[0][cuts[0][0][r] : cuts[0][0][r + 1]] == START)
                        out.append((r, row.block, row.role, len(parts[0][0]), int(start[0]) if len(start) else -1, narrow(np.concatenate([p[0] for p in parts])),
                                    packed(np.concatenate([p[1] for p in parts]))))
                yield pd.DataFrame(out, columns=["range", "block", "role", "words", "start_at", "keys", "counts"])

    return run


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """All requests of one hash range: sum the training counts and answer each block in its own order."""
    keys = [wide(k) for k in frame["keys"]]
    sizes = [len(k) for k in keys]
    counts = np.concatenate([counts_in(c, n) for c, n in zip(frame["counts"], sizes)])
    role = np.repeat(frame["role"].to_numpy(), sizes)
    is_word = np.concatenate([np.arange(n) < w for n, w in zip(sizes, frame["words"])])
    # Words and bigrams are kept apart by the lowest bit.
    distinct, place = np.unique(np.concatenate(keys) << np.uint64(1) | is_word.astype(np.uint64), return_inverse=True)
    part = np.zeros(len(distinct), dtype=np.int64)
    whole = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(part, place[role == COUNTS], counts[role == COUNTS])
    np.add.at(whole, place[role != HELD], counts[role != HELD])
    out, at = [], 0
    mark = None
    for block, of, n, start_at in zip(frame["block"], frame["role"], sizes, frame["start_at"]):
        here = place[at : at + n]
        if start_at >= 0:
            mark = here[start_at]
        out.append((block, frame["range"].iloc[0], of, packed(whole[here]), packed(part[here]) if of == TUNING else None, n, 0, 0, 0, 0))
        at += n
    token = (distinct & np.uint64(1)).astype(bool)
    if mark is not None:
        token[mark] = False  # the start mark is a context, not a token
    sums = (int(whole[token].sum()), int((whole[token] > 0).sum()), int(part[token].sum()), int((part[token] > 0).sum()))
    out.append((-1, frame["range"].iloc[0], -1, None, None, 0, *sums))
    return pd.DataFrame(out, columns=["block", "range", "role", "whole", "part", "n", "tokens", "distinct", "part_tokens", "part_distinct"])


def looked_up(block, answers: pd.DataFrame, column: str, bits: int):
    """(document, c(word), c(context), c(bigram)) of a block's tokens, from its answers."""
    doc, word, bigram = unpacked(block.sizes, block.texts)
    words, word_at = np.unique(np.append(word, START), return_inverse=True)
    pairs, pair_at = np.unique(bigram, return_inverse=True)
    word_range, _ = in_range(words, bits)
    pair_range, _ = in_range(pairs, bits)
    found = [np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)]
    for r, data, n in zip(answers["range"], answers[column], answers["n"]):
        counts = counts_in(data, n)
        a, b = np.searchsorted(word_range, [r, r + 1])
        c, d = np.searchsorted(pair_range, [r, r + 1])
        found[0][a:b], found[1][c:d] = counts[: b - a], counts[b - a :]
    c_word = found[0][word_at[:-1]]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    context = np.concatenate([[0], c_word[:-1]])
    context[first] = found[0][word_at[-1]]
    return doc, c_word, context, found[1][pair_at]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1).astype(np.int64), CONTEXT_BUCKETS - 1)


def estimates(c_word, context, c_pair, tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood bigram and unigram probabilities, and the uniform floor."""
    p2 = np.divide(c_pair, context, out=np.zeros(len(context)), where=context > 0)
    return p2, c_word / max(1, tokens), 1.0 / (distinct + 1)


def tuner(bits: int, tokens: int, distinct: int):
    """Held-out tokens of a tuning block, counted by context bucket and the ratios of the estimates."""
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"bucket": [], "r2": [], "r1": [], "n": []}).astype("int64")
        for block in blocks.itertuples():
            _, c_word, context, c_pair = looked_up(block, answers, "part", bits)
            p2, p1, p0 = estimates(c_word, context, c_pair, tokens, distinct)
            with np.errstate(divide="ignore"):
                r2, r1 = (np.where(p > 0, np.round(np.log2(p / p0) * RATIO_STEP), -999).astype(np.int64) for p in (p2, p1))
            counted = pd.DataFrame({"bucket": context_bucket(context), "r2": r2, "r1": r1}).value_counts().rename("n").reset_index()
            out = pd.concat([out, counted])
        return out

    return run


def learn_weights(held: pd.DataFrame) -> np.ndarray:
    """Weights (bigram, unigram, floor) per context bucket by expectation-maximisation; unseen buckets take those of the bucket below."""
    weights = np.zeros((CONTEXT_BUCKETS, 3))
    last = np.array([0.3, 0.6, 0.1])
    for bucket in range(CONTEXT_BUCKETS):
        own = held[held["bucket"] == bucket]
        if len(own):
            n = own["n"].to_numpy(float)
            p = np.stack([np.where(own[c] > -999, 2.0 ** (own[c] / RATIO_STEP), 0.0) for c in ("r2", "r1")] + [np.ones(len(own))], axis=1)
            w = np.array([0.3, 0.6, 0.1])
            for _ in range(EM_ROUNDS):
                share = p * w
                share *= (n / share.sum(axis=1))[:, None]
                fresh = share.sum(axis=0) / n.sum()
                if np.abs(fresh - w).max() < EM_SETTLED:
                    break
                w = fresh
            # One held-out token more for each part keeps every weight above zero.
            last = (w * n.sum() + 1) / (n.sum() + 3)
        weights[bucket] = last
    return weights


def scorer(bits: int, tokens: int, distinct: int, weights: np.ndarray):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for block in blocks.itertuples():
            doc, c_word, context, c_pair = looked_up(block, answers, "whole", bits)
            p2, p1, p0 = estimates(c_word, context, c_pair, tokens, distinct)
            w = weights[context_bucket(context)].copy()
            w[context == 0, 1:] += w[context == 0, :1] * np.array([0.9, 0.1])
            if tokens == 0:
                w[:] = (0.0, 0.0, 1.0)
            score = np.log10(w[:, 0] * p2 * (context > 0) + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((c_word + 0.5) / (tokens + 0.5 * (distinct + 1)))
            n = len(block.sizes)
            sums = [np.bincount(doc, weights=x, minlength=n) for x in (np.ones(len(doc)), c_word > 0, base, score)]
            frames.append(pd.DataFrame({
                "doc_id": list(block.ids), "role": block.role, "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base_score": sums[2], "score": sums[3]}))
        return pd.concat(frames) if frames else pd.DataFrame(columns=["doc_id", "role", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, learns: Column, tunes: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``learns`` marks training documents, ``tunes`` those of them that tune the weights.
    """
    role = F.when(~F.coalesce(learns, F.lit(False)), HELD).when(F.coalesce(tunes, F.lit(False)), TUNING).otherwise(COUNTS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), role.alias("role"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = materialize(rows.mapInArrow(blocks_of, f"block long, role int, ids array<{kind}>, sizes array<long>, texts binary"), "lm-blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()[0] or 0
    bits = max(3, (size // RANGE_BYTES).bit_length())
    requests = blocks.select("block", "role", "sizes", "texts").mapInPandas(
        asker(bits), "range int, block long, role int, words int, start_at int, keys binary, counts binary")
    answers = materialize(requests.groupBy("range").applyInPandas(
        answer, "block long, range int, role int, whole binary, part binary, n int, tokens long, distinct long, part_tokens long, part_distinct long"), "lm-answers")
    sums = answers.where("block = -1").agg(*[F.sum(c).alias(c) for c in ("tokens", "distinct", "part_tokens", "part_distinct")]).first()
    tokens, distinct = int(sums.tokens or 0), int(sums.distinct or 0)
    tuning = blocks.where(F.col("role") == TUNING).groupBy("block").cogroup(answers.where(F.col("role") == TUNING).select("block", "range", "part", "n").groupBy("block"))
    ratios = tuning.applyInPandas(tuner(bits, int(sums.part_tokens or 0), int(sums.part_distinct or 0)), "bucket long, r2 long, r1 long, n long")
    # Buckets and ratio steps are few whatever the corpus, so this table is small.
    held = ratios.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(held)
    ready = blocks.groupBy("block").cogroup(answers.where("block >= 0").select("block", "range", "whole", "n").groupBy("block"))
    scored = ready.applyInPandas(scorer(bits, tokens, distinct, weights), f"doc_id {kind}, role int, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", (F.col("role") == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
