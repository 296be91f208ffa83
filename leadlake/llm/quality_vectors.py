"""Quality classifier: supervised subword embeddings.

A text's features are its words, pairs of neighbouring words and character n-grams inside words with their borders, hashed into
buckets. Each bucket has a vector; a document is the average of the vectors of all its features, and a softmax layer over that
average gives the chance of each label. Vectors and layer are learned together by stochastic gradient descent in numpy:
the labelled rows lie in a fixed number of shards, in every round each shard takes its steps from the common weights, and
the shards' weights are averaged.

Since layer and average are linear, the difference of the two logits is the average of one number per bucket, which
is worked out from vectors and layer after learning; scoring a text adds up these numbers.

Learning takes at most ``max_fit_rows`` labelled rows, an even sample by a hash of the id. Everything else covers all rows.

Defined cases: a null text is the empty text, which has no features and gets the score of the layer's bias. Labels without
a value are no labels; a document with several has the largest. Without labels of both kinds the score is the share of
good labels, 0 without any. Repeated rows are scored alike. A text is scored whole. The columns kept come back inside the
struct ``document``, so they may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import text_or_empty
from leadlake.llm.lm import mixed
from leadlake.llm.words import batches_of
from leadlake.session import materialize, scratch_path

# Labelled rows that the weights are learned from at most.
MAX_FIT_ROWS = 12_000
BUCKET_BITS, DIMENSION = 16, 8
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (2, 3, 4)
# Learning: shards, rounds after each of which they are averaged, first step size, steps of all shards at least, share of a step for the bias.
SHARDS, ROUNDS, RATE, LEAST_STEPS, BIAS_SHARE = 4, 6, 4.0, 6_000, 0.1
# Text whose features are worked out at once.
SLICE_BYTES = 1 << 18
LETTER_STEP, WORD_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(LETTER_STEP), -1, 1 << 64))
CODES = mixed(np.arange(1, 257, dtype=np.uint64))


def hashed(values: np.ndarray) -> np.ndarray:
    return (((values ^ (values >> np.uint64(32))) * WORD_STEP) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of some texts, given as UTF-8, in groups of (buckets, whether each is one, bounds of the texts); n-grams are of bytes."""
    # Single spaces around every word: a space is a word's border.
    parts = [b" " + b" ".join(t.split()) + b" " for t in texts]
    joined = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    space = joined == 32
    codes = CODES[joined]
    rolling, inside = codes, np.zeros(len(joined), dtype=bool)
    for n in range(2, max(NGRAMS) + 1):
        rolling = rolling[:-1] * LETTER_STEP + codes[n - 1 :]
        if n in NGRAMS:
            # Only the first and the last letter may be borders, and not both.
            yield hashed(rolling + np.uint64(n)), ~(inside[: len(rolling)] | (space[: len(rolling)] & space[n - 1 :])), np.minimum(bounds, len(rolling))
        inside = inside[:-1] | space[n - 1 : n - 1 + len(inside) - 1]
    first, last = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    # Letters weighted by powers of an odd number, summed per word.
    powers = np.full(len(joined) + 1, LETTER_STEP)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(len(joined) + 1, INVERSE)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])
    words = mixed((sums[last] - sums[first]) * inverse[first])
    word_bounds = np.searchsorted(first, bounds)
    yield hashed(words), np.ones(len(words), dtype=bool), word_bounds
    # A pair starts at every word but the last of a text; a word that repeats the one before is the same pair whatever the word.
    pairs = np.where(words[:-1] == words[1:], np.uint64(1), words[:-1] * LETTER_STEP + words[1:])
    there = np.ones(len(pairs), dtype=bool)
    there[word_bounds[1:-1][(word_bounds[1:-1] > 0) & (word_bounds[1:-1] <= len(pairs))] - 1] = False
    yield hashed(pairs), there, np.minimum(word_bounds, len(pairs))


def totals(texts: Sequence[bytes], value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the features' values, number of features) of every text."""
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for buckets, there, bounds in features(texts):
        running = np.concatenate([[0.0], np.cumsum(np.where(there, value[buckets], 0.0), dtype=np.float64)])
        sums += running[bounds[1:]] - running[bounds[:-1]]
        number = np.concatenate([[0], np.cumsum(there)])
        counts += number[bounds[1:]] - number[bounds[:-1]]
    return sums, counts


def start_weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias before learning."""
    random = np.random.default_rng(41)
    vectors = random.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    return vectors, np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)


def descend(weights: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: np.ndarray, shares: np.ndarray, label: int, step: float) -> None:
    """One step of gradient descent on a text with its distinct ``buckets`` and their ``shares``; changes the weights in place."""
    vectors, layer, bias = weights
    average = shares @ vectors[buckets]
    logits = layer @ average + bias
    chance = np.exp(logits - logits.max())
    miss = chance / chance.sum()
    miss[label] -= 1
    back = miss @ layer
    layer -= np.float32(step) * np.outer(miss, average)
    bias -= np.float32(step * BIAS_SHARE) * miss
    vectors[buckets] -= np.float32(step) * np.outer(shares, back)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to learn from: gaps between the distinct buckets of each text, and how often it has each."""
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        for first, end in batches_of(texts, SLICE_BYTES):
            groups = list(features(texts[first:end]))
            of = (np.concatenate([b[s:e][t[s:e]] for b, t, bounds in groups for s, e in [bounds[n : n + 2]]]) for n in range(end - first))
            distinct = [np.unique(buckets, return_counts=True) for buckets in of]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).slice(first, end - first) for c in ("shard", "label")),
                pa.array([np.diff(b, prepend=0) for b, _ in distinct], pa.list_(pa.int32())), pa.array([n for _, n in distinct], pa.list_(pa.int32())),
            ], names=["shard", "label", "gaps", "counts"])


def round_steps(sent: Broadcast, rate: float, decay: float, sizes: dict[int, int], passes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round of a shard, ``passes`` times over its rows; the step falls by ``decay``. ``sizes`` has the rows of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, done, seen, kept = tuple(w.copy() for w in sent.value), 0, 0, []

        def step(row: tuple[np.ndarray, np.ndarray, int], total: int) -> None:
            nonlocal done
            descend(weights, *row, rate - decay * done / total)
            done += 1

        for batch in batches:
            shards, labels = (batch.column(c).to_pylist() for c in ("shard", "label"))
            for shard, label, gaps, counts in zip(shards, labels, batch.column("gaps"), batch.column("counts")):
                n = counts.values.to_numpy().astype(np.float32)
                row = np.cumsum(gaps.values.to_numpy(), dtype=np.int64), n / np.float32(max(1.0, n.sum())), label
                seen = sizes[shard] * passes
                step(row, seen)
                if passes > 1:
                    # Only a small sample is gone through again.
                    kept.append(row)
        for n in range(1, passes):
            for place in np.random.default_rng(n).permutation(len(kept)):
                step(kept[place], seen)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()) for w in weights], names=["vectors", "layer", "bias"])

    return run


def learn(fit_rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights from rows of (shard, row, label, text). The shards' jobs run beside each other, each in one task."""
    spark = fit_rows.sparkSession
    path = scratch_path(spark, "quality-features")
    schema = "shard int, label int, gaps array<int>, counts array<int>"
    sizes = {r.shard: r["count"] for r in fit_rows.groupBy("shard").count().collect()}

    def store(shard: int) -> None:
        """The features of a shard in a random order, so that no round has to shuffle."""
        rows = fit_rows.where(F.col("shard") == shard).repartition(1).sortWithinPartitions(F.xxhash64(F.lit(53), "row"), "row")
        rows.mapInArrow(measured, schema).write.parquet(f"{path}/{shard}")

    passes = -(-LEAST_STEPS // (ROUNDS * sum(sizes.values())))
    weights = start_weights()
    with ThreadPool(SHARDS) as pool:
        pool.map(inheritable_thread_target(spark)(store), sorted(sizes))
        for done in range(ROUNDS):
            sent = spark.sparkContext.broadcast(weights)
            steps = round_steps(sent, RATE * (1 - done / ROUNDS), RATE / ROUNDS, sizes, passes)

            def one_round(shard: int) -> list:
                """One row, of the size of the weights."""
                return spark.read.schema(schema).parquet(f"{path}/{shard}").coalesce(1).mapInArrow(steps, "vectors binary, layer binary, bias binary").collect()

            learned = [row for rows in pool.map(inheritable_thread_target(spark)(one_round), sorted(sizes)) for row in rows]
            weights = tuple(
                np.mean([np.frombuffer(r[n], np.float32) for r in learned], axis=0, dtype=np.float64).astype(np.float32).reshape(w.shape)
                for n, w in enumerate(weights))
            sent.destroy()
    return weights


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS,
    threshold: float = 0.5, keep: Sequence[str] | None = None,
) -> DataFrame:
    """(document, score, predicted) of every row; ``labels`` (doc_id, quality) are all used for learning.

    ``document`` has the columns ``keep``, all by default.
    """
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("document"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    draw = F.pmod(F.xxhash64(F.lit(43), "label_id"), F.lit(1 << 20))
    sample = known.where(draw < int(min(1.0, max_fit_rows / max(1, counted.n)) * (1 << 20)))
    fit_rows = rows.join(sample, F.col("doc_id") == F.col("label_id")).select(
        F.pmod(F.xxhash64(F.lit(47), "label_id"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("label_id", "text").alias("row"), "label", "text")
    kinds = materialize(fit_rows, "quality-rows")
    balance = kinds.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    if not balance.n or not 0 < balance.good < balance.n:
        constant = F.lit(float(counted.good or 0) / max(1, counted.n))
        return rows.select("document", constant.alias("score"), (constant >= threshold).cast("int").alias("predicted"))
    vectors, layer, bias = learn(kinds)
    sent = docs.sparkSession.sparkContext.broadcast((vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, shift = sent.value
        for batch in batches:
            texts, scores = [t.as_py() for t in batch.column("text").cast(pa.binary())], []
            for first, end in batches_of(texts, SLICE_BYTES):
                total, n = totals(texts[first:end], value)
                scores.append(1 / (1 + np.exp(-(total / np.maximum(1, n) + shift))))
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["document", "score"])

    kind = rows.schema["document"].dataType.simpleString()
    scored = rows.select("document", "text").mapInArrow(run, f"document {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
