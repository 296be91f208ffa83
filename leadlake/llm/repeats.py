"""Repeated passages from an enhanced suffix array, as groups of maximal repeats with all their occurrences.

All windows of ``MIN_BYTES`` bytes have a minimizer, the smallest hash of the 32-byte strings in them. Stretches of
windows with one minimizer are routed by it, so equal windows always meet; stretches whose
minimizer occurs once are dropped before any text moves. Equal stretches collapse to one with a count, by hashes alone;
only where one minimizer has different stretches, or lies in several places of one, do bytes travel. In each
task the suffixes of the stretches are sorted, a stack scan over the common-prefix lengths finds the
intervals of the prefix tree, and an interval is a repeat if its members differ in the byte to
the left (or begin the stretch). A repeat longer than a stretch comes as pieces that overlap.

Texts lie compressed in a table bucketed by block, so that the passes over them are joined to keys and spans
without shuffling text again. Texts are UTF-8 bytes. The same text many times is one text with its smallest id; its other copies are removed whole.

Defined cases: a null text is empty. Matches never cross documents. Texts shorter than a window repeat nothing.
"Earlier" means a smaller id, null ids last, or an earlier start in the same document; of repeated rows one is the first.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import parts_of
from leadlake.llm.lm import in_range, mixed, narrow, wide
from leadlake.llm.words import batches_of
from leadlake.operators.ordered import Rank, with_ordered
from leadlake.session import materialize

MIN_BYTES, GRAM_BYTES = 100, 32
BLOCK_BYTES, RANGE_BYTES = 1 << 23, 1 << 25
# Windows in one stretch at most; cutting a long run keeps every window in one stretch.
STRETCH_WINDOWS = 128
# Different stretches of one minimizer that meet in a task; beyond, their windows are grouped by Spark.
STRETCHES_TOGETHER = 20_000
# Bytes of stretches behind one suffix array; a task holds about 60 times as much while it sorts.
SORTED_BYTES = 1 << 20

BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def stretches(texts: list[bytes], window: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, key, moves) of every stretch of windows that share their minimizer.

    ``moves`` tells whether the minimizer lies in several places, without which no two windows of the stretch are equal.
    """
    found = []
    for a, b in batches_of(texts):
        sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        if len(data) < window:
            continue
        h = BYTES[data]
        for step, factor in zip((1, 2, 4, 8, 16), FACTORS):
            h = h[:-step] * factor + h[step:]
        low = grams = mixed(h)
        width = 1
        reach = window - GRAM_BYTES + 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if reach > width:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(b - a), sizes)[: len(low)]
        inside = np.arange(len(low)) + window <= ends[doc]
        fresh = np.ones(len(low), dtype=bool)
        fresh[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(fresh)
        run = np.arange(len(low)) - np.repeat(begin, np.diff(np.append(begin, len(low))))
        start = np.flatnonzero((run % STRETCH_WINDOWS == 0) & inside)
        after = np.append(np.flatnonzero(run % STRETCH_WINDOWS == 0), len(low))
        size = after[np.searchsorted(after, start, "right")] - start
        value, offsets = low[start][:, None], np.arange(reach)
        first = start + (grams[start[:, None] + offsets] == value).argmax(axis=1)
        last = start + size - 1
        moves = first != last + (grams[last[:, None] + offsets] == value).argmax(axis=1)
        found.append((doc[start] + a, start - (ends - sizes)[doc[start]], size, mixed(low[start] + np.uint64(1)), moves))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to blocks: ids, sizes, SHA-256 digests and compressed texts."""
    part, n = TaskContext.get().partitionId(), 0
    ids, texts, held, kind = [], [], 0, pa.int64()

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            pa.array([[hashlib.sha256(t).digest() for t in texts]], pa.list_(pa.binary())), pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary()),
        ], names=["block", "ids", "sizes", "digests", "texts"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(doc_id)
            texts.append(text or b"")
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield block()
                ids, texts, held, n = [], [], 0, n + 1
    if ids:
        yield block()


def texts_of(sizes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    whole = pa.decompress(data, decompressed_size=int(ends[-1]) if len(ends) else 0, codec="zstd", asbytes=True)
    return [whole[e - s : e] for s, e in zip(sizes, ends)]


def distinct_texts(digests) -> list[int]:
    """The first place of each different text of a block."""
    return sorted({d: i for i, d in reversed(list(enumerate(digests)))}.values())


def asker(bits: int, window: int):
    """Each block asks for its distinct keys, with the text that has the key, or a mark if the block has it twice."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                chosen = distinct_texts(row.digests)
                texts = texts_of(row.sizes, row.texts)
                doc, _, _, key, moves = stretches([texts[i] for i in chosen], window)
                keys, first, at, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                twice = n > 1
                np.logical_or.at(twice, at, moves)
                mark = np.array([int.from_bytes(row.digests[i][:8], "little") for i in chosen], dtype=np.uint64)
                owner = mark[doc[first]] if len(keys) else keys
                place, rest = in_range(keys, bits)
                cuts = np.searchsorted(place, np.arange((1 << bits) + 1))
                out = [(r, row.block, narrow(rest[a:b]), owner[a:b].astype("<u8").tobytes(), np.packbits(twice[a:b]).tobytes())
                       for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pd.DataFrame(out, columns=["range", "block", "keys", "owners", "twice"])

    return run


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Tells each block which of its keys some other text has too."""
    keys, owners = [wide(k) for k in frame["keys"]], [np.frombuffer(o, "<u8") for o in frame["owners"]]
    sizes = [len(k) for k in keys]
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for t, n in zip(frame["twice"], sizes)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.concatenate(owners)
    low, high = np.full(len(distinct), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(distinct), dtype=np.uint64)
    np.minimum.at(low, place, owner)
    np.maximum.at(high, place, owner)
    again = low != high
    np.logical_or.at(again, place, twice)
    ends = np.cumsum(sizes)
    bits = [np.packbits(again[place[e - n : e]]).tobytes() for n, e in zip(sizes, ends)]
    return pd.DataFrame({"block": frame["block"], "range": frame["range"], "n": sizes, "again": bits})


def stretcher(bits: int, window: int):
    """Stretches of a block's first copies whose key occurs again, without their bytes."""
    def run(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        firsts = told[told["again"].isna()]
        answers = told[told["again"].notna()]
        for row in blocks.itertuples():
            texts = texts_of(row.sizes, row.texts)
            # The same texts as the block asked for; those whose first copy lies in another block are left to it.
            ranks = {row.digests[place]: rank for place, rank in zip(firsts["place"].tolist(), firsts["rank"].tolist())}
            chosen = distinct_texts(row.digests)
            doc, start, size, key, moves = stretches([texts[i] for i in chosen], window)
            keys, at = np.unique(key, return_inverse=True)
            place, _ = in_range(keys, bits)
            again = np.zeros(len(keys), dtype=bool)
            for r, n, flags in zip(answers["range"], answers["n"], answers["again"]):
                a, b = np.searchsorted(place, [r, r + 1])
                again[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=n)[: b - a]
            signed, length = key.astype(np.int64), size + window - 1
            for i in np.flatnonzero(again[at]) if len(keys) else ():
                n = chosen[doc[i]]
                rank = ranks.get(row.digests[n])
                if rank is not None:
                    part = texts[n][start[i] : start[i] + length[i]]
                    out.append((signed[i], xxhash.xxh3_64_intdigest(part) - (1 << 63), rank, start[i], length[i], moves[i], row.block, n))
        columns = {"key": "int64", "content": "int64", "rank": "int64", "start": "int64", "length": "int64", "moves": "bool", "block": "int64", "place": "int32"}
        return pd.DataFrame(out, columns=list(columns)).astype(columns)

    return run


def fetcher(blocks: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Adds their bytes to the stretches of a block."""
    parts: list[bytes] = []
    for row in blocks.itertuples():
        texts = texts_of(row.sizes, row.texts)
        parts = [texts[p][a : a + n] for p, a, n in zip(wanted["place"], wanted["start"], wanted["length"])]
    found = wanted[["key", "content", "moves", "crowded", "rank", "start"]].iloc[: len(parts)]
    return found.assign(stretch=pd.Series(parts, index=found.index, dtype=object))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the prefix-tree intervals with depth >= ``least``: a stack scan over common-prefix lengths.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1.
    """
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        stack: list[list[int]] = []
        for i in run.tolist():
            depth, left = int(lcp[i]), i
            while stack and stack[-1][0] > depth:
                d, left = stack.pop()
                yield left, i, d
            if not stack or stack[-1][0] < depth:
                stack.append([depth, left])
        last = int(run[-1]) + 1
        while stack:
            d, left = stack.pop()
            yield left, last, d


def ranked(values: np.ndarray) -> np.ndarray:
    """Dense ranks; the last value is that of the place behind all texts."""
    return np.unique(values, return_inverse=True)[1].astype(np.int32)


def enhanced_array(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, common prefix with the next, byte to the left or -1) of the suffixes whose first window occurs more than once, in order.

    Suffixes are places, ranked by prefix doubling up to the window; none is ever copied. Behind its end a text goes on with
    zeros; of suffixes that this leaves equal the shorter comes first, and no prefix reaches over an end.
    """
    length = np.array([len(t) for t in texts])
    end = np.cumsum(length)
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    last = len(data) - 1
    stop = np.append(np.repeat(end, length), last).astype(np.int32)

    def beyond(at: np.ndarray, step: int | np.ndarray) -> np.ndarray:
        """The places ``step`` further on, or the one behind all texts."""
        return np.where(at + step < stop[at], at + step, last)

    every = np.arange(last + 1, dtype=np.int32)
    word = np.zeros(last + 1, dtype=np.uint64)
    for step in range(8):
        word = word << np.uint64(8) | data[beyond(every, step)]
    width, ranks = 8, {8: ranked(word)}
    del word
    while 2 * width <= window:
        below = ranks[width]
        ranks[2 * width] = ranked(below.astype(np.int64) << 32 | below[beyond(every, width)])
        width *= 2
    top = ranks[width]
    at = np.flatnonzero(every[:-1] + window <= stop[:-1]).astype(np.int32)
    _, same, times = np.unique(top[at].astype(np.int64) << 32 | top[at + (window - width)], return_inverse=True, return_counts=True)
    at = at[times[same] > 1]
    blocks = range(0, int(length.max()), width)
    at = at[np.lexsort([stop[at] - at, *(top[beyond(at, step)] for step in reversed(blocks))])]
    a, b = at[:-1], at[1:]
    lcp, going = np.zeros(len(a), dtype=np.int32), np.ones(len(a), dtype=bool)
    for step in blocks:
        going &= top[beyond(a, step)] == top[beyond(b, step)]
        lcp += np.int32(width) * going
    while width > 8:
        width //= 2
        lcp += np.int32(width) * (ranks[width][beyond(a, lcp)] == ranks[width][beyond(b, lcp)])
    going[:] = True
    for _ in range(7):
        going &= data[beyond(a, lcp)] == data[beyond(b, lcp)]
        lcp += going
    lcp = np.minimum(lcp, np.minimum(stop[a] - a, stop[b] - b))
    of = np.searchsorted(end, at, "right")
    begin = (end - length)[of]
    return of, at - begin, lcp, np.where(at > begin, data[at - 1].astype(np.int64), -1)


def joined(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans a..b of the members ``of`` (small numbers), those that overlap or touch as one, in order."""
    if not len(of):
        return of, a, b
    order = np.lexsort((a, of))
    of, a, b = of[order], a[order], b[order]
    # Members lie so far apart that the furthest end so far never reaches the next one.
    apart = of * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + apart) - apart
    begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (a[1:] > reach[:-1])))
    return of[begin], a[begin], reach[np.append(begin[1:], len(of)) - 1]


def repeats_among(group: pd.DataFrame, window: int, spans: bool) -> pd.DataFrame:
    """Maximal repeats among different stretches: one row per repeat and stretch that has it, with the repeat's first occurrence.

    With ``spans``, only what each stretch repeats from earlier on, as (rank, a, b).
    """
    rank, start = group["rank"].to_numpy(), group["start"].to_numpy()
    some = np.flatnonzero(group.duplicated("key", keep=False).to_numpy() | group["moves"].to_numpy())
    found, member, at, place = np.empty((0, 3), np.int64), some[:0], some[:0], some[:0]
    if len(some):
        texts = group["stretch"].tolist()
        of, at, lcp, before = enhanced_array([texts[s] for s in some], window)
        # Where all suffixes of a run have one byte to the left, none of its intervals is a repeat of its own.
        runs = np.flatnonzero(np.append(True, lcp < window))[: len(at)]
        if len(at):
            least, most = np.minimum.reduceat(before, runs), np.maximum.reduceat(before, runs)
            alike = np.repeat((least == most) & (least >= 0), np.diff(np.append(runs, len(before))))
            lcp[alike[:-1] & alike[1:] & (lcp >= window)] = 0
        member = some[of]
        place = start[member] + at
        found = np.array(list(intervals(lcp, window)), dtype=np.int64).reshape(-1, 3)
    left, right, depth = found[np.argsort(found[:, 0], kind="stable")].T
    first = left
    if len(found):
        bounds = np.stack([left, right + 1], axis=1).ravel()

        def least_in(values: np.ndarray) -> np.ndarray:
            return np.minimum.reduceat(np.append(values, values[-1]), bounds)[::2]

        low = least_in(before)
        diverse = (low < 0) | (low != -least_in(-before))
        in_order = np.lexsort((place, rank[member]))
        turn = np.empty(len(at), dtype=np.int64)
        turn[in_order] = np.arange(len(at))
        left, right, depth, first = left[diverse], right[diverse], depth[diverse], in_order[least_in(turn)[diverse]]
    if spans:
        # The longest string of each suffix that starts earlier too: deeper intervals write over those around them, but for their first suffix.
        longest = np.zeros(len(at), dtype=np.int64)
        for i in np.argsort(depth, kind="stable").tolist():
            own = longest[first[i]]
            longest[left[i] : right[i] + 1] = depth[i]
            longest[first[i]] = own
        later = longest > 0
        which, a, b = joined(member[later], place[later], place[later] + longest[later])
        return pd.DataFrame({"rank": rank[which], "a": a, "b": b}).astype("int64")
    size = right - left + 1
    each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - left, size)
    i = member[each]
    return pd.DataFrame({
        "key": group["key"].to_numpy()[i], "content": group["content"].to_numpy()[i], "at": at[each], "length": np.repeat(depth, size),
        "first_rank": np.repeat(rank[member[first]], size), "first_start": np.repeat(place[first], size)}).astype("int64")


def scanner(window: int, spans: bool):
    """Rows sorted by key to repeats; whole keys are gathered until they fill a suffix array."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame["key"].to_numpy()
            filled = np.cumsum(frame["stretch"].str.len().to_numpy())
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], False)) + 1
            a = 0
            while True:
                done = filled[a - 1] if a else 0
                # The keys that fit; a key that does not fit with others has an array of its own.
                fits = ends[(ends > a) & (filled[ends - 1] - done <= SORTED_BYTES)]
                if len(ends) and ends[-1] > a and filled[-1] - done > SORTED_BYTES:
                    b = int(fits[-1]) if len(fits) else int(ends[ends > a][0])
                    yield repeats_among(frame.iloc[a:b], window, spans)
                    a = b
                else:
                    break
            rest = frame.iloc[a:]
        if rest is not None and len(rest):
            yield repeats_among(rest, window, spans)

    return run


REPEATS = "key long, content long, at long, length long, first_rank long, first_start long"


def window_repeats(crowded: DataFrame, window: int) -> DataFrame:
    """The repeats of window length among the stretches of crowded keys, by a plain aggregate over their windows."""
    windows = crowded.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("stretch") - window))).select(
        "key", "content", F.col("at").cast("long").alias("at"), "rank", (F.col("start") + F.col("at")).alias("start"),
        F.sha2(F.expr(f"substring(stretch, at + 1, {window})"), 256).alias("same"))
    groups = windows.groupBy("same").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("rank", "start")).alias("first")).where("found > 1")
    return windows.join(groups, "same").select(
        "key", "content", "at", F.lit(window).cast("long").alias("length"), F.col("first.rank").alias("first_rank"), F.col("first.start").alias("first_start"),
        "rank", "start")


class Corpus:
    """Blocks of the texts, the first copy of each text with its rank by id, and every row's place."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.spark = docs.sparkSession
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        blocks = rows.mapInArrow(blocks_of, f"block long, ids array<{kind}>, sizes array<long>, digests array<binary>, texts binary")
        self.table, parts = f"repeat_blocks_{uuid.uuid4().hex}", parts_of(self.spark)
        blocks.repartition(parts, "block").write.bucketBy(parts, "block").sortBy("block").saveAsTable(self.table, format="parquet")
        self.blocks = self.spark.table(self.table)
        each = self.blocks.select("block", F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("place", "d"))
        self.rows = materialize(each.select("block", "place", F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_bytes"), F.col("d.digests").alias("digest")), "repeat-rows")
        first = self.rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "block", "place")).alias("f"))
        self.firsts = materialize(with_ordered(first.select("digest", "f.*"), [], ["unnamed", "doc_id", "block", "place"], {"rank": Rank()}), "repeat-firsts")

    def close(self) -> None:
        """Drop the blocks, once nothing lazy reads them any more."""
        self.spark.sql(f"drop table if exists {self.table}")


class Stretches:
    """``all`` stretches with a key that occurs again; different ``contents``; ``bytes`` of those that need a suffix array."""

    def __init__(self, corpus: Corpus, window: int, together: int):
        blocks = corpus.blocks
        size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()[0] or 0
        bits = max(3, (size // RANGE_BYTES).bit_length())
        requests = blocks.select("block", "sizes", "digests", "texts").mapInPandas(
            asker(bits, window), "range int, block long, keys binary, owners binary, twice binary")
        told = requests.groupBy("range").applyInPandas(answer, "block long, range int, n int, again binary")
        firsts = corpus.firsts.select("block", F.lit(0).alias("range"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("again"), "place", "rank")
        answers = told.select("*", F.lit(0).alias("place"), F.lit(0).cast("long").alias("rank")).unionByName(firsts)
        found = blocks.select("block", "sizes", "digests", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
            stretcher(bits, window), "key long, content long, rank long, start long, length long, moves boolean, block long, place int")
        self.all = materialize(found, "repeat-stretches")
        first = F.min(F.struct("rank", "start", "length", "block", "place")).alias("f")
        self.contents = materialize(self.all.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), first, F.max("moves").alias("moves")).select(
            "key", "content", "copies", "moves", "f.*"), "repeat-contents")
        keys = self.contents.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("moves").alias("any")).where("n > 1 or any")
        wanted = self.contents.join(keys, "key").select(
            "key", "content", "moves", (F.col("n") > together).alias("crowded"), "rank", "start", "length", "block", "place")
        self.bytes = materialize(blocks.select("block", "sizes", "texts").groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(
            fetcher, "key long, content long, moves boolean, crowded boolean, rank long, start long, stretch binary"), "repeat-bytes")

    def scanned(self, window: int, spans: bool) -> DataFrame:
        grouped = self.bytes.where("not crowded").repartition("key").sortWithinPartitions("key")
        return grouped.mapInPandas(scanner(window, spans), "rank long, a long, b long" if spans else REPEATS)


def maximal_repeats(docs: DataFrame, window: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text", together: int = STRETCHES_TOGETHER) -> DataFrame:
    """Repeat groups with all occurrences: (first_doc, first_start, length, doc_id, start), in bytes.

    Repeats are sought among different texts and found in every copy of these; a text with copies is a repeat as a whole.
    """
    corpus = Corpus(docs, doc_id, text)
    parts = Stretches(corpus, window, together)
    corpus.close()
    whole = parts.contents.where("copies > 1").select(
        "key", "content", F.lit(0).cast("long").alias("at"), "length", F.col("rank").alias("first_rank"), F.col("start").alias("first_start"))
    many = window_repeats(parts.bytes.where("crowded"), window).drop("rank", "start")
    repeats = parts.scanned(window, False).unionByName(many).unionByName(whole)
    occurrences = repeats.join(parts.all.select("key", "content", "rank", "start"), ["key", "content"])
    names = corpus.rows.join(corpus.firsts.select("digest", "rank"), "digest").select("rank", "doc_id", "n_bytes")
    copied = names.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("n_bytes").alias("length")).where((F.col("n") > 1) & (F.col("length") >= window))
    none = F.lit(0).cast("long")
    alone = copied.select("rank", none.alias("at"), "length", F.col("rank").alias("first_rank"), none.alias("first_start"), none.alias("start"))
    # A whole text that is a repeat of others already has its group.
    known = occurrences.select("rank", "at", "length", "first_rank", "first_start", "start")
    same = known.where(F.col("start") + F.col("at") == 0).select("rank", "length")
    occurrences = known.unionByName(alone.join(same, ["rank", "length"], "left_anti"))
    firsts = corpus.firsts.select("rank", "doc_id").select(F.col("rank").alias("first_rank"), F.col("doc_id").alias("first_doc"))
    return occurrences.join(names, "rank").join(firsts, "first_rank").select(
        "first_doc", "first_start", "length", "doc_id", (F.col("start") + F.col("at")).alias("start"))


def cutter(blocks: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Digests and texts of what stays of the texts of a block that lose something."""
    out: dict[str, list] = {"block": [], "place": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
    for row in blocks.itertuples():
        if not len(spans):
            continue
        texts = texts_of(row.sizes, row.texts)
        for span in spans.itertuples():
            text, kept, at = texts[span.place], [], 0
            cover = np.array([(c["a"], c["b"]) for c in span.cover], dtype=np.int64)
            _, begin, end = joined(np.zeros(len(cover), dtype=np.int64), cover[:, 0], cover[:, 1])
            for a, b in zip(begin.tolist(), end.tolist()):
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            left = b"".join(kept)
            for column, value in zip(out.values(), (row.block, span.place, len(text) - len(left), len(begin), hashlib.sha256(left).hexdigest(), left)):
                column.append(value)
    return pd.DataFrame(out).astype({"block": "int64", "place": "int32", "n_removed": "int64", "n_spans": "int64", "kept_sha256": object, "kept_text": object})


def remove_repeats(docs: DataFrame, window: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text", together: int = STRETCHES_TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text) for every row of ``docs``.

    Every byte goes that a window of ``window`` bytes covers which also starts earlier. ``kept_text`` (bytes) is null where
    nothing goes or all does.
    """
    corpus = Corpus(docs, doc_id, text)
    parts = Stretches(corpus, window, together)
    # Every copy of a stretch but the first goes; of the first, what repeats earlier text.
    several = parts.contents.where("copies > 1").select("key", "content", F.col("rank").alias("first_rank"), F.col("start").alias("first_start"))
    again = (F.col("rank") != F.col("first_rank")) | (F.col("start") != F.col("first_start"))
    copies = parts.all.join(several, ["key", "content"]).where(again).select("rank", F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    many = window_repeats(parts.bytes.where("crowded"), window).where(again).select("rank", F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    reach = parts.scanned(window, True).union(many).union(copies).groupBy("rank", "a").agg(F.max("b").alias("b"))
    covers = reach.groupBy("rank").agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    placed = covers.join(corpus.firsts.select("rank", "block", "place"), "rank").select("block", "place", "cover")
    cut = corpus.blocks.select("block", "sizes", "texts").groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(
        cutter, "block long, place int, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
    cut = materialize(cut, "repeat-cut")
    corpus.close()
    marks = corpus.firsts.select("block", "place", F.lit(True).alias("is_first"))
    known = corpus.rows.join(marks, ["block", "place"], "left").join(cut, ["block", "place"], "left")
    copy = F.col("is_first").isNull() & (F.col("n_bytes") >= window)
    return known.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(~copy, F.col("kept_text")).alias("kept_text"))
