"""Near-duplicate documents by order MinHash and banded alignment.

Texts are sequences of five-word shingles, each labelled with its occurrence number. A sketch takes the few
labelled shingles with the smallest seeded hashes and keeps their order in the text, so it
answers to edits rather than to mere common content. Texts that share a sketch are compared by
a banded alignment of their whole shingle sequences: the similarity is L / (n + m - L) for L
aligned shingles. All shingles of a text differ, so the alignment is a longest increasing
subsequence of the matches within the band that the threshold leaves.

Texts with the same words in the same order are one node. In each bucket every member is aligned
with its leader, the one that has most company. What that leaves in different components meets once
more, among all that share a leader: in a task, products of sparse incidence matrices count the shingles
each two members share, and pairs that share enough are aligned until their components have merged.
Only the links of a spanning forest leave the task. Large meetings are parted by bucket; what is large still is cut into
tiles that meet in pairs, so every pair that shares a bucket is compared, at the square of what a bucket leaves apart.

With 20 sketches of 3 shingles, a pair at the threshold is missed with a probability under 1e-5.

Defined cases: case of A-Z and kind of white space do not matter. A null text is empty; all texts without words are
one class. A text under five words is one shingle. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.graph import components
from leadlake.llm.lm import mixed
from leadlake.llm.words import batches_of, document_words, labelled_shingles
from leadlake.session import materialize

SHINGLE_WORDS, THRESHOLD = 5, 0.8
SKETCHES, PICKED = 20, 3
# Members of one tile; a task holds two. Meetings of more tiles than that are parted first.
TILE_ROWS, TILES_TOGETHER = 512, 32
# Whether a large meeting is parted by bucket before it is tiled.
PARTINGS = 1
# Columns of the incidence matrix at once.
SHINGLES_AT_ONCE = 1 << 12
# Hashes of shingles at once while a text is sketched.
RANKS_AT_ONCE = 1 << 21


def order_sketches(shingles: np.ndarray, sketches: int, picked: int) -> np.ndarray:
    """One hash per seed, of the ``picked`` labelled shingles with the smallest hashes in text order."""
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    picked = min(picked, len(shingles))
    # Few seeds at once for a long text.
    step = max(1, RANKS_AT_ONCE // len(shingles))
    least = np.concatenate([
        np.argpartition(mixed(shingles[None, :] ^ seeds[at : at + step, None]), picked - 1, axis=1)[:, :picked] for at in range(0, sketches, step)])
    in_order = shingles[np.sort(least, axis=1)]
    weights = mixed(np.arange(7, 7 + picked, dtype=np.uint64)) | np.uint64(1)
    return mixed((in_order * weights).sum(axis=1, dtype=np.uint64) ^ seeds)


def sketcher(k: int, sketches: int, picked: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in batches_of(texts):
                size, labelled, whole = labelled_shingles(*document_words(texts[a:b]), k)
                ends = np.cumsum(size)
                found = [order_sketches(labelled[e - s : e], sketches, picked).astype(np.int64) if s else np.empty(0, np.int64) for s, e in zip(size, ends)]
                check = [int(np.bitwise_xor.reduce(labelled[e - s : e])) if s else 0 for s, e in zip(size, ends)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(3).slice(a, b - a) if batch.num_columns > 3 else pa.array(part + n + np.arange(b - a), pa.int64()),
                    batch.column(2).slice(a, b - a), pa.array(whole.astype(np.int64)),
                    pa.array(np.array(check, dtype=np.uint64).astype(np.int64)), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.int64())),
                ], names=["doc_id", "row", "raw", "whole", "check", "n", "sketches"])
                n += b - a

    return run


def sequencer(k: int):
    """(node, whole, text) to (node, shingles) where the text is the node's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            nodes, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in batches_of(texts):
                size, labelled, whole = labelled_shingles(*document_words(texts[a:b]), k)
                ends = np.cumsum(size)
                mine = [i for i in range(b - a) if whole[i].astype(np.int64) == wanted[a + i]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([nodes[a + i] for i in mine], pa.int64()), pa.array([labelled[ends[i] - size[i] : ends[i]].tobytes() for i in mine], pa.binary()),
                ], names=["node", "shingles"])

    return run


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned share of two sequences of distinct shingles; 0 where it cannot reach ``threshold``."""
    n = len(a) + len(b)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < threshold * (n - len(common)):
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    band = n * (1 - threshold) / (1 + threshold)
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and (np.diff(j) <= 0).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        aligned = len(tails)
    else:
        aligned = len(j)
    return aligned / (n - aligned)


def aligner(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("left_shingles", "right_shingles"))
            good = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) >= threshold for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def node_sequences(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, n, shingles) of the wanted nodes, from the text of each node's first document; ``nodes`` has (node, doc_id, row, raw, whole).

    Without row numbers, a document is found by its id and the hash of its text together, as many may have one id or none.
    """
    keys = ["row"] if "row" in docs.columns else ["doc_id", "raw"]
    first = wanted.select("node").distinct().join(nodes, "node").select("node", "whole", *[F.col(key).alias(f"first_{key}") for key in keys])
    texts = docs.join(first, [F.col(key).eqNullSafe(F.col(f"first_{key}")) for key in keys]).select("node", "whole", "text")
    return materialize(texts.mapInArrow(sequencer(k), "node long, shingles binary").dropDuplicates(["node"]), "near-sequences")


def aligned_pairs(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    left = pairs.join(sequences.select(F.col("node").alias("a"), F.col("shingles").alias("left_shingles")), "a")
    both = left.join(sequences.select(F.col("node").alias("b"), F.col("shingles").alias("right_shingles")), "b")
    return materialize(both.select("a", "b", "left_shingles", "right_shingles").mapInArrow(aligner(threshold), "a long, b long"), "near-links")


def shared_counts(sequences: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sequences share. Shingles that only one of them has are left out of the matrix."""
    flat = np.concatenate(sequences)
    owner = np.repeat(np.arange(len(sequences)), [len(x) for x in sequences])
    distinct, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    useful = n[at] > 1
    owner, column = owner[useful], column[at[useful]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sequences),) * 2, dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SHINGLES_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + SHINGLES_AT_ONCE])
        part = np.zeros((len(sequences), min(SHINGLES_AT_ONCE, int(column[b - 1]) - low + 1)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def joiner(threshold: float):
    """Links of a spanning forest among the members of a meeting of two tiles, given their components so far."""
    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.drop_duplicates("node")
        node, comp, tile = (members[c].to_numpy() for c in ("node", "component", "tile"))
        low, high = members["low"].iloc[0], members["high"].iloc[0]
        sequences = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
        size = np.array([len(x) for x in sequences], dtype=np.float64)
        common = shared_counts(sequences)
        enough = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
        enough &= comp[:, None] != comp[None, :]
        if low != high:
            enough &= tile[:, None] != tile[None, :]
        i, j = np.nonzero(np.triu(enough, 1))
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for x in np.argsort(-common[i, j], kind="stable"):
            p, q = int(i[x]), int(j[x])
            a, b = find(int(comp[p])), find(int(comp[q]))
            if a != b and similarity(sequences[p], sequences[q], threshold) >= threshold:
                root[max(a, b)] = min(a, b)
                links.append((node[p], node[q]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def remaining_links(members: DataFrame, sequences: DataFrame, threshold: float, tile_rows: int, tiles_together: int, partings: int) -> DataFrame:
    """Links among (leader, bucket, node, component) that share a leader, in large meetings a bucket, and lie in different components."""
    found = None
    rows = members.select(F.col("leader").alias("meeting"), "bucket", "node", "component")
    for level in range(2):
        sizes = rows.groupBy("meeting").agg(
            F.approx_count_distinct("node", 0.02).alias("size"), F.min("component").alias("first"), F.max("component").alias("last"))
        rows = materialize(rows.join(sizes.where("first <> last").select("meeting", "size"), "meeting"), "near-meetings")
        # Once parted by bucket a meeting is tiled whole, however large: any further parting would lose pairs that share this bucket alone.
        last = level == 1 or not partings
        large = F.col("size") > tile_rows * tiles_together
        here = rows if last else rows.where(~large)
        tiles = F.ceil(F.col("size") / F.lit(tile_rows)).cast("int")
        seated = here.select("meeting", "node", "component", tiles.alias("tiles")).distinct().withColumn(
            "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        # Each tile meets every other one; alone it meets itself.
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        cells = seated.select("meeting", "node", "component", "tile", other).select(
            "meeting", "node", "component", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        links = cells.join(sequences, "node").groupBy("meeting", "low", "high").applyInPandas(joiner(threshold), "a long, b long")
        found = links if found is None else found.union(links)
        rest = rows.where(large)
        if last or rest.isEmpty():
            break
        rows = rest.select(F.xxhash64("meeting", "bucket").alias("meeting"), "bucket", "node", "component")
    return found


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, threshold: float = THRESHOLD, sketches: int = SKETCHES,
    picked: int = PICKED, tile_rows: int = TILE_ROWS, tiles_together: int = TILES_TOGETHER, partings: int = PARTINGS,
    row: str | None = None,
) -> DataFrame:
    """(doc_id, class_id, kept, class_size, row) for every row; ``kept`` marks the first row of each class.

    ``row`` names a long column that numbers the rows of ``docs``; without it they are numbered as they are read.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("raw"), *([F.col(row).alias("row")] if row else []))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = materialize(narrow.mapInArrow(
        sketcher(k, sketches, picked), f"doc_id {kind}, row long, raw long, whole long, check long, n long, sketches array<long>"), "near-sketches")
    same = ["whole", "check", "n"]
    nodes = materialize(rows.groupBy(*same).agg(F.min_by(F.struct("doc_id", "row", "raw", "sketches"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(
        F.monotonically_increasing_id().alias("node"), *same, "first.doc_id", "first.row", "first.raw", "first.sketches"), "near-nodes")
    # Buckets of one node say nothing; the others lose their largest part here.
    slots = nodes.select("node", F.posexplode("sketches").alias("slot", "value")).select("node", "slot", F.xxhash64("slot", "value").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(slots.join(shared, "bucket"), "near-slots")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    met = members.join(company, "node")
    leaders = met.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("best")).select("bucket", (-F.col("best.minus")).alias("leader"))
    stars = members.join(leaders, "bucket").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = materialize(stars, "near-stars")
    sequences = node_sequences(stars.select(F.col("a").alias("node")).union(stars.select("b")), narrow, nodes, k)
    links = aligned_pairs(stars, sequences, threshold)
    first = components(links, "near-components")
    label = members.select("bucket", "node").join(leaders, "bucket").join(first, "node", "left").select(
        "leader", "bucket", "node", F.coalesce("component", "node").alias("component"))
    more = materialize(remaining_links(label, sequences, threshold, tile_rows, tiles_together, partings), "near-more-links")
    final = components(links.union(more), "near-components")
    classes = nodes.join(final, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    placed = rows.drop("sketches", "raw").join(classes, same)
    heads = placed.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(heads, "component").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept"), "class_size", "component", "row")
