"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes and sorted by the first one. Groups of
neighbours meet pairwise in tasks; tiles of a pair accumulate the leading coordinates first.
What the other coordinates can still add is at most the product of the two suffix norms, so
most pairs stop after a few coordinates. Pairs that survive are decided by the cosine of the
original vectors in double precision.

Tasks return link counts and a spanning forest of their links, never the pairs. Equal vectors are
compared once and counted with their number.

Defined cases: vectors that are null, empty or zero, or hold a null or non-finite component, link
with nothing, also not with their copies. Vectors of different lengths are never linked. Rows
without an id link with nothing and have no component. Repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.graph import components
from leadlake.session import materialize

# Vectors in one group at most; a task holds two groups.
GROUP_ROWS = 8192
GROUPS_AT_LEAST = 8
TILE = 1024
# Coordinates after which the bound is tested.
STAGES = (8, 16, 24, 32, 48)
# Rounding slack of the bounds; the final test has none.
SLACK = 1e-9
# Share of open pairs below which a tile goes on pair by pair.
SPARSE = 0.02
PAIRS_AT_ONCE = 1 << 16


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares in range.
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            u = unit(matrix(batch["v"]))
            total = u.T @ u if total is None else total + u.T @ u
    if total is not None:
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Axes in columns, strongest first. The matrix has size x size entries, whatever the number of rows."""
    sums = vectors.select("v").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    second = np.zeros((size, size))
    for row in sums:
        second[row.i, row.j] = row.s
    return np.linalg.eigh(second)[1][:, ::-1]


def projector(axes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(p=unit(matrix(batch["v"])) @ axes[:, 0])

    return run


class Side:
    """One group's vectors: rotated coordinates, suffix norms after each stage, originals, counts."""

    def __init__(self, frame: pd.DataFrame, axes: np.ndarray):
        frame = frame.sort_values("p", kind="stable")
        self.id, self.n, self.raw = frame["unit_no"].to_numpy(), frame["n"].to_numpy(), matrix(frame["v"])
        self.x = unit(self.raw) @ axes
        self.stages = [s for s in STAGES if s < self.x.shape[1]] + [self.x.shape[1]]
        squares = np.cumsum(self.x[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, s]) if s < self.x.shape[1] else np.zeros(len(self.x)) for s in self.stages]
        self.raw = self.raw / np.abs(self.raw).max(axis=1, keepdims=True)
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))


def linked(a: Side, b: Side, rows: slice, columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile with cosine >= threshold."""
    low = threshold - SLACK
    acc, done, open_pairs = 0.0, 0, None
    for stage, end in enumerate(a.stages):
        acc = acc + a.x[rows, done:end] @ b.x[columns, done:end].T
        done = end
        open_pairs = acc + np.outer(a.rest[stage][rows], b.rest[stage][columns]) >= low
        if open_pairs.mean() < SPARSE:
            break
    if a is b and rows == columns:
        open_pairs &= np.tri(*open_pairs.shape, -1, dtype=bool).T
    i, j = np.nonzero(open_pairs)
    value = acc[i, j]
    i, j = i + rows.start, j + columns.start
    found = []
    for at in range(0, len(i), PAIRS_AT_ONCE):
        p, q, v, gone = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE], value[at : at + PAIRS_AT_ONCE], done
        for stage, end in enumerate(a.stages):
            if end > gone:
                v = v + np.einsum("ij,ij->i", a.x[p, gone:end], b.x[q, gone:end])
                gone = end
                keep = v + a.rest[stage][p] * b.rest[stage][q] >= low
                p, q, v = p[keep], q[keep], v[keep]
        cosine = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.norm[p] * b.norm[q])
        found.append((p[cosine >= threshold], q[cosine >= threshold]))
    return tuple(np.concatenate(x) if found else np.empty(0, dtype=np.int64) for x in zip(*found)) if found else (np.empty(0, int),) * 2


def settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of every link the smaller label until nothing changes."""
    while True:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def comparer(axes: np.ndarray, threshold: float):
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a = Side(frame[frame["side"] == 0], axes)
        same = bool((frame["side"] == 0).all())
        b = a if same else Side(frame[frame["side"] == 1], axes)
        shift = 0 if same else len(a.id)
        ids = a.id if same else np.concatenate([a.id, b.id])
        links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for r in range(0, len(a.id), TILE):
            rows = slice(r, min(r + TILE, len(a.id)))
            for c in range(r if same else 0, len(b.id), TILE):
                columns = slice(c, min(c + TILE, len(b.id)))
                # Both sides are sorted by the first coordinate.
                if b.x[columns.start, 0] - a.x[rows.stop - 1, 0] > reach or a.x[rows.start, 0] - b.x[columns.stop - 1, 0] > reach:
                    continue
                i, j = linked(a, b, rows, columns, threshold)
                links += np.bincount(i, weights=b.n[j], minlength=len(ids)).astype(np.int64)
                links += np.bincount(j + shift, weights=a.n[i], minlength=len(ids)).astype(np.int64)
                settle(label, i, j + shift)
        some = links > 0
        return pd.DataFrame({"unit_no": ids[some], "links": links[some], "root": ids[label[some]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    units = materialize(rows.where(sound).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")).withColumn(
        "unit_no", F.monotonically_increasing_id()), "vector-units")
    counted = [(r.size, r.n) for r in units.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()]
    found = [compared(units.where(F.size("v") == size), size, n, threshold) for size, n in counted]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    results = found[0]
    for more in found[1:]:
        results = results.union(more)
    results = materialize(results, "vector-links")
    counts = results.groupBy("unit_no").agg(F.sum("links").alias("links"))
    members = components(results.select(F.col("unit_no").alias("a"), F.col("root").alias("b")), "vector-components")
    named = members.join(units, F.col("node") == F.col("unit_no")).select("unit_no", "component", "first_id")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    groups = named.join(smallest, "component").select("unit_no", "component_id")
    known = units.join(counts, "unit_no", "left").join(groups, "unit_no", "left").select(
        F.col("v").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    joined = rows.withColumn("sound", sound).join(known, F.col("sound") & (F.col("v") == F.col("same")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def compared(units: DataFrame, size: int, n: int, threshold: float) -> DataFrame:
    """(unit_no, links, root) from every pair of groups: link counts, and the unit's root in the pair's forest."""
    axes = principal_axes(units, size)
    groups = max(GROUPS_AT_LEAST, -(-n // GROUP_ROWS))
    kind = units.schema["v"].dataType.simpleString()
    placed = units.select("unit_no", "n", "v").mapInPandas(projector(axes), f"unit_no long, n long, v {kind}, p double")
    sorted_groups = materialize(placed.repartitionByRange(groups, "p", "unit_no").withColumn("g", F.spark_partition_id()), "vector-groups")
    # One row per group of up to GROUP_ROWS vectors.
    bounds = sorted_groups.groupBy("g").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    partners = bounds.select("g", "high", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h")).where("h >= g")
    others = bounds.select(F.col("g").alias("h"), F.col("low").alias("h_low"), F.col("high").alias("h_high"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    # Sorted groups follow one another, but sampling decides where they end, so both directions are tested.
    pairs = partners.join(others, "h").where(F.col("h_low") - F.col("high") <= reach).select("g", "h")
    left = sorted_groups.join(pairs, "g").select("g", "h", F.lit(0).alias("side"), "unit_no", "n", "v", "p")
    right = sorted_groups.withColumnRenamed("g", "h").join(pairs.where("g <> h"), "h").select("g", "h", F.lit(1).alias("side"), "unit_no", "n", "v", "p")
    return left.union(right).groupBy("g", "h").applyInPandas(comparer(axes, threshold), "unit_no long, links long, root long")
