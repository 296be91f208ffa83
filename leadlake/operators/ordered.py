"""Ordered per-group calculations that never put a whole group into one task.

A group (a job, say) may hold a large share of all rows. :func:`with_ordered` sorts the
rows by (group, order) into range partitions, so that even one group spreads over many
of them, works inside (partition, group), and carries one summary row per (partition,
group) across partitions. A group has at most as many summaries as there are partitions,
however sparse or crowded its order is. Null keys form a group like any other.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.session import materialize


@dataclass(frozen=True)
class Rank:
    """Row number inside the group, from 1."""


@dataclass(frozen=True)
class Total:
    """Sum of ``value`` over the rows strictly before the current one."""

    value: Column


@dataclass(frozen=True)
class Carried:
    """Last non-null ``value`` strictly before the row; ``backwards``: first one after it."""

    value: Column
    backwards: bool = False


def with_ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Rank | Total | Carried],
    parts: int | None = None,
) -> DataFrame:
    """Add ``columns`` to ``df``, each worked out per ``by`` group in ``order`` (ascending, nulls first).

    All columns share one range shuffle and one join with the summaries. The partitioned rows
    are written once, because range boundaries are sampled and must not be drawn twice. Rows
    equal in ``by`` and ``order`` come in any sequence; end ``order`` with a unique column where
    that matters.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v_{name}": spec.value for name, spec in columns.items() if not isinstance(spec, Rank)}
    cut = df.withColumns(values).repartitionByRange(parts, *by, *order) if values else df.repartitionByRange(parts, *by, *order)
    rows = materialize(cut.withColumn("_piece", F.spark_partition_id()), "ordered")

    rank_in_order = F.struct(*order)
    summaries, earlier, local, final = [], {}, {}, {}
    pieces = W.partitionBy(*by)
    inside = W.partitionBy("_piece", *by)
    forward = pieces.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    backward = pieces.orderBy(F.desc("_piece")).rowsBetween(W.unboundedPreceding, -1)
    up = inside.orderBy(*order)
    down = inside.orderBy(*[F.desc(c) for c in order])
    before = up.rowsBetween(W.unboundedPreceding, -1)
    after = down.rowsBetween(W.unboundedPreceding, -1)
    for name, spec in columns.items():
        value, edge, base, here = F.col(f"_v_{name}"), f"_s_{name}", f"_b_{name}", f"_l_{name}"
        if isinstance(spec, Rank):
            summaries.append(F.count(F.lit(1)).alias(edge))
            earlier[base] = F.coalesce(F.sum(edge).over(forward), F.lit(0))
            local[here] = F.row_number().over(up)
            final[name] = F.col(base) + F.col(here)
        elif isinstance(spec, Total):
            summaries.append(F.sum(value).alias(edge))
            earlier[base] = F.coalesce(F.sum(edge).over(forward), F.lit(0))
            local[here] = F.coalesce(F.sum(value).over(before), F.lit(0))
            final[name] = F.col(base) + F.col(here)
        else:
            pick = F.min_by if spec.backwards else F.max_by
            summaries.append(pick(value, F.when(value.isNotNull(), rank_in_order)).alias(edge))
            earlier[base] = F.last(edge, ignorenulls=True).over(backward if spec.backwards else forward)
            # Looking forward is looking back in descending order: growing frames stay linear.
            local[here] = F.last(value, ignorenulls=True).over(after if spec.backwards else before)
            final[name] = F.coalesce(F.col(here), F.col(base))

    keys = [f"_k{i}" for i in range(len(by))]
    carried = rows.groupBy("_piece", *by).agg(*summaries).withColumns(earlier).select(
        F.col("_piece").alias("_kp"), *[F.col(c).alias(k) for c, k in zip(by, keys)], *earlier
    )
    same = [F.col("_piece") == F.col("_kp"), *[F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]]
    joined = rows.withColumns(local).join(carried, functools.reduce(Column.__and__, same))
    return joined.withColumns(final).select(*[c for c in df.columns if c not in final], *final)


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Exact row number inside each ``by`` group, in ``order``."""
    return with_ordered(df, by, order, {out: Rank()}, parts)


def with_running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, parts: int | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before the current one."""
    return with_ordered(df, by, order, {out: Total(value)}, parts)


def with_carried(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, parts: int | None = None, backwards: bool = False
) -> DataFrame:
    """The last non-null ``value`` strictly before the current row; with ``backwards`` the first one strictly after it."""
    return with_ordered(df, by, order, {out: Carried(value, backwards)}, parts)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A join where null keys equal each other, as they do in groups."""
    names = {c: f"_same_{c}" for c in on}
    equal = [F.col(c).eqNullSafe(F.col(same)) for c, same in names.items()]
    return left.join(right.withColumnsRenamed(names), functools.reduce(lambda a, b: a & b, equal), how).drop(*names.values())
