"""Per-job caps and the list of stale cache entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.operators.ordered import with_rank

STALE_BATCH = 50
# Largest k for which Catalyst cuts each map task to k rows per group before the shuffle.
GROUP_LIMIT = 1000


def cap_per_job(
    df: DataFrame,
    limit: str | Column = "max_results",
    by: Sequence[str] = ("job_id",),
    order: Sequence[str] = ("n",),
    largest: int | None = None,
) -> DataFrame:
    """First ``limit`` rows of each job in ``order``; the limit may differ per row's job.

    ``largest`` is the highest limit in the data (looked up when not given, which reads
    ``df`` once more). Where limits live in a jobs table, :func:`cap_by_jobs` is cheaper. Null keys
    are a job of their own; a null order comes first.
    """
    allowed = F.col(limit) if isinstance(limit, str) else limit
    if largest is None:
        largest = df.agg(F.max(allowed)).first()[0] or 0
    return _first_rows(df, by, order, largest).where(F.col("_rank") <= allowed).drop("_rank")


def cap_by_jobs(
    df: DataFrame,
    jobs: DataFrame,
    limit: str | Column = "max_results",
    by: Sequence[str] = ("job_id",),
    order: Sequence[str] = ("n",),
    largest: int | None = None,
) -> DataFrame:
    """Join ``jobs`` and keep the first ``limit`` rows of each job.

    Rows are cut to the largest limit before the join, so a huge job is small by the time
    it meets its job record, whichever way the join runs.
    """
    allowed = F.col(limit) if isinstance(limit, str) else limit
    if largest is None:
        largest = jobs.agg(F.max(allowed)).first()[0] or 0
    first = _first_rows(df, by, order, largest)
    return first.join(jobs, list(by), "inner").where(F.col("_rank") <= allowed).drop("_rank")


def _first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], largest: int) -> DataFrame:
    """The first ``largest`` rows of each group, with their ``_rank``.

    Up to ``GROUP_LIMIT`` every map task keeps at most that many rows per group before the
    shuffle, so a huge group never reaches one task. Higher limits use ranks over range partitions.
    """
    if largest > GROUP_LIMIT:
        return with_rank(df, by, order, "_rank").where(F.col("_rank") <= F.lit(int(largest)))
    position = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", position).where(F.col("_rank") <= F.lit(int(largest)))


def stale_entries(
    index: DataFrame, meta: DataFrame, now: float, age_s: int, limit: int = STALE_BATCH
) -> DataFrame:
    """Metadata of the searches not refreshed for ``age_s`` seconds, oldest first.

    The limit applies to the index before entries without metadata are dropped, so
    fewer than ``limit`` rows may come back. ``index`` has (hash, updated_at).
    """
    oldest = (
        index.where(F.col("updated_at") <= F.lit(now - age_s))
        .orderBy("updated_at", "hash")
        .limit(limit)
    )
    # At most ``limit`` rows, so broadcasting them is bounded by construction.
    return meta.join(F.broadcast(oldest), "hash", "inner")
