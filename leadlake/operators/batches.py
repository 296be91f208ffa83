"""Which delivery batch each lead of a job belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.operators.ordered import null_safe_join, with_rank
from leadlake.session import materialize

# Leads per batch and seconds between batches.
BATCH_SIZE = 50
BATCH_TIMEOUT_S = 3.0
# Rows of one job that are walked in one go.
BLOCK_ROWS = 100_000


def assign_flush_batches(
    leads: DataFrame,
    size: int = BATCH_SIZE,
    timeout_s: float = BATCH_TIMEOUT_S,
    order: str = "n",
    arrival: str = "arrival_s",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``batch_no``, counted from 0 per job.

    The first lead is delivered alone. Afterwards an arriving lead triggers a delivery
    when ``size`` leads wait or ``timeout_s`` passed since the last delivery; the end of
    the job delivers the rest. ``arrival`` never decreases along ``order``.

    The next delivery lies at most ``size`` leads ahead, so a long job is cut into
    blocks: for each of the ``size`` ways to enter a block its way out is worked out in
    parallel, the ways are chained (one row per block), then all blocks are numbered. Leads
    without a job are a job of their own.
    """
    block_rows = max(block_rows, size)
    # Read several times below, so it is written once.
    ranked = materialize(with_rank(leads, ["job_id"], [order], "_rank").withColumn(
        "_block", F.floor((F.col("_rank") - 1) / block_rows).cast("bigint")
    ), "flush-ranks")
    steps = ranked.select("job_id", "_block", "_rank", F.col(arrival).cast("double").alias("_t"))
    long_jobs = steps.where(F.col("_rank") == block_rows + 1).select("job_id")
    entries = _block_entries(null_safe_join(steps, long_jobs, ["job_id"], "left_semi"), size, timeout_s, block_rows)

    placed = null_safe_join(steps, entries, ["job_id", "_block"], "left").select(
        "job_id", "_block", "_rank", "_t",
        F.coalesce("_entry", F.lit(0).cast("bigint")).alias("_entry"), F.coalesce("_base", F.lit(0).cast("bigint")).alias("_base"),
    )
    in_order = placed.repartition("job_id", "_block").sortWithinPartitions("job_id", "_block", "_rank")
    schema = placed.select("job_id", "_rank", F.col("_base").alias("batch_no")).schema
    numbered = in_order.mapInPandas(_number_rows(size, timeout_s), schema)
    return null_safe_join(ranked, numbered, ["job_id", "_rank"], "inner").drop("_rank", "_block")


def _block_entries(steps: DataFrame, size: int, timeout_s: float, block_rows: int) -> DataFrame:
    """(job_id, _block, _entry, _base): first delivery inside the block and deliveries before it."""
    head = steps.where((F.col("_block") > 0) & ((F.col("_rank") - 1) % block_rows < size))
    ahead = head.withColumn("_block", F.col("_block") - 1).withColumn("_own", F.lit(False))
    walk = steps.withColumn("_own", F.lit(True)).unionByName(ahead)

    numbers = T.ArrayType(T.LongType())
    exits_schema = steps.select("job_id", "_block").schema.add("_exits", numbers).add("_counts", numbers)
    exits = walk.groupBy("job_id", "_block").applyInPandas(_block_exits(size, timeout_s), exits_schema)

    entry_schema = steps.select("job_id", "_block").schema.add("_entry", T.LongType()).add("_base", T.LongType())
    in_order = exits.repartition("job_id").sortWithinPartitions("job_id", "_block")
    return in_order.mapInPandas(_chain_blocks, entry_schema)


def _block_exits(size: int, timeout_s: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_rank")
        times = block["_t"].to_numpy()
        own = int(block["_own"].sum())
        by_time = np.searchsorted(times, times[:own] + timeout_s, side="left")
        following = np.minimum(np.maximum(by_time, np.arange(own) + 1), np.arange(own) + size)
        leaves, counts = np.full(own, -1, dtype=int), np.ones(own, dtype=int)
        for at in range(own - 1, -1, -1):
            step = following[at]
            if step < own:
                leaves[at], counts[at] = leaves[step], counts[step] + 1
            elif step < len(times):
                leaves[at] = step - own
        first = block.iloc[0]
        return pd.DataFrame(
            {"job_id": [first["job_id"]], "_block": [first["_block"]],
             "_exits": [leaves[:size].tolist()], "_counts": [counts[:size].tolist()]}
        )

    return run


def _chain_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    job, entry, base = object(), 0, 0
    for batch in batches:
        entries, bases = [], []
        for row in batch.itertuples(index=False):
            if row[0] != job:
                job, entry, base = row[0], 0, 0
            entries.append(entry)
            bases.append(base)
            if 0 <= entry < len(row[2]):
                base += int(row[3][entry])
                entry = int(row[2][entry])
            else:
                entry = -1
        yield pd.DataFrame({"job_id": batch["job_id"], "_block": batch["_block"], "_entry": entries, "_base": bases})


def _number_rows(size: int, timeout_s: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, at, number, waiting, last = object(), 0, 0, 0, None
        for batch in batches:
            numbers = []
            rows = zip(batch["job_id"], batch["_block"], batch["_t"], batch["_entry"], batch["_base"])
            for job, block, t, entry, base in rows:
                if (job, block) != place:
                    place, at, number, waiting, last = (job, block), 0, base, 0, None
                numbers.append(number)
                waiting += 1
                due = at == entry if last is None else waiting >= size or t >= last + timeout_s
                if due:
                    number, waiting, last = number + 1, 0, t
                at += 1
            yield pd.DataFrame({"job_id": batch["job_id"], "_rank": batch["_rank"], "batch_no": numbers})

    return run
