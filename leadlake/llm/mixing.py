"""Mixing sources to target weights by fitting a subset sum to each source's word budget.

A source's target becomes whole passes over it plus a remaining budget. The remaining budget
is fitted over the source's table of exact document lengths: every length gives its
proportional part, and a bounded knapsack over the counts that are left meets the rest of
the budget word for word where that is possible. Which documents of a length are taken is
a seeded choice, by rank of a hash.

Only the length table of one source, bounded by the longest document, meets in one task.

Defined cases: a null text has no words. Null is a source of its own, the last one. Documents
without words are never needed to fill a budget. Rows with the same id and size are chosen one
by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, text_or_empty
from leadlake.operators.ordered import Rank, with_ordered
from leadlake.session import materialize

# Words left to the knapsack after proportional and greedy filling.
KNAPSACK_WORDS = 1 << 15


def water_level(sources: DataFrame, cap: int) -> float:
    """Words per unit of weight when every source takes min(weight * level, cap * size) and all words are shared out.

    Capped sources leave the sharing for good, so the level only rises; it is found in a few
    aggregates over one row per source.
    """
    level, full = -1.0, F.col("source_size") * cap
    while True:
        capped = full < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(capped, full)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        if not row.total or not row.open:
            return max(level, 0.0)
        risen = (row.total - (row.taken or 0)) / row.open
        if risen <= level:
            return level
        level = risen


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as possible."""
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        more = min(int(counts[i] - taken[i]), max(0, rest - knapsack) // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    # Bounded knapsack: counts are split into powers of two, and each sum remembers the first item that reached it.
    reached = np.zeros(rest + 1, dtype=bool)
    reached[0] = True
    last = np.full(rest + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        left = min(int(counts[i] - taken[i]), rest // int(lengths[i]))
        step = 1
        while left > 0 and not reached[rest]:
            n = min(step, left)
            weight = n * int(lengths[i])
            fresh = np.zeros_like(reached)
            fresh[weight:] = reached[: rest + 1 - weight]
            fresh &= ~reached
            last[fresh] = len(items)
            reached |= fresh
            items.append((i, n))
            left, step = left - n, step * 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[last[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def fit_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group[group["size"] > 0]
    if group.empty:
        return pd.DataFrame({"source_no": [], "size": [], "chosen": []}).astype("int64")
    taken = fit_lengths(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["budget"].iloc[0]))
    return pd.DataFrame({"source_no": group["source_no"], "size": group["size"], "chosen": taken})


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 17, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", row: str | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for every row of ``docs``, and its number ``row`` if that is given.

    Sources in code point order, null last, take ``weights`` in turn and share as many words as
    the corpus has. A target never exceeds ``cap`` times its source. ``times`` says how often the
    document is taken, ``taken`` how many words that makes.
    """
    number = [row] if row else []
    rows = materialize(docs.select(
        *number, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
    ), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    numbered = with_ordered(sums, [], ["unnamed", "source"], {"source_no": Rank()})
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(numbered.withColumn("weight", turn), "mix-sources")
    level = water_level(sources, cap)
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * cap).cast("double"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = sources.withColumn("target", target).withColumn("passes", passes).withColumn(
        "budget", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    planned = materialize(planned.drop("unnamed").withColumnRenamed("source", "named"), "mix-plan")

    known = rows.join(planned, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    lengths = known.groupBy("source_no", "size", "budget").agg(F.count(F.lit(1)).alias("n"))
    chosen = lengths.groupBy("source_no").applyInPandas(fit_source, "source_no long, size long, chosen long")
    seeded = known.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    ranked = with_ordered(seeded, ["source_no", "size"], ["draw", "doc_id", *number], {"place": Rank()})
    times = F.col("passes") + F.when(F.col("place") <= F.coalesce("chosen", F.lit(0)), 1).otherwise(0)
    return ranked.join(chosen, ["source_no", "size"], "left").withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), *number)


def repeated(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, whatever their columns are called. ``key`` tells the rows apart: ids if they are
    unique, else a row number."""
    picks = mixed.where("times > 0").select(F.col(key).alias("picked"), "times")
    rows = docs.select(F.col(key).alias("key"), F.struct("*").alias("document"))
    again = rows.join(picks, F.col("key").eqNullSafe(F.col("picked"))).select("document", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select("document.*")
