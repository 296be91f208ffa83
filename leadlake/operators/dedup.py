"""Duplicate removal: exact links, and the ordered two-key rule for leads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.text import absent_as_null, norm_text, phone_key
from leadlake.operators.ordered import null_safe_join, with_rank
from leadlake.session import materialize

# Part of the rows that a parallel round may leave undecided and still be followed by another one.
ROUND_LEAVES = 0.75
# Largest number of distinct candidates of one job that a single task decides.
GROUP_ROWS = 200_000


def dedup_urls(
    cards: DataFrame, by: Sequence[str] = ("job_id",), url: str = "url", order: str = "position"
) -> DataFrame:
    """First occurrence of each exact link within a job.

    An aggregate instead of a window: copies of a hot link collapse before the shuffle. Spark sorts rows to aggregate
    texts; a hash of the keys goes first, so that it compares numbers and not long links that begin alike.
    """
    keys = [*by, url]
    rest = [c for c in cards.columns if c not in keys]
    first = cards.withColumn("_hash_first", F.xxhash64(*keys)).groupBy("_hash_first", *keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*cards.columns)


def dedup_leads(
    leads: DataFrame,
    scope: str = "job_id",
    order: str = "n",
    name: str = "name",
    city: str = "city",
    phone: str = "phone",
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Greedy ordered removal by two keys, per ``scope``.

    In ``order`` (unique inside a scope), a row is dropped when an earlier *kept* row has
    the same normalised name and city, or the same non-empty phone. Dropped rows
    register nothing. ``largest`` is a known bound on the rows of a scope (after a cap);
    without one the sizes are looked up.
    """
    keyed = leads.select(
        scope,
        order,
        norm_text(F.col(name)).alias("_name"),
        norm_text(F.col(city)).alias("_city"),
        absent_as_null(phone_key(F.col(phone))).alias("_phone"),
    )
    kept = greedy_keep(keyed, scope, order, group_rows, largest)
    return null_safe_join(leads, kept, [scope, order], "left_semi")


def greedy_keep(
    keyed: DataFrame, scope: str, order: str, group_rows: int = GROUP_ROWS, largest: int | None = None
) -> DataFrame:
    """(scope, order) of the rows the greedy rule keeps; ``_name``, ``_city``, ``_phone`` are the keys.

    Rows equal in all keys can only be represented by the earliest, so an aggregate
    shrinks the input first. Scopes with at most ``group_rows`` candidates are decided
    in one sorted pass. Larger ones go in parallel rounds: rows that come first under both keys are kept, and the rows they beat leave.
    No row is decided before all earlier rows it conflicts with, so this is the sequential rule. Rounds end when what is left of
    every scope fits one pass, which decides it, or when a round decides too little, as in long chains of conflicts; then
    blocks follow in order: rows that conflict with an earlier block's kept ones leave, the
    rest of the block is decided in one pass. There are rows / ``group_rows`` blocks, whatever
    the conflicts look like. A null scope is a scope of its own.
    """
    names = [scope, "_name", "_city"]
    slim = materialize(keyed.groupBy(*names, "_phone").agg(F.min(order).alias(order)), "dedup-rows")
    if largest is None or largest > group_rows:
        largest = slim.groupBy(scope).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_rows:
        return _decide_in_order(slim, scope, order)

    sizes = slim.groupBy(scope).count()
    large = materialize(sizes.where(F.col("count") > group_rows).select(scope), "dedup-large")
    decided = [_decide_in_order(null_safe_join(slim, large, [scope], "left_anti"), scope, order)]
    remaining = null_safe_join(slim, large, [scope], "left_semi")
    left = sizes.where(F.col("count") > group_rows).agg(F.sum("count")).first()[0]
    while True:
        winners = materialize(_round_winners(remaining, scope, order), "dedup-kept")
        decided.append(winners.select(scope, order))
        remaining = materialize(_without(remaining, winners, scope, names), "dedup-left")
        before, (left, largest) = left, remaining.groupBy(scope).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if largest <= group_rows:
            decided.append(_decide_in_order(remaining, scope, order))
            return reduce(DataFrame.unionByName, decided)
        if left > ROUND_LEAVES * before:
            break
    block = F.floor((F.col("_rank") - 1) / F.lit(group_rows)).cast("bigint")
    blocks = materialize(with_rank(remaining, [scope], [order], "_rank").withColumn("_block", block).drop("_rank"), "dedup-blocks")
    last = blocks.agg(F.max("_block")).first()[0]
    # Nothing that is left conflicts with a row kept in the rounds.
    kept = blocks.drop("_block").limit(0)
    for n in range(0 if last is None else last + 1):
        rows = _without(blocks.where(F.col("_block") == n).drop("_block"), kept, scope, names)
        chosen = _decide_in_order(rows, scope, order)
        kept = kept.unionByName(materialize(null_safe_join(blocks.drop("_block"), chosen, [scope, order], "left_semi"), "dedup-kept"))
    return reduce(DataFrame.unionByName, [*decided, kept.select(scope, order)])


def _without(rows: DataFrame, kept: DataFrame, scope: str, names: Sequence[str]) -> DataFrame:
    """Rows that share neither the name nor a phone with a kept one."""
    phones = kept.where(F.col("_phone").isNotNull())
    other_names = null_safe_join(rows, kept, names, "left_anti")
    silent = other_names.where(F.col("_phone").isNull())
    return silent.unionByName(null_safe_join(other_names.where(F.col("_phone").isNotNull()), phones, [scope, "_phone"], "left_anti"))


def _round_winners(rows: DataFrame, scope: str, order: str) -> DataFrame:
    """Rows that come first both among their name and among their phone.

    Both minima are aggregates and meet on the unique (scope, order), so neither a
    frequent name nor a frequent phone gathers in one task.
    """
    first_of_name = rows.groupBy(scope, "_name", "_city").agg(
        F.min(F.struct(order, "_phone")).alias("_f")
    ).select(scope, "_name", "_city", "_f.*")
    first_of_phone = rows.where(F.col("_phone").isNotNull()).groupBy(scope, "_phone").agg(
        F.min(order).alias(order)
    ).select(scope, order)
    without_phone = first_of_name.where(F.col("_phone").isNull())
    with_phone = null_safe_join(first_of_name.where(F.col("_phone").isNotNull()), first_of_phone, [scope, order], "left_semi")
    return without_phone.unionByName(with_phone)


def _decide_in_order(slim: DataFrame, scope: str, order: str) -> DataFrame:
    """One sorted pass per partition; memory holds the keys of the current scope only."""
    columns = [scope, order, "_name", "_city", "_phone"]
    ordered = slim.select(*columns).repartition(scope).sortWithinPartitions(scope, order)
    schema = ordered.select(scope, order).schema
    return ordered.mapInPandas(_first_wins(scope, order), schema)


def _first_wins(scope: str, order: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken_names, taken_phones = object(), set(), set()
        for batch in batches:
            keep = []
            for key, name, city, phone in zip(batch[scope], batch["_name"], batch["_city"], batch["_phone"]):
                # A null scope arrives as None, or as NaN where scopes are numbers.
                if key != current and not (key != key and current != current):
                    current, taken_names, taken_phones = key, set(), set()
                fresh = (name, city) not in taken_names and (phone is None or phone not in taken_phones)
                if fresh:
                    taken_names.add((name, city))
                    if phone is not None:
                        taken_phones.add(phone)
                keep.append(fresh)
            yield batch.loc[keep, [scope, order]]

    return run


def unique_lead_count(kept: DataFrame, scope: str = "job_id", name: str = "name", city: str = "city") -> DataFrame:
    """Distinct name and city keys per job, over the output of :func:`dedup_leads`."""
    return kept.groupBy(scope).agg(
        F.count_distinct(norm_text(F.col(name)), norm_text(F.col(city))).alias("unique_leads")
    )
