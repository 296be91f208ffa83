"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension.

Native: DataFrame operations only.

Every text gets a point: size, character count, language, source and id. A node is split
along the dimension in which its points spread most, at the median weighted by bytes,
until there are as many leaves as shards. Medians come from exact running totals over
range partitions (:mod:`leadlake.operators.ordered`), so neither a node nor a tie ever
meets in one task.

Equal texts share one point, that of their smallest id, and move as one unit unless they
outweigh 1/256 of a shard; then their rows are units that lie side by side in every order,
so a cut parts them at most once.

Defined cases: a null text has size 1 and the checksum of the empty text. Null metadata sorts
first. Rows repeated in full are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import text_or_empty
from leadlake.operators.ordered import Rank, Total, with_ordered
from leadlake.session import materialize

# A unit of equal texts may weigh this part of a shard at most.
UNIT_PART = 256
TEXT_KEY = ("size", "text_crc32", "text_hash")


def leading_bytes(column: str) -> Column:
    """The first six bytes of a string as a number, in byte order; -1 for null."""
    digits = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(-1.0))


def point(docs: DataFrame, dimensions: Sequence[str]) -> list[Column]:
    """One double per metadata column, named d0, d1, ..."""
    kinds = dict(docs.dtypes)
    return [
        (leading_bytes(c) if kinds[c] == "string" else F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).alias(f"d{i}")
        for i, c in enumerate(dimensions)
    ]


def kd_shards(
    docs: DataFrame, shards: int = 8, dimensions: Sequence[str] = ("n_chars", "lang", "source", "doc_id"), doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, leaf_path) for every row of ``docs``.

    Sizes are UTF-8 bytes plus 1 and nearly equal over the shards. ``slot`` counts the rows of a
    shard from 0 by id. ``leaf_path`` names the dimensions and sides on the way to the leaf.
    """
    dims = ["size", *[c for c in dimensions if c in docs.columns]]
    body = text_or_empty(text)
    size = F.octet_length(body).cast("long") + 1
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(body, F.reverse(body)).alias("text_hash"), F.struct(F.log2(size).alias("d0"), *[
            c.alias(f"d{i + 1}") for i, c in enumerate(point(docs, dims[1:]))
        ]).alias("point"),
    ), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    same_text = [F.col(f"rows.{c}") == F.col(f"texts.{c}") for c in TEXT_KEY]
    texts = rows.groupBy(*TEXT_KEY).agg(F.min_by("point", F.struct("doc_id")).alias("shared"), F.sum("size").alias("text_bytes"))
    placed = materialize(rows.alias("rows").join(texts.alias("texts"), same_text).select(
        "doc_id", *[f"rows.{c}" for c in TEXT_KEY], F.col("shared.*"), (F.col("text_bytes") * UNIT_PART * shards <= total).alias("together")
    ), "shard-points")

    columns = [f"d{i}" for i in range(len(dims))]
    light = placed.where("together").groupBy(*TEXT_KEY, *columns).agg(F.sum("size").alias("weight"), F.min("doc_id").alias("doc_id"))
    heavy = placed.where(~F.col("together")).withColumn("weight", F.col("size"))
    units = light.withColumn("together", F.lit(True)).unionByName(heavy)
    leaves = split(units, columns, dims, shards)

    whole = leaves.where("together").select(*TEXT_KEY, "shard", "leaf_path")
    joined = placed.where("together").alias("rows").join(whole.alias("texts"), same_text)
    output = ["doc_id", "size", "text_crc32", "text_hash", "shard", "leaf_path"]
    sharded = joined.select("doc_id", *[f"rows.{c}" for c in TEXT_KEY], "shard", "leaf_path").unionByName(
        leaves.where(~F.col("together")).select(*output))
    ranked = with_ordered(sharded, ["shard"], ["doc_id", "text_hash"], {"slot": Rank()})
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"), "leaf_path")


def split(units: DataFrame, columns: Sequence[str], names: Sequence[str], shards: int) -> DataFrame:
    """Give each unit its ``shard``. A node covers shards first..last-1; both halves get their part of its weight."""
    ranges = units.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    bounds = ranges.first()
    node = units.withColumns({"first": F.lit(0), "last": F.lit(shards), "leaf_path": F.lit("")})
    for _ in range((shards - 1).bit_length()):
        # One row per node, so at most as many rows as there are shards.
        spreads = [
            F.struct(
                (F.coalesce(F.stddev_pop(c), F.lit(0.0)) / F.lit(max((bounds[f"max_{c}"] or 0) - (bounds[f"min_{c}"] or 0), 1e-9))).alias("width"),
                F.lit(i).alias("dimension"), F.lit(name).alias("name"),
            )
            for i, (c, name) in enumerate(zip(columns, names))
        ]
        widest = node.groupBy("first").agg(F.greatest(*spreads).alias("widest"), F.sum("weight").alias("node_weight")) if len(spreads) > 1 else (
            node.groupBy("first").agg(spreads[0].alias("widest"), F.sum("weight").alias("node_weight")))
        along = F.coalesce(*[F.when(F.col("widest.dimension") == i, F.col(c)) for i, c in enumerate(columns)])
        keyed = node.join(F.broadcast(widest), "first").withColumn("along", along)
        summed = with_ordered(keyed, ["first"], ["along", *TEXT_KEY, "doc_id"], {"before": Total(F.col("weight"))})
        leaves = F.col("last") - F.col("first")
        left = F.floor(leaves / 2)
        is_left = (F.col("before") + F.col("weight") / 2) * leaves <= F.col("node_weight") * left
        middle = (F.col("first") + left).cast("int")
        step = F.concat("leaf_path", F.col("widest.name"), F.when(is_left, "<").otherwise(">"))
        cut = leaves > 1
        node = summed.select(
            *units.columns,
            F.when(cut & ~is_left, middle).otherwise(F.col("first")).alias("first"),
            F.when(cut & is_left, middle).otherwise(F.col("last")).alias("last"),
            F.when(cut, step).otherwise(F.col("leaf_path")).alias("leaf_path"),
        )
    return materialize(node.withColumnRenamed("first", "shard"), "shard-leaves")
