"""Shared pieces: word classes, table access, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.session import materialize

# Words are runs of anything but ASCII white space.
SPACE_CHAR = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """(row, document), written: ``row`` tells the rows of ``docs`` apart whatever their ids are, and ``document`` holds a row whole,
    so that no column name can clash."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document")), label)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(buckets))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
