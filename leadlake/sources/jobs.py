"""Search jobs from files, streams and message envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.text import present
from leadlake.schemas import SEARCH_JOB_RECORD

# Defaults of a job.
DEFAULT_COUNTRY = "BR"
DEFAULT_MAX_RESULTS = 20


def _limit(value: Column) -> Column:
    number = value.try_cast("int")
    return F.when(number != 0, number).otherwise(DEFAULT_MAX_RESULTS)


def search_jobs(records: DataFrame) -> DataFrame:
    """Job records with defaults; records without a job id are dropped."""
    return records.where(present(F.col("job_id"))).select(
        "job_id",
        "search_id",
        F.coalesce("keyword", F.lit("")).alias("keyword"),
        F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("country", F.lit(DEFAULT_COUNTRY)).alias("country"),
        _limit(F.col("max_results")).alias("max_results"),
    )


def read_search_jobs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON job files of a folder, as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return search_jobs(reader.schema(SEARCH_JOB_RECORD).json(path))


def route_job_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """Jobs carried by message texts of type "job"; broken texts and other types yield nothing."""
    envelope = f"type string, payload struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in SEARCH_JOB_RECORD)}>"
    parsed = messages.withColumn("_m", F.from_json(column, envelope, {"mode": "PERMISSIVE"}))
    routed = parsed.where((F.col("_m.type") == "job") & F.col("_m.payload").isNotNull())
    return search_jobs(routed.select("_m.payload.*"))
