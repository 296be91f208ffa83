"""When scrolling a result list stops, and whether it was exhausted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scrolls without growth before giving up; bounds on the number of scrolls.
STUCK_SCROLLS = 3
MIN_SCROLLS = 5


def feed_saturation(scrolls: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, stop_scroll, stop_reason, pushed, exhausted) from a scroll log.

    ``scrolls`` has (job_id, scroll_no from 1, link_count, pushed); ``jobs`` has
    (job_id, mode, max_results). The stop is the earliest of: enough places (``pushed``
    when pipelined, ``link_count`` when sequential), the third scroll in a row without
    more links, or the scroll limit. Later scrolls are cut off first, already in the scan,
    so a job's window never exceeds the largest scroll limit.
    """
    limit = F.greatest(F.lit(MIN_SCROLLS), F.floor(F.col("max_results") / 5).cast("int") + 4)
    largest = jobs.agg(F.max(limit)).first()[0] or MIN_SCROLLS
    seen = scrolls.where(F.col("scroll_no") <= F.lit(largest)).join(jobs.select("job_id", "mode", "max_results"), "job_id").withColumn("_limit", limit)
    seen = seen.where(F.col("scroll_no") <= F.col("_limit"))

    in_order = W.partitionBy("job_id").orderBy("scroll_no")
    still = (F.col("link_count") == F.coalesce(F.lag("link_count").over(in_order), F.lit(0))).cast("int")
    recent = in_order.rowsBetween(1 - STUCK_SCROLLS, 0)
    enough = F.when(F.col("mode") == "sequential", F.col("link_count")).otherwise(F.col("pushed"))
    judged = seen.withColumn("_still", still).withColumn(
        "_reason",
        F.when(enough >= F.col("max_results"), "enough")
        .when(F.sum("_still").over(recent) >= STUCK_SCROLLS, "no_growth")
        .when(F.col("scroll_no") == F.col("_limit"), "scroll_limit"),
    )
    last = F.max(F.struct("scroll_no", "pushed", "max_results")).alias("_last")
    stop = F.min(F.when(F.col("_reason").isNotNull(), F.struct("scroll_no", "_reason", "pushed", "max_results")))
    found = judged.groupBy("job_id").agg(stop.alias("_stop"), last)
    pushed = F.coalesce(F.col("_stop.pushed"), F.col("_last.pushed"))
    return found.select(
        "job_id",
        F.coalesce(F.col("_stop.scroll_no"), F.col("_last.scroll_no")).alias("stop_scroll"),
        F.coalesce(F.col("_stop._reason"), F.lit("log_end")).alias("stop_reason"),
        pushed.alias("pushed"),
        (F.coalesce(F.col("_stop._reason") == "no_growth", F.lit(False)) & (pushed < F.col("_last.max_results"))).alias(
            "exhausted"
        ),
    )
