from pyspark.sql import functions as F

from leadlake.operators import metrics
from leadlake.operators.saturation import feed_saturation
from leadlake.schemas import JOB_EVENT


def event(ts, kind, count=1, ms=0, **extra):
    return ("j", ts, kind, count, ms, extra.get("emails"), extra.get("socials"), extra.get("technologies"), extra.get("cache_hit"))


def test_counters_rates_and_report(spark):
    rows = [event(0, "scraped", 3), event(30_000_000, "sent", 10), event(40_000_000, "cache_hit"), event(50_000_000, "batch", 5, 101),
            event(51_000_000, "batch", 5, 100), event(52_000_000, "nav", 1, 3), event(53_000_000, "nav", 1, 2), event(54_000_000, "phase1", 1, 70),
            event(55_000_000, "phase1", 1, 60), event(60_000_000, "enriched", 1, 9, emails=2, socials=1, technologies=4, cache_hit=True)]
    events = spark.createDataFrame(rows, JOB_EVENT)
    counted = metrics.job_metrics(events)
    m = counted.first().asDict()
    assert (m["leads_scraped"], m["leads_sent"], m["cache_hits"], m["batches_sent"], m["total_batch_ms"], m["phase1_ms"], m["navs"]) == (3, 10, 1, 2, 201, 60, 2)
    rated = metrics.job_rates(counted)
    r = rated.first()
    assert (r.elapsed_s, r.leads_per_min, r.cache_hit_rate, r.avg_batch_ms, r.avg_nav_ms) == (60.0, 10.0, 25.0, 100.5, 2.0)
    e = metrics.enrichment_metrics(events).first()
    assert (e.leads_enriched, e.emails_found, e.enrich_cache_hits, e.enrich_cache_misses, e.total_enrich_ms) == (1, 2, 1, 0, 9)
    reports = spark.createDataFrame([("j", 60_000_000, 10, 0), ("j", 90_000_000, 14, 0), ("j", 90_000_001, 14, 0)], "job_id string, ts_us bigint, leads_sent bigint, started_us bigint")
    assert [round(x.instant_lpm, 6) for x in metrics.instant_rate(reports).orderBy("ts_us").collect()] == [10.0, 8.0, 0.0]
    from pyspark.sql import functions as F

    full = rated.join(metrics.enrichment_metrics(events), "job_id").withColumn("instant_lpm", F.lit(8.0))
    assert metrics.metrics_report(full).first().report == (
        "metrics [progress] job=j scraped=3 sent=10 new=0 deduped=0 cache_hits=1 cache_hit_rate=25% errors=0 retries=0 batches=2 avg_batch_ms=100 "
        "phase1_ms=60 phase2_ms=0 avg_nav_ms=2 navs=2 enriched=1 emails=2 socials=1 technologies=4 enrich_cache_hits=1 enrich_cache_misses=0 "
        "elapsed=60.0s leads_per_min=10.0 instant_lpm=8.0")


def test_rates_without_anything(spark):
    r = metrics.job_rates(metrics.job_metrics(spark.createDataFrame([event(5, "error")], JOB_EVENT))).first()
    assert (r.elapsed_s, r.leads_per_min, r.cache_hit_rate, r.avg_batch_ms, r.avg_nav_ms) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_saturation_and_exhaustion(spark):
    jobs = spark.createDataFrame(
        [("grow", "pipelined", 4), ("stuck", "pipelined", 20), ("limit", "pipelined", 5), ("seq", "sequential", 4), ("none", "pipelined", 5), ("snone", "sequential", 5)],
        "job_id string, mode string, max_results int")
    logs = {"grow": [(2, 2), (5, 4), (9, 4)], "stuck": [(3, 3), (3, 3), (4, 4), (4, 4), (4, 4), (4, 4), (9, 9)], "limit": [(1, 1), (2, 2), (2, 2), (3, 3), (3, 3), (9, 9)], "seq": [(2, 1), (4, 2)]}
    scrolls = spark.createDataFrame([(j, i + 1, a, b) for j, log in logs.items() for i, (a, b) in enumerate(log)], "job_id string, scroll_no int, link_count bigint, pushed bigint")
    stops = feed_saturation(scrolls, jobs)
    assert {tuple(r) for r in stops.collect()} == {
        ("grow", 2, "enough", 4, False), ("stuck", 6, "no_growth", 4, True), ("limit", 5, "scroll_limit", 3, False), ("seq", 2, "enough", 2, False)}
    from pyspark.sql import functions as F

    found = stops.select("job_id", F.col("pushed").alias("places"), (F.col("stop_reason") == "no_growth").alias("stopped_without_growth"), F.lit(False).alias("direct_match"))
    assert {(r.job_id, r.region_exhausted) for r in metrics.region_exhausted(jobs, found).collect()} == {
        ("grow", False), ("stuck", True), ("limit", False), ("seq", True), ("none", False), ("snone", True)}


def test_liveness(spark):
    beats = spark.createDataFrame([("a", 100_000_000, 1.0), ("a", 50_000_000, 2.0), ("b", 60_000_000, 3.0), ("c", 0, 4.0)], "worker_id string, ts_us bigint, cpu_usage double")
    assert {(r.worker_id, r.cpu_usage, r.state) for r in metrics.worker_liveness(beats, 110_000_000).collect()} == {("a", 1.0, "online"), ("b", 3.0, "late"), ("c", 4.0, "offline")}


def test_report_rounds_the_hit_rate_once(spark):
    from leadlake.operators import metrics

    counters = spark.createDataFrame([("j", 0, "lead", 1, 0, 0, 0, 0, False)], "job_id string, ts_us bigint, kind string, count bigint, elapsed_ms bigint, emails int, socials int, technologies int, cache_hit boolean")
    row = counters.groupBy("job_id").agg(*metrics.job_counters(), *metrics.enrichment_counters())
    full = metrics.job_rates(row.withColumns({"cache_hits": F.lit(1346).cast("bigint"), "leads_scraped": F.lit(8654).cast("bigint")}))
    line = metrics.metrics_report(full.withColumn("instant_lpm", F.lit(0.0)), final=True).first().report
    assert "cache_hit_rate=13%" in line
