"""Jobs of a lead stream share groups; each is decided and forgotten on its own."""

import json

import pandas as pd
from pyspark.sql.group import GroupedData

from leadlake.streaming import state as states
from leadlake.streaming.leads import stream_leads

SCHEMA = "job_id string, n bigint, url string, max_results int, accepted boolean, name string, city string, phone string, lead string"


class Kept:
    """What Spark hands to the rule of a group."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.now, self.value, self.timeout = False, False, 0, None, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value

    def remove(self):
        self.exists, self.value = False, None

    def setTimeoutDuration(self, ms):
        assert ms > 0
        self.timeout = self.now + ms


def rule(spark, monkeypatch, forget_after_s):
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, decide, *rest: decide)
    return states.first_leads(spark.createDataFrame([], SCHEMA), forget_after_s)


def visits(*rows):
    texts = [json.dumps({"job": job, "url": f"u{n}", "max_results": 2, "accepted": True, "name": name, "city": "c"}) for job, n, name in rows]
    return iter([pd.DataFrame({"job_id": [r[0] for r in rows], "n": [r[1] for r in rows], "_visit": texts, "lead": [r[2] for r in rows]})])


def leads(frames):
    return [tuple(row) for frame in frames for row in frame.itertuples(index=False)]


def test_jobs_of_one_group_are_decided_apart(spark, monkeypatch):
    decide, kept = rule(spark, monkeypatch, None), Kept()
    first = leads(decide((0,), visits(("b", 4, "x"), ("a", 2, "x"), ("a", 1, "x"), ("b", 3, "y")), kept))
    assert sorted(first) == [("a", 1, "x"), ("b", 3, "y"), ("b", 4, "x")]
    # Both limits are used up; a third job is new.
    assert leads(decide((0,), visits(("a", 5, "z"), ("c", 6, "x"), ("b", 7, "z")), kept)) == [("c", 6, "x")]


def test_silent_jobs_of_a_group_are_forgotten_one_by_one(spark, monkeypatch):
    decide, kept = rule(spark, monkeypatch, 10), Kept()
    list(decide((0,), visits(("a", 1, "x")), kept))
    kept.now = 4000
    list(decide((0,), visits(("b", 2, "x")), kept))
    assert kept.timeout == 10_000
    kept.now, kept.hasTimedOut = 10_000, True
    assert leads(decide((0,), iter([]), kept)) == [] and kept.exists and kept.timeout == 14_000
    kept.now, kept.hasTimedOut = 11_000, False
    assert leads(decide((0,), visits(("a", 8, "x"), ("b", 9, "x")), kept)) == [("a", 8, "x")]
    kept.now, kept.hasTimedOut = 30_000, True
    assert leads(decide((0,), iter([]), kept)) == [] and not kept.exists


def test_groups_do_not_grow_with_the_jobs(spark, monkeypatch):
    found = spark.range(3000).selectExpr(
        "cast(id as string) job_id", "id n", "'u' url", "1 max_results", "true accepted", "'a' name", "'c' city", "'1' phone", "'l' lead")
    monkeypatch.setattr(states, "JOB_BUCKETS", 8)
    groups = []
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, *rest: groups.append(self.count()))
    states.first_leads(found)
    assert groups[0].count() == 8


def test_few_partitions_of_places_are_dealt_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("leadlake.streaming.leads.with_jobs", lambda places, jobs: seen.append(places.rdd.getNumPartitions()) or places)
    monkeypatch.setattr("leadlake.streaming.leads.judged_visits", lambda places: places)
    monkeypatch.setattr("leadlake.streaming.leads.leads_of", lambda visits, forget: visits)
    monkeypatch.setattr("leadlake.streaming.leads.start", lambda *rest: None)
    stream_leads(spark.range(9).coalesce(1), spark.range(1), "unused")
    assert seen == [spark.sparkContext.defaultParallelism]
