import pyarrow as pa

from leadlake import session
from leadlake.session import tune

SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_tasks_are_bounded_where_the_session_leaves_the_default(spark):
    spark.conf.unset(SIZE)
    tune(spark)
    assert spark.conf.get(SIZE) == "16m"


def test_a_size_chosen_by_the_session_stays(spark):
    spark.conf.set(SIZE, "5m")
    try:
        tune(spark)
        assert spark.conf.get(SIZE) == "5m"
    finally:
        spark.conf.unset(SIZE)
        tune(spark)


def test_rows_go_to_python_in_batches_bounded_by_bytes(spark):
    tune(spark)
    wide = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 8000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    found = [r.size for r in wide.mapInArrow(sizes, "size long").collect()]
    # One row may go beyond the bound.
    assert sum(found) >= 4000 * 8000 and max(found) < 9 << 20


def test_a_large_table_is_spread_over_more_partitions_than_cores(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    assert session.spread(spark.range(1000)).rdd.getNumPartitions() == 10
    assert session.spread(spark.range(100)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
