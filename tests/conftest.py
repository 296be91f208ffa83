import pytest

from leadlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over rows of a small table."""
    def evaluate(build, rows, schema):
        table = spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else
                                      [(i, *row) for i, row in enumerate(rows)], f"_i int, {schema}")
        return [r[0] for r in table.select(build().alias("v"), "_i").orderBy("_i").select("v").collect()]

    return evaluate
