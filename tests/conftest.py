import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(autouse=True)
def interpreted(request):
    """Many tiny plans run faster interpreted; queries and plans are tested as compiled."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    module = request.module.__name__
    if "spark" not in request.fixturenames or module in ("test_queries", "test_plans"):
        yield
        return
    spark = request.getfixturevalue("spark")
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def staging(spark):
    from tideview.sources.storage import Staging

    with Staging(spark) as s:
        yield s


def bag(df):
    """Rows as a sorted list, for small results."""
    return sorted(map(repr, map(tuple, df.collect())))


def assert_same_bag(actual, expected):
    """Compare as bags with Spark's own EXCEPT ALL, both ways."""
    expected = expected.select(*[f"`{c}`" for c in actual.columns])
    missing = expected.exceptAll(actual).withColumn("problem", F.lit("missing"))
    stale = actual.exceptAll(expected).withColumn("problem", F.lit("stale"))
    wrong = missing.unionByName(stale).take(10)
    assert not wrong, wrong
