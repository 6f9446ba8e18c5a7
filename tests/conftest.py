import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from retail_rows import (  # noqa: E402
    FACT_LINES,
    FIRST_HEADERS,
    NORTH,
    SECOND_HEADERS,
    SOUTH,
    build_fact,
    numbered,
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_sources(spark):
    return [
        ("north", spark.createDataFrame(numbered(NORTH), FIRST_HEADERS)),
        ("south", spark.createDataFrame(numbered(SOUTH), SECOND_HEADERS)),
    ]


@pytest.fixture(scope="session")
def fact(spark):
    return build_fact(spark, FACT_LINES)


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session under a cluster's name; its folder is a path, as that of a mount is."""
    from tillroll.plans import staging

    monkeypatch.setattr(staging, "_TRIED", set())
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark
