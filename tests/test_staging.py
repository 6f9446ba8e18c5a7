"""Where staged tables go."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tillroll.plans.staging import shared_folder, stage

REPO = str(Path(__file__).resolve().parents[1])


class FakeContext:
    applicationId = "app-1"

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, setting=None, folder=None):
    conf = SimpleNamespace(get=lambda key, default: setting or default)
    return SimpleNamespace(conf=conf, sparkContext=FakeContext(master, folder))


def test_the_named_folder_is_used():
    assert shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared/tillroll-app-1"
    assert shared_folder(session("yarn", None, "hdfs:///own")) == "hdfs:///own/tillroll-app-1"


@pytest.mark.parametrize("master", ["spark://host:7077", "local[2]"])
def test_a_run_without_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(master))


@pytest.mark.parametrize("folder", ["file:///tmp/x", "/tmp/x"])
def test_a_folder_of_one_machine_is_refused_on_a_cluster(folder):
    with pytest.raises(RuntimeError, match="one machine"):
        shared_folder(session("spark://host:7077", folder))
    assert shared_folder(session("local[2]", folder)).startswith(folder)


def test_a_staged_table_keeps_schema_and_cuts_lineage(spark):
    df = spark.range(10).selectExpr("id", "cast(id as decimal(18,2)) AS money")
    staged = stage(df, "t")
    assert staged.schema.simpleString() == df.schema.simpleString()
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    assert staged.count() == 10


def test_what_passes_is_removed(spark):
    from pathlib import Path

    from tillroll.plans.staging import passing, shared_folder

    def there():
        return {p.name.rsplit("-", 1)[0] for p in Path(shared_folder(spark)).iterdir()}

    stage(spark.range(3), "stays-here")
    with passing(spark):
        first = stage(spark.range(3), "outer-table")
        with passing(spark):
            stage(spark.range(3), "inner-table")
            assert {"inner-table", "outer-table"} <= there()
        assert "inner-table" not in there() and first.count() == 3
    assert "outer-table" not in there() and "stays-here" in there()


def test_an_append_leaves_no_staged_table(spark, tmp_path):
    from pathlib import Path

    from retail_rows import FIRST_HEADERS, NORTH, numbered

    from tillroll.plans.staging import shared_folder
    from tillroll.sources.store import FactStore

    folder = Path(shared_folder(spark))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    store = FactStore(spark, str(tmp_path))
    store.append("north", spark.createDataFrame(numbered(NORTH), FIRST_HEADERS))
    assert {p.name for p in folder.iterdir()} == before
    assert store.fact().count() > 0 and store.change_log().count() > 0


@pytest.mark.parametrize("entry", ["checks.folder.ensure_folder", "tillroll.llm.common.prepare"])
def test_a_session_without_folder_gets_one(tmp_path, entry):
    module, name = entry.rsplit(".", 1)
    code = f"""
from pyspark.sql import SparkSession
from tillroll.plans.staging import named_folder, stage
from {module} import {name}
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not named_folder(spark)
{name}(spark)
assert stage(spark.range(3), "t").count() == 3
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "PYTHONPATH": REPO}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def one_file_lost(monkeypatch):
    """From now on a file of each table ends on a disk that the driver does not see."""
    from pyspark.sql import DataFrameWriter

    def losing(writer, path, write=DataFrameWriter.parquet):
        write(writer, path)
        next(Path(path).glob("part-*")).unlink()

    monkeypatch.setattr(DataFrameWriter, "parquet", losing)


def test_a_folder_that_a_cluster_shares_is_taken(cluster):
    from tillroll.plans.staging import clear_staged

    assert stage(cluster.range(10), "t").count() == 10
    assert stage(cluster.range(0), "t").count() == 0
    folder = Path(shared_folder(cluster))
    assert not list(folder.glob("trial-*"))
    clear_staged(cluster)
    assert not folder.exists()


def test_a_folder_that_loses_an_executors_files_is_refused(cluster, monkeypatch):
    one_file_lost(monkeypatch)
    with pytest.raises(RuntimeError, match="one machine"):
        stage(cluster.range(10), "t")


def test_a_table_that_is_not_whole_is_refused_on_a_cluster(cluster, monkeypatch):
    stage(cluster.range(10), "t")
    one_file_lost(monkeypatch)
    with pytest.raises(RuntimeError, match="10 lines written, [0-9] found"):
        stage(cluster.range(10), "t")


@pytest.mark.parametrize("name", ["all_lines", "clean_fact_appended", "country_audit", "cohort_pivot"])
def test_retail_queries_run_in_a_folder_that_a_cluster_shares(cluster, tmp_path, name):
    from test_feeds import DAYS, write_tables

    from checks.queries import all_queries

    rows = all_queries()[name](cluster, write_tables(cluster, tmp_path, DAYS)).count()
    assert rows == {"all_lines": 4, "clean_fact_appended": 4, "country_audit": 1, "cohort_pivot": 1}[name]
