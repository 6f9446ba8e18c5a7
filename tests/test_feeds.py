"""Raw feeds from driver tables whose orders all lie in one source, or that have none."""

import datetime as dt
from pathlib import Path

import pytest

from checks import star
from checks.queries import all_queries
from tillroll.plans.staging import remove, shared_folder

NATION = ([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int")
CUSTOMER = ([(1, 0)], "c_custkey bigint, c_nationkey int")
PART = ([(1, "red box", "ECONOMY", 9)], "p_partkey bigint, p_name string, p_type string, p_size int")
LINES = (
    [(k, 1, n, 3.0, 2.5 * n, "N", "O") for k in (1, 2) for n in (1, 2)],
    "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_linestatus string",
)
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string"
)


def write_tables(spark, folder, days):
    orders = [(k, 1, "O", day, "1-URGENT") for k, day in enumerate(days, 1)]
    tables = {
        "nation": NATION, "customer": CUSTOMER, "part": PART, "lineitem": LINES,
        "orders": (orders, ORDERS),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "days, sources",
    [
        ([dt.datetime(1999, 1, 5), dt.datetime(1999, 2, 5)], {"second": 4}),
        ([dt.datetime(1997, 1, 5), dt.datetime(1997, 2, 5)], {"first": 4}),
        ([], {}),
    ],
)
def test_a_source_may_have_no_lines(spark, tmp_path, days, sources):
    folder, queries = write_tables(spark, tmp_path, days), all_queries()
    found = queries["ingest_union"](spark, folder).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == sources
    lines = sum(sources.values())
    for name in ("all_lines", "clean_fact_appended", "normalize_types_csv"):
        assert queries[name](spark, folder).count() == lines
    assert queries["change_log_appended"](spark, folder).count() == 9 + len(sources)


DAYS = [dt.datetime(1997, 1, 5), dt.datetime(1999, 2, 5)]


@pytest.mark.parametrize("lost", ["*", "feeds-*/src_ord=0"])
def test_queries_run_again_after_staged_tables_are_gone(spark, tmp_path, lost):
    folder, queries = write_tables(spark, tmp_path, DAYS), all_queries()
    shared = Path(shared_folder(spark))
    others = set(shared.glob("*"))

    def lines(name):
        return sorted(map(tuple, queries[name](spark, folder).collect()), key=repr)

    names = ("all_lines", "code_type_profile", "clean_fact_appended")
    before = {name: lines(name) for name in names}
    for name in names:
        for path in shared.glob(lost):
            if not others & {path, *path.parents}:
                remove(spark, str(path))
        assert lines(name) == before[name]
    assert len(before["clean_fact_appended"]) == len(before["all_lines"]) == 4


def test_feeds_that_are_not_whole_are_refused(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "feed"))
    found = spark.read.parquet(str(tmp_path / "feed"))
    star.check_whole(found, 5, "feed")
    with pytest.raises(RuntimeError, match="6 lines written, 5 found"):
        star.check_whole(found, 6, "feed")
