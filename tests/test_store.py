"""A fact grown source by source against one run over all; lookups; versions."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from retail_rows import FIRST_HEADERS, NORTH, SECOND_HEADERS, SOUTH, numbered

from tillroll.operators import clean
from tillroll.operators.clean import Cleaning
from tillroll.rules import Rules
from tillroll.sources import feed, versions
from tillroll.sources.store import FactStore

NAMES = ["OAK SHELF", "SHELF, OAK", "BRASS HOOK", "lost in store", None, None, " "]


def feed_of(seed, months, n=160):
    """Lines of a few months: repeats, missing texts, test codes, absent moments."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.2:
            rows.append(rng.choice(rows))
            continue
        moment = f"2012-{rng.choice(months):02d}-{rng.randint(1, 9):02d} 10:0{rng.randint(0, 2)}"
        rows.append((
            f"{rng.choice(['', '', 'C'])}{rng.randint(1, 12)}",
            rng.choice(["A1", "B2", "c3", "TEST001", "POST"]), rng.choice(NAMES),
            rng.choice([1, 2, -3, 30000]), moment if rng.random() < 0.95 else None,
            rng.choice([1.0, 2.5]), rng.choice([7.0, None]), rng.choice(["EIRE", " France "]),
        ))
    return rows


SOURCES = {
    "one": feed_of(1, [1, 2, 3, 7]),
    # the same lines again and new ones; other names become usual for codes of older months
    "two": feed_of(1, [1, 2, 3, 7])[:60] + feed_of(2, [3, 4]),
    "three": [],
    "four": feed_of(3, [5], 300),
}


def frames(spark):
    return [(n, spark.createDataFrame(numbered(rows), FIRST_HEADERS)) for n, rows in SOURCES.items()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_one_run(spark, store, sources, countries=None):
    whole = Cleaning(feed.ingest(sources), Rules(), countries)
    assert rows_of(store.fact()) == rows_of(whole.fact)
    # a source without lines leaves no line in either log
    assert rows_of(store.change_log()) == rows_of(whole.change_log())


def files(folder):
    return {(p.parent.name, p.name) for p in Path(folder, "fact").rglob("part-*.parquet")}


def test_every_append_equals_one_run(spark, tmp_path):
    store, sources = FactStore(spark, str(tmp_path)), frames(spark)
    for i, (name, source) in enumerate(sources):
        before = files(tmp_path)
        touched = store.append(name, source)
        same_as_one_run(spark, store, sources[: i + 1])
        folders = {
            f"month_start={m.isoformat() if m else '__HIVE_DEFAULT_PARTITION__'}" for m in touched
        }
        after = files(tmp_path)
        for month, file in before:  # rewritten months have new files, others the old ones
            assert ((month, file) in after) == (month not in folders), (name, month)
        assert {month for month, _ in after - before} == folders
    assert store.runs() == len(sources)


def test_appending_the_same_source_again_changes_nothing(spark, tmp_path):
    store, (first, *_) = FactStore(spark, str(tmp_path)), frames(spark)
    store.append(*first)
    lines, names = rows_of(store.fact()), files(tmp_path)
    assert store.append("again", first[1]) == []
    assert rows_of(store.fact()) == lines and files(tmp_path) == names


def test_a_later_source_renames_lines_of_an_older_month(spark, tmp_path):
    line = ("1", "A1", None, 1, "2012-01-05 10:00", 1.0, 7.0, "France")
    early = [line, ("2", "A1", "SHELF", 1, "2012-02-05 10:00", 1.0, 7.0, "France")]
    late = [(str(i), "A1", "OAK SHELF", 1, "2012-04-05 10:00", 1.0, 7.0, "France") for i in (3, 4)]
    store = FactStore(spark, str(tmp_path))
    store.append("early", spark.createDataFrame(numbered(early), FIRST_HEADERS))
    assert store.fact().filter("invoice_no = '1'").first().description == "SHELF"
    touched = store.append("late", spark.createDataFrame(numbered(late), FIRST_HEADERS))
    assert sorted(touched) == [dt.date(2012, 1, 1), dt.date(2012, 4, 1)]
    assert store.fact().filter("invoice_no = '1'").first().description == "OAK SHELF"


@pytest.mark.parametrize("dies_at", ["names", "fact", "log"])
def test_a_run_that_died_is_done_again(spark, tmp_path, monkeypatch, dies_at):
    store, sources = FactStore(spark, str(tmp_path)), frames(spark)
    store.append(*sources[0])
    lines = rows_of(store.fact())
    write, rewrite = FactStore._write, FactStore._rewrite

    def broken(self, df, name, run):
        if name == dies_at:
            raise OSError("gone")
        write(self, df, name, run)

    def half(self, *args):
        if dies_at == "fact":
            raise OSError("gone")
        rewrite(self, *args)

    monkeypatch.setattr(FactStore, "_write", broken)
    monkeypatch.setattr(FactStore, "_rewrite", half)
    with pytest.raises(OSError):
        store.append(*sources[1])
    monkeypatch.undo()
    if dies_at != "log":  # the fact itself had not been touched
        assert rows_of(store.fact()) == lines
    store.append(*sources[1])
    same_as_one_run(spark, store, sources[:2])


def test_only_months_of_the_new_lines_are_read_for_keys(spark, tmp_path):
    store, sources = FactStore(spark, str(tmp_path)), frames(spark)
    store.append(*sources[0])
    typed = clean.normalize_types(feed.ingest([sources[3]]), Rules()).drop("source")
    fresh = clean.derive_measures(typed).filter("invoice_date IS NOT NULL")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = store._unseen(fresh, 1)._jdf.queryExecution().explainString(mode)
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("month_start" in line and "2012-05-01" in line for line in pruned)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_a_lookup_table_in_the_store(spark, tmp_path):
    table = spark.createDataFrame([("EIRE", "Ireland"), (" France", "FR")], "spelling string, country string")
    lookup = clean.country_lookup(table, "spelling", "country")
    store = FactStore(spark, str(tmp_path), countries=lookup)
    sources = frames(spark)[:2]
    for source in sources:
        store.append(*source)
    same_as_one_run(spark, store, sources, lookup)


# ---------------------------------------------------------------- cleaning in fewer passes
def test_the_log_reads_no_staged_lines_again(spark, raw_sources):
    cleaning = Cleaning(feed.ingest(raw_sources), Rules())
    log = cleaning.change_log()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = log._jdf.queryExecution().explainString(mode)
    scans = [x for x in plan.split("\n\n") if "Location" in x and "unique-lines" in x]
    assert len(scans) == 1 and "IsNull(description)" in scans[0]  # nameless lines only
    counted = cleaning._counted[1]
    lines = cleaning.unique
    for name, count in clean.line_counts(Rules()).items():
        assert counted[name] == lines.agg(count).first()[0], name


# ---------------------------------------------------------------- lookups
def test_a_lookup_of_a_million_rows(spark):
    rules = Rules(country_map={"EIRE": "Ireland", "N": "Norway"})
    lines = spark.createDataFrame([(i, c) for i, c in enumerate(["EIRE", "N", None, "X"] * 50)], "id int, country string")
    chain = rows_of(clean.map_country(lines, rules))
    small = spark.createDataFrame(list(rules.country_map.items()), "s string, c string")
    large = small.union(
        spark.range(1_000_000).select(F.concat(F.lit("old "), "id"), F.concat(F.lit("new "), "id"))
    )
    for table in (small, large):
        lookup = clean.country_lookup(table, "s", "c")
        found = clean.map_country(lines, rules, lookup)
        assert rows_of(found) == chain
        plan = found._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "_salt" not in plan
    found = clean.map_values(lines, "country", clean.country_lookup(small, "s", "c"), broadcast_bytes=-1)
    assert rows_of(found) == chain
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_salt" in plan


def test_a_lookup_names_each_spelling_once(spark):
    table = spark.createDataFrame([(" a  b", "2"), ("a b", "1"), ("", "3"), (None, "4"), ("c", None)], "s string, c string")
    lookup = clean.country_lookup(table, "s", "c")
    assert rows_of(lookup) == [("a b", "1"), ("c", None)]
    lines = spark.createDataFrame([("a b",), ("c",), ("d",), (None,)], "country string")
    assert rows_of(clean.map_values(lines, "country", lookup)) == [("1",), ("d",), (None,), (None,)]


# ---------------------------------------------------------------- versions
def test_readers_see_the_last_complete_version(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        versions.current(spark, folder)
    for n in (1, 2, 3):
        path = versions.begin(spark, folder)
        spark.range(n).write.parquet(f"{path}/x")
        if n == 2:  # this writer dies
            continue
        versions.commit(spark, path)
        assert spark.read.parquet(f"{versions.current(spark, folder)}/x").count() == n
    dead = versions.begin(spark, folder)
    spark.range(9).write.parquet(f"{dead}/x")
    assert versions.current(spark, folder).endswith("v000003")
    assert [p[-1] for p in versions.prune(spark, folder, keep=1)] == ["1", "2"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v000003", "v000004"]
    with pytest.raises(ValueError):
        versions.prune(spark, folder, keep=0)


def test_marts_of_a_killed_run_are_not_read(spark, tmp_path, monkeypatch):
    from checks.workspace import workspace
    from tillroll.sources import tables

    context = workspace(spark, "/root/testdata/sf0.001").context
    folder = str(tmp_path)
    tables.write_marts(context, folder)
    before = {n: rows_of(tables.load_mart(spark, folder, n)) for n in tables.REGISTRY}
    name = list(tables.REGISTRY)[-1]

    def killed(ctx):
        raise RuntimeError("killed")

    monkeypatch.setitem(tables.REGISTRY, name, killed)
    with pytest.raises(RuntimeError):
        tables.write_marts(context, folder)
    assert {n: rows_of(tables.load_mart(spark, folder, n)) for n in before} == before


# ---------------------------------------------------------------- pivots
def test_a_cohort_beyond_the_declared_width_is_refused(spark):
    from tillroll.operators import reports

    cells = spark.createDataFrame([("2012-01", 0, 1.0), ("2012-01", 84, 0.5)], "cohort string, month_number long, retention double")
    with pytest.raises(ValueError, match="84"):
        reports.cohort_pivot(cells, last_month=83)
    assert len(reports.cohort_pivot(cells, last_month=84).columns) == 86


def test_headers_of_the_second_feed_are_accepted(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    both = [("north", numbered(NORTH), FIRST_HEADERS), ("south", numbered(SOUTH), SECOND_HEADERS)]
    sources = [(n, spark.createDataFrame(rows, headers)) for n, rows, headers in both]
    for source in sources:
        store.append(*source)
    same_as_one_run(spark, store, sources)
