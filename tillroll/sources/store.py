"""A fact that grows source by source, equal to one cleaning run over all of them.

``FactStore.append`` cleans one arriving source against what is there. New lines meet only the
business keys of their own months; months that gain lines, or whose lines get another description,
are rewritten by dynamic partition overwrite, and files of all other months stay as they are.

Beside the fact the store keeps small tables, one folder per run: how often lines name a code so
(``names``), where lines without a description lie (``nameless``), keys of dropped test lines
(``tests``), a profile of the source (``sources``), and the counts of the change log (``log``).
Because a later source can change the usual description of a code, lines of older months that lacked
one are named anew where that happens.

The row of ``log`` is written last and commits a run. A run that dies before is simply done again:
lines it may have added carry its number and are not taken for old ones.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import columns as C
from tillroll.operators.clean import (
    derive_measures,
    drop_test_rows,
    fill_sentinel,
    keep_first_copy,
    line_counts,
    log_lines,
    normalize_types,
    raw_profile,
    stage_counted,
    tag_rows,
)
from tillroll.operators.scale import salted_left_join
from tillroll.plans.staging import passing, stage
from tillroll.rules import BUSINESS_KEY, Rules
from tillroll.schema import FACT_COLUMNS, FACT_SCHEMA
from tillroll.sources.feed import ingest
from tillroll.sources.tables import in_date_order

#: beside the fact's columns: had a description, got a usual one, run that added the line
_EXTRA = (
    T.StructField("named", T.BooleanType()),
    T.StructField("filled", T.BooleanType()),
    T.StructField("added", T.IntegerType()),
)
_LINES = T.StructType([*FACT_SCHEMA.fields, *_EXTRA])
_NAMES = "stock_code string, description string, n bigint, run int"
_NAMELESS = "stock_code string, month_start date, run int"
_SOURCES = (
    "source string, rows bigint, first_moment timestamp_ntz, last_moment timestamp_ntz, "
    "mapped bigint, run int"
)
_KEY_FIELDS = [f for f in FACT_SCHEMA.fields if f.name in (*BUSINESS_KEY, "month_start")]
_TESTS = T.StructType([*_KEY_FIELDS, T.StructField("run", T.IntegerType())])

Months = list[dt.date | None]


def _within(months: Months) -> Column:
    """``month_start`` is one of ``months``; prunes month folders."""
    known = F.col("month_start").isin([m for m in months if m is not None])
    return known | F.col("month_start").isNull() if None in months else known


def _months(df: DataFrame) -> Months:
    """Distinct months: as many as the calendar has."""
    return [r[0] for r in df.select("month_start").distinct().collect()]


def _usual(names: DataFrame) -> DataFrame:
    """The commonest description per code from counts of several runs; ties -> smallest."""
    counted = names.groupBy("stock_code", "description").agg(F.sum("n").alias("n"))
    best = F.min_by("description", F.struct(-F.col("n"), F.col("description")))
    return counted.groupBy("stock_code").agg(best.alias("description"))


class FactStore:
    """``folder`` must be one that all executors reach; one append at a time."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        rules: Rules | None = None,
        countries: DataFrame | None = None,
    ):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules or Rules()
        self.countries = countries

    # ------------------------------------------------------------ reading
    def _read(self, name: str, schema) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def _log_schema(self) -> str:
        return ", ".join(f"{name} bigint" for name in line_counts(self.rules)) + ", run int"

    def runs(self) -> int:
        """How many sources have been appended."""
        last = self._read("log", self._log_schema).agg(F.max("run")).first()[0]
        return 0 if last is None else last + 1

    def _lines(self, before: int) -> DataFrame:
        return self._read("fact", _LINES).filter(F.col("added") < before)

    def fact(self) -> DataFrame:
        """The 14-column fact of all runs that are complete."""
        return self._lines(self.runs()).select(*FACT_COLUMNS)

    def change_log(self) -> DataFrame:
        """``(rule, rows, note)`` of all runs, as one cleaning run would log them."""
        runs = self.runs()
        done = F.col("run") < runs
        names = list(line_counts(self.rules))
        filled = self._lines(runs).agg(F.count_if("filled")).scalar()
        counts = (
            self._read("log", self._log_schema).filter(done)
            .agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
            .withColumn("backfilled", filled)
        )
        sources = (
            self._read("sources", _SOURCES).filter(done).groupBy("source")
            .agg(
                F.sum("rows").alias("rows"), F.min("first_moment").alias("first_moment"),
                F.max("last_moment").alias("last_moment"), F.sum("mapped").alias("mapped"),
            )
        )
        return log_lines(sources, counts, self.rules, self.countries is not None)

    # ------------------------------------------------------------ appending
    def append(self, name: str, source: DataFrame) -> Months:
        """Clean ``source`` and add it; returns the months that were rewritten.

        What is staged on the way is removed again.
        """
        with passing(self.spark):
            return self._append(name, source)

    def _append(self, name: str, source: DataFrame) -> Months:
        run, rules = self.runs(), self.rules
        raw = ingest([(name, source)])
        typed = normalize_types(raw, rules, self.countries).drop("source")
        fresh = stage(derive_measures(keep_first_copy(typed)).drop("file_ord"), "fresh-lines")
        new, counts = stage_counted(tag_rows(self._unseen(fresh, run), rules), rules, "new-lines")
        kept = drop_test_rows(new, rules)

        self._write(
            new.filter(C.is_test_code(F.col("stock_code"), rules))
            .select(*(f.name for f in _KEY_FIELDS)), "tests", run,
        )
        nameless = kept.filter("description IS NULL").select("stock_code", "month_start").distinct()
        self._write(nameless, "nameless", run)
        goods = kept.filter("is_merchandise AND stock_code IS NOT NULL AND description IS NOT NULL")
        named = goods.groupBy("stock_code", "description").agg(F.count("*").alias("n"))
        self._write(named, "names", run)
        self._write(raw_profile(raw, rules, self.countries), "sources", run)

        touched = self._touched(kept, run)
        if touched:
            self._rewrite(kept, touched, run)
        row = self.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} bigint" for n in counts))
        self._write(row, "log", run)
        return touched

    def _write(self, df: DataFrame, name: str, run: int) -> None:
        path = f"{self.folder}/{name}/run={run}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)

    def _unseen(self, fresh: DataFrame, run: int) -> DataFrame:
        """Lines whose business key no earlier run has, test lines included."""
        months = _months(fresh)
        if not run or not months:
            return fresh
        key = list(BUSINESS_KEY)
        tests = self._read("tests", _TESTS).filter(F.col("run") < run)
        seen = self._lines(run).filter(_within(months)).select(*key).union(
            tests.filter(_within(months)).select(*key)
        )
        left, right = fresh.alias("l"), seen.alias("r")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
        return left.join(right, reduce(Column.__and__, same), "left_anti")

    def _touched(self, kept: DataFrame, run: int) -> Months:
        """Months with new lines, and those whose nameless lines now get another description."""
        names = self._read("names", _NAMES)
        mine = names.filter(F.col("run") == run).select("stock_code").distinct()
        here = names.join(mine, "stock_code", "left_semi")
        before = _usual(here.filter(F.col("run") < run)).withColumnRenamed("description", "old")
        after = _usual(here.filter(F.col("run") <= run))
        other = after.join(before, "stock_code", "left").filter(
            ~F.col("old").eqNullSafe(F.col("description"))
        )
        waiting = self._read("nameless", _NAMELESS).filter(F.col("run") < run)
        renamed = waiting.join(other, "stock_code", "left_semi")
        return _months(kept.select("month_start").union(renamed.select("month_start")))

    def _rewrite(self, kept: DataFrame, touched: Months, run: int) -> None:
        flags = {
            "named": F.col("description").isNotNull(),
            "filled": F.lit(False),
            "added": F.lit(run),
        }
        columns = [f.name for f in _LINES.fields]
        old = self._lines(run).filter(_within(touched))
        lines = old.select(*columns).union(kept.withColumns(flags).select(*columns))
        waiting = self._read("nameless", _NAMELESS).filter(F.col("run") <= run)
        codes = waiting.filter(_within(touched)).select("stock_code").distinct()
        names = self._read("names", _NAMES).filter(F.col("run") <= run)
        known = stage(_usual(names.join(codes, "stock_code", "left_semi")), "usual-descriptions")
        again = salted_left_join(
            lines.filter(~F.col("named")).drop("description"),
            known,
            ["stock_code"],
            spread=["invoice_no", "invoice_date", "quantity", "unit_price"],
        ).withColumn("filled", F.col("description").isNotNull())
        whole = lines.filter("named").unionByName(fill_sentinel(again, self.rules))
        (
            in_date_order(whole.select(*columns))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("month_start")
            .parquet(f"{self.folder}/fact")
        )
