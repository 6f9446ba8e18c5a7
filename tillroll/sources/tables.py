"""Reading and writing the cleaned fact, the change log and the marts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.clean import Cleaning
from tillroll.operators.marts import MART_ORDER, REGISTRY
from tillroll.plans.context import Context
from tillroll.plans.staging import passing
from tillroll.schema import FACT_COLUMNS, FACT_SCHEMA
from tillroll.sources import versions


def in_date_order(fact: DataFrame) -> DataFrame:
    """Lines range-split and sorted by month, moment, invoice and code.

    Every task gets one slice of the order: a hot month is split over many tasks, a task
    touches few months, and min/max statistics in the files follow the date. Quantity and
    price complete the business key, so even one invoice and code can be split.
    """
    order = [
        "month_start", "invoice_date", "invoice_no", "stock_code", "quantity", "unit_price",
    ]
    return fact.repartitionByRange(*order).sortWithinPartitions(*order)


def write_fact(fact: DataFrame, path: str, max_records_per_file: int = 20_000_000) -> None:
    """Write the fact as zstd Parquet, one folder per month, lines in date order."""
    (
        in_date_order(fact.select(*FACT_COLUMNS))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("month_start")
        .parquet(path)
    )


def write_run(cleaning: Cleaning, fact_path: str, log_path: str) -> None:
    """Write the fact and the change log of one cleaning run; lines are repaired once."""
    write_fact(cleaning.fact, fact_path)
    write_table(cleaning.change_log(), log_path)


def load_fact(spark: SparkSession, path: str) -> DataFrame:
    """The written fact with its fixed schema; no schema inference job."""
    return spark.read.schema(FACT_SCHEMA).parquet(path).select(*FACT_COLUMNS)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_marts(ctx: Context, folder: str, at_once: int = 4) -> list[str]:
    """Write all sixteen marts, each in its unique order; returns their names.

    They go into a new version of ``folder``, which readers get once all are written. What several
    marts read is staged first. The marts are then independent jobs; a few run side by side so
    that one mart's last small stage leaves no cluster idle. What a mart alone stages is removed.
    """
    spark = ctx.fact.sparkSession
    version = versions.begin(spark, folder)
    _ = ctx.orders, ctx.customer_base, ctx.rfm

    def write(name: str) -> None:
        order = [
            F.desc_nulls_last(key[1:]) if key.startswith("-") else F.asc_nulls_last(key)
            for key in MART_ORDER.get(name, [])
        ]
        with passing(spark):
            mart = REGISTRY[name](ctx)
            write_table(mart.orderBy(*order) if order else mart, f"{version}/{name}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, REGISTRY))
    versions.commit(spark, version)
    return list(REGISTRY)


def load_mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A mart of the last complete version."""
    return spark.read.parquet(f"{versions.current(spark, folder)}/{name}")
