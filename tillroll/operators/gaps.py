"""Time between a customer's purchases, without one task per busy customer.

Purchases are first folded to one row per customer and day. A customer then has at
most one row per calendar day, so the window that looks at the next day is bounded
by the calendar, however many invoices one customer holds. What happened inside a
day is a count: its gaps are all zero days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C

# zero-day gaps are written out in runs of at most this many rows
_RUN = 1000


def _next_day(name: str):
    return F.lead(name).over(Window.partitionBy("customer_id").orderBy("day"))


def day_gap_counts(known_orders: DataFrame) -> DataFrame:
    """(gap_days, gaps): calendar-day gaps between consecutive invoices.

    A second invoice on the same day is a gap of 0.
    """
    days = (
        known_orders.select("customer_id", "day", "invoice_no")
        .distinct()
        .groupBy("customer_id", "day")
        .agg(F.count("*").alias("invoices"))
        .select(
            "invoices",
            F.date_diff(_next_day("day"), "day").cast("bigint").alias("to_next"),
        )
    )
    same_day = F.struct(
        F.lit(0).cast("bigint").alias("gap_days"), (F.col("invoices") - 1).alias("gaps")
    )
    to_next = F.struct(
        F.col("to_next").alias("gap_days"), F.lit(1).cast("bigint").alias("gaps")
    )
    return (
        days.select(F.inline(F.array(same_day, to_next)))
        .filter("gap_days IS NOT NULL AND gaps > 0")
        .groupBy("gap_days")
        .agg(F.sum("gaps").alias("gaps"))
    )


def elapsed_gap_counts(sale_lines: DataFrame) -> DataFrame:
    """(customer_id, gap_days, gaps): whole 24-hour periods between purchase moments.

    Two invoices at one instant are one purchase here. Gaps inside a calendar day are
    shorter than 24 hours, so they count as 0.
    """
    days = (
        sale_lines.filter("customer_id IS NOT NULL")
        .select("customer_id", "invoice_date")
        .distinct()
        .groupBy("customer_id", F.to_date("invoice_date").alias("day"))
        .agg(
            F.count("*").alias("moments"),
            F.min("invoice_date").alias("first_moment"),
            F.max("invoice_date").alias("last_moment"),
        )
        .select("customer_id", "moments", "last_moment", _next_day("first_moment").alias("next"))
    )
    same_day = F.struct(
        F.lit(0).cast("bigint").alias("gap_days"), (F.col("moments") - 1).alias("gaps")
    )
    to_next = F.struct(
        C.whole_days(F.col("last_moment"), F.col("next")).alias("gap_days"),
        F.lit(1).cast("bigint").alias("gaps"),
    )
    return (
        days.select("customer_id", F.inline(F.array(same_day, to_next)))
        .filter("gap_days IS NOT NULL AND gaps > 0")
        .groupBy("customer_id", "gap_days")
        .agg(F.sum("gaps").alias("gaps"))
    )


def one_row_per_gap(counts: DataFrame) -> DataFrame:
    """Write each counted gap out as its own row, in bounded runs.

    Runs are dealt out before they are written: a customer with a third of all gaps has one
    counted row, and its runs go to as many tasks as anyone's.
    """
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("gaps") - 1) / _RUN))
    left = F.least(F.lit(_RUN).cast("bigint"), F.col("gaps") - F.col("run") * _RUN)
    return (
        counts.withColumn("run", F.explode(runs))
        .repartition("customer_id", "gap_days", "run")
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), left)))
        .select("customer_id", "gap_days")
    )
