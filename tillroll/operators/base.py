"""Base relations over the fact and the filterable slice."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.rules import Rules

def all_lines(fact: DataFrame) -> DataFrame:
    """Every line, dated by day."""
    return fact.withColumn("invoice_date", F.to_date("invoice_date"))


def sales_all(fact: DataFrame) -> DataFrame:
    """Goods sales, dated by day, guests included (B1)."""
    goods_sale = (F.col("line_type") == C.SALE) & F.col("is_merchandise")
    return all_lines(fact.filter(goods_sale)).select(
        "invoice_no", "customer_id", "stock_code", "description", "country", "invoice_date",
        "month_start", "quantity", "unit_price", "line_revenue", "is_bulk",
        F.col("customer_id").isNull().alias("is_guest"),
    )


def sales_id(fact: DataFrame) -> DataFrame:
    """Goods sales of known customers (B2)."""
    return sales_all(fact.filter(F.col("customer_id").isNotNull()))


def snapshot(fact: DataFrame) -> DataFrame:
    """One row: the last day with a goods sale."""
    return sales_all(fact).agg(F.max("invoice_date").alias("as_of"))


def apply_filters(
    fact: DataFrame,
    *,
    period: tuple[dt.date | str, dt.date | str] | None = None,
    countries: Sequence[str] | None = None,
    merchandise_only: bool = True,
    include_bulk: bool = True,
    identified_only: bool = False,
) -> DataFrame:
    """Cut a slice of the fact.

    ``period`` runs from its first moment to one day after its second, that one left out: a bare
    date is its midnight, so the last day counts whole; a time of day is kept.

    The implied month range is added so that a fact stored by month is pruned by
    folder; the rest reaches the Parquet scan as pushed filters.
    """
    out = fact
    if period is not None:
        start, end = (dt.datetime.fromisoformat(str(moment)) for moment in period)
        end += dt.timedelta(days=1)
        out = out.filter(
            F.col("month_start").between(
                F.lit(start.date().replace(day=1)), F.lit(end.date().replace(day=1))
            )
            & (F.col("invoice_date") >= F.lit(str(start)).cast("timestamp_ntz"))
            & (F.col("invoice_date") < F.lit(str(end)).cast("timestamp_ntz"))
        )
    if countries:
        out = out.filter(F.col("country").isin(list(countries)))
    if merchandise_only:
        out = out.filter("is_merchandise")
    if not include_bulk:
        out = out.filter("NOT is_bulk")
    if identified_only:
        out = out.filter("customer_id IS NOT NULL")
    return out


def sales(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_type") == C.SALE)


def reversals(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_type").isin(C.CANCELLATION, C.RETURN))


def with_market_group(lines: DataFrame, rules: Rules) -> DataFrame:
    """Add ``region``: one of four market groups."""
    return lines.withColumn("region", C.market_group(F.col("country"), rules))


def order_rollup(sale_lines: DataFrame) -> DataFrame:
    """Sale lines -> one row per invoice, customer, country and day.

    Most measures only need this grain. Summing here, with map-side combine, shrinks
    the data before any distinct count has to multiply it.
    """
    return sale_lines.groupBy(
        "invoice_no", "customer_id", "country",
        F.to_date("invoice_date").alias("day"), "month_start",
    ).agg(
        F.sum("line_revenue").alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count("*").alias("lines"),
    )


def customer_months(orders: DataFrame) -> DataFrame:
    """One row per known customer and active month: revenue and cohort month.

    A customer has at most one row per calendar month here, so the window that
    finds the first month never sees a large group.
    """
    active = (
        orders.filter("customer_id IS NOT NULL")
        .groupBy("customer_id", "month_start")
        .agg(F.sum("revenue").alias("revenue"))
    )
    first = F.min("month_start").over(Window.partitionBy("customer_id"))
    return active.withColumn("cohort_month", first)


def first_month(fact: DataFrame) -> DataFrame:
    """Customer -> month of the first goods sale over the whole history."""
    return (
        fact.filter(
            (F.col("line_type") == C.SALE) & F.col("is_merchandise")
            & F.col("customer_id").isNotNull()
        )
        .groupBy("customer_id")
        .agg(F.min("month_start").alias("first_month"))
    )
