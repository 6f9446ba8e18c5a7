"""The sixteen marts (C1-C16): whole-history tables derived from one fact.

Each function takes a :class:`~tillroll.plans.context.Context` and returns a
frame. Rows are not ordered here; ``MART_ORDER`` names the unique sort key that the
sink applies.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators import base
from tillroll.operators.gaps import day_gap_counts
from tillroll.operators.scale import (
    compact_quantiles,
    distinct_rollup,
    most_common,
    running_total,
    share_of_total,
)
from tillroll.operators.selection import leaders
from tillroll.plans.context import Context


def _money(name: str):
    return C.rounded(F.col(name), 2).alias(name)


# ---------------------------------------------------------------- time
def calendar_back(value: str, months: int) -> Column:
    """The value ``months`` calendar months earlier, null if that month has no row.

    For frames with one row per month: the window sees a few hundred rows at most.
    """
    serial = F.year("month_start") * 12 + F.month("month_start")
    return F.max(value).over(Window.orderBy(serial).rangeBetween(-months, -months))


def monthly_kpi(ctx: Context, calendar_lag: bool = False) -> DataFrame:
    """Turnover, orders, customers and newcomers per month.

    The two comparison columns look back one and twelve *rows*; with
    ``calendar_lag`` they look back one and twelve calendar months, which differs
    only where a month has no sales.
    """
    active = distinct_rollup(ctx.orders, ["month_start"], ["revenue", "units"])
    joined = (
        ctx.known_orders.groupBy("customer_id")
        .agg(F.min("month_start").alias("month_start"))
        .groupBy("month_start")
        .agg(F.count("*").alias("newcomers"))
    )
    newcomers = F.coalesce("newcomers", F.lit(0)).cast("bigint")

    def back(months: int):
        if calendar_lag:
            return calendar_back("revenue", months)
        return F.lag("revenue", months).over(Window.orderBy("month_start"))

    return active.join(joined, "month_start", "left").select(
        C.month_label(F.col("month_start")).alias("month"),
        "month_start",
        _money("revenue"),
        "orders",
        "customers",
        "units",
        newcomers.alias("new_customers"),
        (F.col("customers") - newcomers).alias("returning_customers"),
        C.rounded(C.ratio(F.col("revenue"), F.col("orders")), 2).alias("aov"),
        C.rounded(C.ratio(F.col("revenue"), F.col("customers")), 2).alias("revenue_per_customer"),
        C.dbl(back(1)).alias("revenue_prev_month"),
        C.dbl(back(12)).alias("revenue_same_month_last_year"),
    )


def _cohort_cells(ctx: Context) -> DataFrame:
    """(cohort month, months since) -> active customers and their revenue."""
    months = base.customer_months(ctx.known_orders)
    since = C.months_between_starts(F.col("cohort_month"), F.col("month_start"))
    return months.groupBy("cohort_month", since.alias("month_number")).agg(
        F.count("*").alias("active_customers"), F.sum("revenue").alias("revenue")
    )


def cohort_retention(ctx: Context) -> DataFrame:
    """Share of each cohort active n months after its first purchase.

    Everyone is active in month 0, so that cell is the cohort's size.
    """
    size = F.max(F.when(F.col("month_number") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return _cohort_cells(ctx).withColumn("cohort_size", size).select(
        C.month_label(F.col("cohort_month")).alias("cohort"),
        "cohort_month",
        "month_number",
        "cohort_size",
        "active_customers",
        C.rounded(C.ratio(F.col("active_customers"), F.col("cohort_size")), 4).alias("retention"),
    )


def cohort_revenue(ctx: Context) -> DataFrame:
    """Share of a cohort's lifetime revenue earned in month n."""
    lifetime = F.sum("revenue").over(Window.partitionBy("cohort_month"))
    return _cohort_cells(ctx).select(
        C.month_label(F.col("cohort_month")).alias("cohort"),
        "month_number",
        _money("revenue"),
        C.rounded(C.ratio(F.col("revenue"), lifetime), 4).alias("revenue_share"),
    )


def weekday_profile(ctx: Context) -> DataFrame:
    """Orders and turnover by day of the week, Sunday = 0 (C11)."""
    return (
        ctx.orders.groupBy(F.dayofweek("day").alias("_dow"))
        .agg(
            F.min(F.date_format("day", "EEEE")).alias("weekday"),
            F.count_distinct("invoice_no").alias("orders"),
            F.sum("revenue").alias("revenue"),
        )
        .select(
            "weekday",
            (F.col("_dow") - 1).cast("bigint").alias("dow"),
            "orders",
            _money("revenue"),
            C.rounded(C.ratio(F.col("revenue"), F.col("orders")), 2).alias("aov"),
        )
    )


# ---------------------------------------------------------------- customers
def rfm(ctx: Context) -> DataFrame:
    """Scores and segment of every known customer (C4)."""
    return ctx.rfm


def rfm_segments(ctx: Context) -> DataFrame:
    """Size, money and habits of each segment."""
    cents = F.col("monetary").cast("decimal(28,2)")
    per_segment = ctx.rfm.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.sum(cents).alias("revenue"),
        F.sum("frequency").alias("_orders"),
        F.sum("recency_days").alias("_recency"),
    )
    mean = lambda total, places: C.rounded(
        C.ratio(F.col(total), F.col("customers")), places
    )
    return per_segment.select(
        "segment",
        "customers",
        C.rounded(share_of_total(per_segment, "customers"), 4).alias("customers_share"),
        C.dbl(F.col("revenue")).alias("revenue"),
        C.rounded(share_of_total(per_segment, "revenue"), 4).alias("revenue_share"),
        mean("revenue", 2).alias("avg_revenue_per_customer"),
        mean("_orders", 2).alias("avg_orders"),
        mean("_recency", 0).alias("avg_recency_days"),
    )


_REACHED = ("customers_for_half_of_revenue", "customers_for_80_of_revenue", "total_customers")


def customer_concentration(ctx: Context) -> DataFrame:
    """How many top customers reach half and 80 % of known revenue."""
    money = ctx.customer_base.select("customer_id", "monetary")
    found = leaders(money, "monetary", [Decimal("0.5"), Decimal("0.8")])
    if found is None:  # the sum of all is negative: look along the whole ranking
        ranked = running_total(money, [F.desc("monetary"), F.asc("customer_id")], "monetary")

        def reached(tenths: int):
            return F.min(F.when(F.col("cum") * 10 >= F.col("total") * tenths, F.col("rank")))

        counts = ranked.agg(reached(5), reached(8), F.max("rows")).toDF(*_REACHED)
    else:
        row = (*found.needed, found.rows) if found.rows else (None, None, None)
        counts = money.sparkSession.createDataFrame(
            [row], ", ".join(f"{name} bigint" for name in _REACHED)
        )
    return counts.select(
        "*",
        C.rounded(
            C.ratio(F.col("customers_for_half_of_revenue"), F.col("total_customers")), 4
        ).alias("share_for_50pct"),
        C.rounded(
            C.ratio(F.col("customers_for_80_of_revenue"), F.col("total_customers")), 4
        ).alias("share_for_80pct"),
    )


def purchase_gaps(ctx: Context) -> DataFrame:
    """Calendar days between a customer's consecutive invoices."""
    gaps = day_gap_counts(ctx.known_orders)
    quarters = compact_quantiles(gaps, "gap_days", [0.25, 0.5, 0.75], weight="gaps").scalar()
    total = F.sum("gaps")

    def share(condition):
        part = F.sum(F.when(condition, F.col("gaps")).otherwise(0))
        return C.rounded(C.ratio(part, total), 4)

    return gaps.agg(
        F.coalesce(total, F.lit(0)).alias("gaps_observed"),
        C.rounded(C.ratio(F.sum(F.col("gap_days") * F.col("gaps")), total), 1).alias(
            "avg_gap_days"
        ),
        share(F.col("gap_days") <= 30).alias("share_gaps_up_to_30d"),
        share(F.col("gap_days") > 180).alias("share_gaps_over_180d"),
    ).select(
        "gaps_observed",
        "avg_gap_days",
        C.rounded(quarters[0], 1).alias("p25_gap_days"),
        C.rounded(quarters[1], 1).alias("median_gap_days"),
        C.rounded(quarters[2], 1).alias("p75_gap_days"),
        "share_gaps_up_to_30d",
        "share_gaps_over_180d",
    )


# ---------------------------------------------------------------- places
def by_country(orders: DataFrame) -> DataFrame:
    """Per country: revenue, orders, customers and the share of them with more than one order
    there; null for a country of guests only."""
    rate = C.ratio(F.col("repeaters"), F.col("customers"))
    return distinct_rollup(orders, ["country"], ["revenue"]).withColumn("repeat_rate", rate)


def country_stats(ctx: Context) -> DataFrame:
    """Turnover and repeat rate by country.

    Countries with guests only have no repeat rate: they get no row and do not
    count in the share's total. ``Slice.country_rollup`` keeps them.
    """
    listed = by_country(ctx.orders).filter("customers > 0 AND country IS NOT NULL")
    return listed.select(
        "country",
        _money("revenue"),
        C.rounded(share_of_total(listed, "revenue"), 4).alias("revenue_share"),
        "orders",
        "customers",
        C.rounded(C.ratio(F.col("revenue"), F.col("orders")), 2).alias("aov"),
        C.rounded(F.col("repeat_rate"), 4).alias("repeat_rate"),
    )


def region_stats(ctx: Context) -> DataFrame:
    """Turnover by market group and month."""
    orders = base.with_market_group(ctx.orders, ctx.rules)
    return distinct_rollup(orders, ["region", "month_start"], ["revenue"]).select(
        "region",
        C.month_label(F.col("month_start")).alias("month"),
        _money("revenue"),
        "orders",
        "customers",
    )


# ---------------------------------------------------------------- products
def product_rollup(sale_lines: DataFrame) -> DataFrame:
    """Per code: money, units, orders, buyers; the lines are shuffled once."""
    lines = sale_lines.filter("stock_code IS NOT NULL").select(
        "stock_code", "invoice_no", "customer_id",
        F.col("line_revenue").alias("revenue"), F.col("quantity").alias("units"),
    )
    return distinct_rollup(lines, ["stock_code"], ["revenue", "units"]).select(
        "stock_code", "revenue", "units", "orders", F.col("customers").alias("buyers")
    )


def product_stats(ctx: Context) -> DataFrame:
    """Per code: label, money, share and cumulative share from the top."""
    ranked = running_total(
        product_rollup(ctx.sales_all), [F.desc("revenue"), F.asc("stock_code")], "revenue"
    )
    labels = most_common(ctx.sales_all, ["stock_code"], "description")
    return ranked.join(labels, "stock_code").select(
        "stock_code",
        "description",
        _money("revenue"),
        C.rounded(C.ratio(F.col("revenue"), F.col("total")), 4).alias("revenue_share"),
        "units",
        "orders",
        "buyers",
        C.rounded(C.ratio(F.col("revenue"), F.col("units")), 2).alias("avg_unit_price"),
        C.rounded(C.ratio(F.col("cum"), F.col("total")), 4).alias("cum_revenue_share"),
    )


# ---------------------------------------------------------------- reversals
def _is_sale():
    return F.col("line_type") == C.SALE


def reversal_monthly(ctx: Context) -> DataFrame:
    """Cancellations and returns per month.

    The share sets reversals of all lines against goods sales only;
    ``Slice.cancellations_monthly`` uses one set of lines for both.
    """
    goods_sale = _is_sale() & F.col("is_merchandise")
    none = F.lit(0).cast("decimal(18,2)")
    monthly = ctx.fact.groupBy("month_start").agg(
        F.count_if(F.col("line_type") == C.CANCELLATION).alias("cancellation_lines"),
        F.count_if(F.col("line_type") == C.RETURN).alias("return_lines"),
        F.sum(F.when(_is_sale(), none).otherwise(F.col("line_revenue"))).alias("reversal_value"),
        F.sum(F.when(goods_sale, F.col("line_revenue")).otherwise(none)).alias("sales_value"),
    )
    share = C.ratio(-F.col("reversal_value"), F.col("sales_value"))
    return monthly.select(
        C.month_label(F.col("month_start")).alias("month"),
        "month_start",
        "cancellation_lines",
        "return_lines",
        _money("reversal_value"),
        _money("sales_value"),
        C.rounded(share, 4).alias("reversal_share"),
    )


def reversal_breakdown(ctx: Context) -> DataFrame:
    """Reversed money by line type, goods against non-goods."""
    names = ctx.rules.labels
    kind = F.when(F.col("is_merchandise"), names.goods).otherwise(names.non_goods)
    return (
        ctx.fact.filter(~_is_sale())
        .groupBy("line_type", kind.alias("kind"))
        .agg(F.count("*").alias("lines"), F.sum("line_revenue").alias("value"))
        .select("line_type", "kind", "lines", _money("value"))
    )


def reversed_products(ctx: Context, limit: int = 25) -> DataFrame:
    """The goods with most money reversed (C14); labels only for the winners."""
    reversed_goods = ctx.fact.filter(~_is_sale() & F.col("is_merchandise"))
    top = (
        reversed_goods.groupBy("stock_code")
        .agg(
            F.count("*").alias("reversal_lines"),
            F.sum("line_revenue").alias("reversal_value"),
            F.sum(-F.col("quantity")).alias("units_back"),
        )
        .orderBy("reversal_value", F.asc_nulls_last("stock_code"))
        .limit(limit)
    )
    return with_labels(top, reversed_goods).select(
        "stock_code", "description", "reversal_lines", _money("reversal_value"), "units_back"
    )


def with_labels(top: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the usual description to the few codes of a top-k frame.

    ``top`` has passed a limit, so the planner knows its size: it broadcasts a small
    one to find its lines and shuffles a large one.
    """
    same = F.col("w.stock_code").eqNullSafe(F.col("l.stock_code"))
    winners = top.select("stock_code").alias("w")
    named = lines.select("stock_code", "description").alias("l").join(winners, same, "left_semi")
    labels = most_common(named, ["stock_code"], "description").alias("l")
    return (
        top.alias("w").join(labels, same, "left").select("w.*", F.col("l.description"))
    )


def non_merchandise_breakdown(ctx: Context) -> DataFrame:
    """Money booked on non-goods codes, left out of revenue."""
    charges = ctx.fact.filter("NOT is_merchandise")
    none = F.lit(0).cast("decimal(18,2)")
    per_code = charges.groupBy("stock_code").agg(
        F.count("*").alias("lines"),
        F.sum("line_revenue").alias("value"),
        F.sum(F.when(_is_sale(), F.col("line_revenue")).otherwise(none)).alias("sales_value"),
    )
    labels = most_common(charges, ["stock_code"], "description").alias("l")
    same = F.col("p.stock_code").eqNullSafe(F.col("l.stock_code"))
    return per_code.alias("p").join(labels, same, "left").select(
        "p.stock_code", "l.description", "lines", _money("value"), _money("sales_value")
    )


def data_quality(ctx: Context) -> DataFrame:
    """One row: size of the fact and its flagged parts.

    Counted per invoice and customer first, so the distinct counts multiply
    invoices and not lines.
    """
    rules = ctx.rules
    counted = {
        "lines_total": F.lit(True),
        "cancellation_lines": F.col("line_type") == C.CANCELLATION,
        "return_lines": F.col("line_type") == C.RETURN,
        "non_merchandise_lines": ~F.col("is_merchandise"),
        "guest_lines": F.col("is_guest"),
        "bulk_lines": F.col("is_bulk"),
        "description_missing": F.col("description") == rules.labels.no_description,
        "country_unspecified": F.col("country") == rules.unspecified_country,
    }
    per_invoice = ctx.fact.groupBy("invoice_no", "customer_id").agg(
        *(F.count_if(condition).alias(name) for name, condition in counted.items()),
        F.min("invoice_date").alias("first"),
        F.max("invoice_date").alias("last"),
    )
    whole = distinct_rollup(per_invoice, [], list(counted), ["first"], ["last"])
    return whole.select(
        *(F.coalesce(name, F.lit(0)).alias(name) for name in counted),
        F.col("orders").alias("invoices"),
        "customers",
        F.to_date("first").alias("first_day"),
        F.to_date("last").alias("last_day"),
    ).select(
        "lines_total", "invoices", "customers", "cancellation_lines", "return_lines",
        "non_merchandise_lines", "guest_lines", "bulk_lines", "description_missing",
        "country_unspecified", "first_day", "last_day",
    )


REGISTRY: dict[str, Callable[[Context], DataFrame]] = {
    "monthly_kpi": monthly_kpi,
    "cohort_retention": cohort_retention,
    "cohort_revenue": cohort_revenue,
    "rfm": rfm,
    "rfm_segments": rfm_segments,
    "country_stats": country_stats,
    "region_stats": region_stats,
    "product_stats": product_stats,
    "customer_concentration": customer_concentration,
    "purchase_gaps": purchase_gaps,
    "weekday_profile": weekday_profile,
    "reversal_monthly": reversal_monthly,
    "reversal_breakdown": reversal_breakdown,
    "reversed_products": reversed_products,
    "non_merchandise_breakdown": non_merchandise_breakdown,
    "data_quality": data_quality,
}

# unique sort keys, applied where a mart is written; one-row marts need none
MART_ORDER: dict[str, list[str]] = {
    "monthly_kpi": ["month_start"],
    "cohort_retention": ["cohort_month", "month_number"],
    "cohort_revenue": ["cohort", "month_number"],
    "rfm": ["customer_id"],
    "rfm_segments": ["-revenue", "segment"],
    "country_stats": ["-revenue", "country"],
    "region_stats": ["region", "month"],
    "product_stats": ["-revenue", "stock_code"],
    "weekday_profile": ["dow"],
    "reversal_monthly": ["month_start"],
    "reversal_breakdown": ["value", "line_type", "kind"],
    "reversed_products": ["reversal_value", "stock_code"],
    "non_merchandise_breakdown": ["-value", "stock_code"],
}
