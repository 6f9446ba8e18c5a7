"""Reports over the marts and over the whole history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators import base, marts
from tillroll.plans.context import Context


# ---------------------------------------------------------------- cohorts
def cohort_pivot(
    cells: DataFrame, value: str = "retention", last_month: int | None = None
) -> DataFrame:
    """Long cohort table -> one row per cohort, columns ``m00, m01, ...``.

    The width is that of the cells. With ``last_month`` the schema is fixed beforehand; cells
    beyond it are an error, never left out.
    """
    reaches = cells.agg(F.max("month_number")).first()[0] or 0
    if last_month is None:
        last_month = reaches
    if reaches > last_month:
        raise ValueError(f"cells reach month {reaches}, beyond the declared {last_month}")
    cell = {
        f"m{n:02d}": F.max(F.when(F.col("month_number") == n, F.col(value)))
        for n in range(last_month + 1)
    }
    return cells.groupBy("cohort").agg(*(col.alias(name) for name, col in cell.items()))


def retention_curve(retention: DataFrame) -> DataFrame:
    """Plain mean over cohorts by month number; absent cells are absent, not zero."""
    return _curve(retention, "retention")


def cohort_revenue_curve(revenue: DataFrame, months: int = 24) -> DataFrame:
    """Mean revenue share by month number, the first ``months`` of them."""
    return _curve(revenue, "revenue_share").filter(F.col("month_number") < months)


def _curve(cells: DataFrame, value: str) -> DataFrame:
    # the marts round to 4 places, so a decimal sum is exact and order-free
    exact = F.sum(F.col(value).cast("decimal(18,4)"))
    return cells.groupBy("month_number").agg(C.ratio(exact, F.count(value)).alias(value))


# ---------------------------------------------------------------- segments
def segment_share_long(segments: DataFrame) -> DataFrame:
    """Customer share and revenue share as (segment, metric, share) rows."""
    return segments.select(
        "segment",
        F.col("customers_share").alias("customers"),
        F.col("revenue_share").alias("revenue"),
    ).unpivot("segment", ["customers", "revenue"], "metric", "share")


def rfm_sample(rfm: DataFrame, limit: int = 4000, seed: int = 7) -> DataFrame:
    """A repeatable sample of customers: the first ``limit`` by seeded hash."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("customer_id").cast("string")))
    return (
        rfm.select("customer_id", "recency_days", "monetary", "segment", draw.alias("_draw"))
        .orderBy("_draw", "customer_id")
        .limit(limit)
        .drop("_draw")
    )


def score_group_sizes(rfm: DataFrame) -> DataFrame:
    """Customers per frequency score; uneven on purpose."""
    return rfm.groupBy("f_score").agg(F.count("*").alias("customers"))


def top_reversed(ctx: Context, limit: int = 10) -> DataFrame:
    """The head of the reversed-goods mart."""
    return marts.reversed_products(ctx, limit)


# ---------------------------------------------------------------- years
def yearly_totals(kpi: DataFrame) -> DataFrame:
    """Monthly KPIs summed per calendar year."""
    return kpi.groupBy(F.substring("month", 1, 4).alias("year")).agg(
        C.dbl(F.sum(F.col("revenue").cast("decimal(28,2)"))).alias("revenue"),
        F.sum("orders").alias("orders"),
        F.sum("new_customers").alias("new_customers"),
        F.sum("returning_customers").alias("returning_customers"),
    )


def _in_years(orders: DataFrame, years: Sequence[int], cutoff: str | None) -> DataFrame:
    """Orders of the given years, each cut after the day ``MM-dd`` if one is given."""
    out = orders.withColumn("year", F.year("day")).filter(
        F.col("year").isin([int(y) for y in years])
    )
    if cutoff:
        out = out.filter(F.date_format("day", "MM-dd") <= cutoff)
    return out


def _change(old, new):
    return C.rounded((C.ratio(new, old) - 1) * 100, 1)


def year_over_year(
    ctx: Context, years: tuple[int, int], cutoff: str | None = None
) -> DataFrame:
    """Two years side by side with the percent change.

    Newcomers and returning customers are counted per month against the whole
    history and summed, as in the monthly KPIs. ``cutoff`` ends both years on the
    same day, so a year still running can be compared.
    """
    chosen = _in_years(ctx.orders, years, cutoff)
    starts = ctx.known_orders.groupBy("customer_id").agg(F.min("month_start").alias("first"))
    orders = chosen.groupBy("year", "month_start").agg(
        F.sum("revenue").alias("revenue"), F.count_distinct("invoice_no").alias("orders")
    )
    active = (
        chosen.filter("customer_id IS NOT NULL")
        .select("year", "month_start", "customer_id")
        .distinct()
        .join(starts, "customer_id")
        .groupBy("year", "month_start")
        .agg(
            F.count_if(F.col("month_start") == F.col("first")).alias("new_customers"),
            F.count_if(F.col("month_start") != F.col("first")).alias("returning_customers"),
        )
    )
    per_year = (
        orders.join(active, ["year", "month_start"], "left")
        .groupBy("year")
        .agg(
            C.dbl(F.sum("revenue")).alias("revenue"),
            C.dbl(F.sum("orders")).alias("orders"),
            C.dbl(F.coalesce(F.sum("new_customers"), F.lit(0))).alias("new_customers"),
            C.dbl(F.coalesce(F.sum("returning_customers"), F.lit(0))).alias(
                "returning_customers"
            ),
        )
        .withColumn("aov", C.ratio(F.col("revenue"), F.col("orders")))
    )
    measures = ["revenue", "orders", "new_customers", "returning_customers", "aov"]
    old, new = years
    return (
        per_year.unpivot("year", measures, "measure", "amount")
        .groupBy("measure")
        .agg(
            F.max(F.when(F.col("year") == old, F.col("amount"))).alias("earlier"),
            F.max(F.when(F.col("year") == new, F.col("amount"))).alias("later"),
        )
        .withColumn("change_pct", _change(F.col("earlier"), F.col("later")))
    )


def region_yoy(ctx: Context, years: tuple[int, int], cutoff: str | None = None) -> DataFrame:
    """Yearly change of revenue, orders and order value per market group."""
    old, new = years
    per_year = (
        base.with_market_group(_in_years(ctx.orders, years, cutoff), ctx.rules)
        .groupBy("region", "year")
        .agg(F.sum("revenue").alias("revenue"), F.count_distinct("invoice_no").alias("orders"))
    )

    def of(year: int, name: str):
        return F.max(F.when(F.col("year") == year, F.col(name)))

    aov = lambda when: C.ratio(F.col(f"revenue_{when}"), F.col(f"orders_{when}"))
    return (
        per_year.groupBy("region")
        .agg(
            *(
                of(year, name).alias(f"{name}_{when}")
                for when, year in (("earlier", old), ("later", new))
                for name in ("revenue", "orders")
            )
        )
        .select(
            "region",
            C.dbl(F.col("revenue_earlier")).alias("revenue_earlier"),
            C.dbl(F.col("revenue_later")).alias("revenue_later"),
            "orders_earlier",
            "orders_later",
            _change(F.col("revenue_earlier"), F.col("revenue_later")).alias("revenue_change_pct"),
            _change(F.col("orders_earlier"), F.col("orders_later")).alias("orders_change_pct"),
            _change(aov("earlier"), aov("later")).alias("aov_change_pct"),
        )
    )


# ---------------------------------------------------------------- customers
def customer_coverage(fact: DataFrame) -> DataFrame:
    """Known customers by what they have lines in."""
    is_sale = F.col("line_type") == C.SALE
    per_customer = (
        fact.filter("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(
            F.max(is_sale & F.col("is_merchandise")).alias("bought_goods"),
            F.max(F.col("is_merchandise")).alias("any_goods"),
            F.max(is_sale).alias("any_sale"),
        )
    )
    return per_customer.agg(
        F.count("*").alias("customers"),
        F.count_if("bought_goods").alias("with_goods_sales"),
        F.count_if(~F.col("bought_goods")).alias("without_goods_sales"),
        F.count_if(~F.col("any_goods")).alias("only_non_goods"),
        F.count_if(~F.col("any_sale")).alias("only_reversals"),
    )


def matched_cancellations(fact: DataFrame, within_days: int = 1) -> DataFrame:
    """Cancellations that undo an earlier sale.

    A cancellation is matched to the latest sale with the same customer, code and
    opposite quantity at most ``within_days`` x 24 h before it. One row per
    customer, code, quantity and cancellation moment.

    Both sides are first folded to distinct moments. Each sale moment is then filed
    under its own time bucket and the next one, each cancellation under its own, so
    one pass over a bucket in time order finds the latest sale: no pairs are built
    and a busy key is split by time.
    """
    key = ["customer_id", "stock_code", "units"]
    bucket = F.floor(F.unix_date(F.to_date("invoice_date")) / within_days)

    def moments(line_type: str, sign: int) -> DataFrame:
        return (
            fact.filter(
                (F.col("line_type") == line_type)
                & F.col("customer_id").isNotNull()
                & (F.col("quantity") * sign > 0)
            )
            .groupBy("customer_id", "stock_code", F.abs("quantity").alias("units"), "invoice_date")
            .agg(F.max("invoice_no").alias("invoice_no"), F.count("*").alias("lines"))
            .withColumn("bucket", bucket)
        )

    sold = moments(C.SALE, 1).withColumns(
        {
            "bucket": F.explode(F.array("bucket", F.col("bucket") + 1)),
            "sale": F.struct("invoice_date", "invoice_no"),
        }
    )
    no_sale = F.lit(None).cast(sold.schema["sale"].dataType)
    undone = moments(C.CANCELLATION, -1).withColumn("sale", no_sale)
    in_time = (
        Window.partitionBy(*key, "bucket")
        .orderBy("invoice_date", F.col("sale").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    columns = [*key, "bucket", "invoice_date", "invoice_no", "lines", "sale"]
    seen = (
        sold.select(*columns)
        .unionByName(undone.select(*columns))
        .withColumn("latest", F.last("sale", ignorenulls=True).over(in_time))
        .filter("sale IS NULL AND latest IS NOT NULL")
    )
    sold_at, cancelled_at = F.col("latest.invoice_date"), F.col("invoice_date")
    reach = F.make_dt_interval(F.lit(within_days))
    return seen.filter(cancelled_at - sold_at <= reach).select(
        *key,
        F.col("invoice_no").alias("cancellation_no"),
        cancelled_at.alias("cancelled_at"),
        F.col("lines").alias("cancelled_lines"),
        F.col("latest.invoice_no").alias("sale_no"),
        sold_at.alias("sold_at"),
        C.whole_minutes(sold_at, cancelled_at).alias("minutes"),
    )
