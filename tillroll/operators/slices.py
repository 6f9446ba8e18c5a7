"""Measures on any filtered slice of the fact.

``Slice.of(fact, rules, period=..., countries=...)`` cuts the lines; every method returns a
frame. What several steps of a method read, such as the orders of the slice, is staged while
the frame is built. Unlike the marts, ratios are not rounded here.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators import base
from tillroll.operators.gaps import elapsed_gap_counts, one_row_per_gap
from tillroll.operators.marts import by_country, calendar_back, with_labels
from tillroll.operators.scale import (
    compact_quantiles,
    distinct_rollup,
    exact_quantiles,
    running_total,
    share_of_total,
)
from tillroll.operators.selection import leaders
from tillroll.plans.staging import stage
from tillroll.rules import Rules


class Slice:
    def __init__(self, lines: DataFrame, rules: Rules | None = None):
        self.lines = lines
        self.rules = rules or Rules()

    @classmethod
    def of(cls, fact: DataFrame, rules: Rules | None = None, **filters) -> Slice:
        return cls(base.apply_filters(fact, **filters), rules)

    @property
    def sales(self) -> DataFrame:
        return base.sales(self.lines)

    @property
    def reversals(self) -> DataFrame:
        return base.reversals(self.lines)

    @cached_property
    def _orders(self) -> DataFrame:
        """One row per order and customer, staged once per slice."""
        return stage(base.order_rollup(self.sales), "slice-orders")

    # ------------------------------------------------------------ one-row cards
    def summary(self) -> DataFrame:
        """KPI card (D1). An empty slice has AOV 0 and no guest share."""
        money = F.col("line_revenue")
        is_sale = F.col("line_type") == C.SALE
        # one row per order and customer: the only scan of the lines
        per_order = self.lines.groupBy(
            F.when(is_sale, F.col("invoice_no")).alias("invoice_no"),
            F.when(is_sale, F.col("customer_id")).alias("customer_id"),
        ).agg(
            F.sum(F.when(is_sale, money)).alias("sold"),
            F.sum(F.when(~is_sale, money)).alias("reversed"),
            F.count_if(is_sale).alias("lines"),
            F.count_if(is_sale & F.col("is_guest")).alias("guest_lines"),
            F.sum(F.when(is_sale, F.col("quantity"))).alias("units"),
            F.count_if(F.col("line_type") == C.CANCELLATION).alias("cancellations"),
            F.count_if(F.col("line_type") == C.RETURN).alias("returns"),
        )
        per_order = stage(per_order, "slice-summary")
        added = ("sold", "reversed", "lines", "guest_lines", "units", "cancellations", "returns")
        invoices = stage(
            per_order.groupBy("invoice_no").agg(*(F.sum(n).alias(n) for n in added)), "slice-invoices"
        )
        orders = invoices.filter("invoice_no IS NOT NULL")
        median = exact_quantiles(orders, "sold", [0.5]).scalar()[0]
        customers = per_order.agg(F.count_distinct("customer_id")).scalar()
        zero = F.lit(0)
        return invoices.agg(
            F.coalesce(F.sum("sold"), zero).alias("sold"),
            F.coalesce(F.sum("reversed"), zero).alias("reversed"),
            F.sum(F.when(F.col("invoice_no").isNotNull(), F.col("sold"))).alias("invoiced"),
            F.count("invoice_no").alias("orders"),
            *(
                F.coalesce(F.sum(name), zero).alias(name)
                for name in ("lines", "guest_lines", "units", "cancellations", "returns")
            ),
        ).select(
            C.dbl(F.col("sold")).alias("revenue"),
            C.dbl(F.col("reversed")).alias("reversal_value"),
            C.dbl(F.col("sold") + F.col("reversed")).alias("net_revenue"),
            "orders",
            F.coalesce(C.ratio(F.col("invoiced"), F.col("orders")), F.lit(0.0)).alias("aov"),
            F.coalesce(median, F.lit(0.0)).alias("median_order"),
            customers.alias("customers"),
            C.ratio(F.col("guest_lines"), F.col("lines")).alias("guest_share"),
            "lines",
            "units",
            "cancellations",
            "returns",
        )

    def net_delta(self) -> DataFrame:
        """Net over gross revenue minus one; null where nothing was sold."""
        sold = F.sum(F.when(F.col("line_type") == C.SALE, F.col("line_revenue")))
        return self.lines.agg(
            (C.ratio(F.sum("line_revenue"), sold) - 1).alias("net_delta")
        )

    def repeat_stats(self) -> DataFrame:
        """Who bought again and how long they stayed (D13); no rows without customers.

        Purchases are distinct moments. The days run from the first to the last one.
        """
        per_customer = (
            self.sales.filter("customer_id IS NOT NULL")
            .groupBy("customer_id")
            .agg(
                F.count_distinct("invoice_date").alias("purchases"),
                C.whole_days(F.min("invoice_date"), F.max("invoice_date")).alias("days"),
            )
        )
        again = F.col("purchases") > 1
        days = compact_quantiles(per_customer.filter(again), "days", [0.5, 0.75]).scalar()
        rate = C.ratio(F.col("again"), F.col("customers"))
        return (
            per_customer.agg(
                F.count("*").alias("customers"),
                F.count_if(again).alias("again"),
                F.sum("purchases").alias("purchases"),
            )
            .filter("customers > 0")
            .select(
                "customers",
                rate.alias("repeat_rate"),
                (1 - rate).alias("one_time_share"),
                days[0].alias("median_gap_days"),
                days[1].alias("p75_gap_days"),
                C.ratio(F.col("purchases"), F.col("customers")).alias("avg_orders"),
            )
        )

    # ------------------------------------------------------------ by month
    def monthly(
        self, first_month: DataFrame | None = None, unrestricted: bool = False
    ) -> DataFrame:
        """Monthly dynamics with growth by calendar shift (D2). Months with sales only.

        ``first_month`` (customer_id, first_month) brings the whole history into a
        filtered slice; without it the slice is its own history. A customer is new
        in their first month if the slice shows them buying in it. With
        ``unrestricted`` every customer of ``first_month`` counts, even one this
        slice does not contain, and returning customers can then turn negative.
        """
        orders = self._orders
        pairs = (
            orders.filter("customer_id IS NOT NULL").select("customer_id", "month_start").distinct()
        )
        if first_month is None:
            first_month = pairs.groupBy("customer_id").agg(
                F.min("month_start").alias("first_month")
            )
        starts = first_month.select("customer_id", F.col("first_month").alias("month_start"))
        if not unrestricted:
            starts = starts.join(pairs, ["customer_id", "month_start"], "left_semi")
        newcomers = starts.groupBy("month_start").agg(F.count("*").alias("newcomers"))
        active = distinct_rollup(orders, ["month_start"], ["revenue", "units"])
        undone = self.reversals.groupBy("month_start").agg(
            F.sum("line_revenue").alias("reversed")
        )

        new = F.coalesce("newcomers", F.lit(0)).cast("bigint")
        reversed_ = F.coalesce("reversed", F.lit(0).cast("decimal(28,2)"))
        joined = active.join(newcomers, "month_start", "left").join(undone, "month_start", "left")
        return joined.select(
            "month_start",
            C.month_label(F.col("month_start")).alias("month"),
            C.dbl(F.col("revenue")).alias("revenue"),
            "orders",
            "customers",
            "units",
            new.alias("new_customers"),
            (F.col("customers") - new).alias("returning_customers"),
            C.ratio(F.col("revenue"), F.col("orders")).alias("aov"),
            C.ratio(F.col("revenue"), F.col("customers")).alias("revenue_per_customer"),
            C.dbl(reversed_).alias("reversal_value"),
            C.dbl(F.col("revenue") + reversed_).alias("net_revenue"),
            (C.ratio(F.col("revenue"), calendar_back("revenue", 1)) - 1).alias("mom_revenue"),
            (C.ratio(F.col("revenue"), calendar_back("revenue", 12)) - 1).alias("yoy_revenue"),
        )

    def cancellations_monthly(self) -> DataFrame:
        """Reversals per month that has any, against the slice's own sales."""
        undone = self.reversals.groupBy("month_start").agg(
            F.count_if(F.col("line_type") == C.CANCELLATION).alias("cancellations"),
            F.count_if(F.col("line_type") == C.RETURN).alias("returns"),
            F.sum("line_revenue").alias("reversed"),
        )
        sold = self.sales.groupBy("month_start").agg(F.sum("line_revenue").alias("sold"))
        return undone.join(sold, "month_start", "left").select(
            "month_start",
            C.month_label(F.col("month_start")).alias("month"),
            "cancellations",
            "returns",
            C.dbl(F.col("reversed")).alias("reversal_value"),
            C.dbl(F.col("sold")).alias("revenue"),
            C.ratio(-F.col("reversed"), F.col("sold")).alias("share_of_sales"),
        )

    # ------------------------------------------------------------ by place
    def country_rollup(self) -> DataFrame:
        """Turnover by country (D3); guest-only countries stay, without a repeat rate."""
        per_country = by_country(self._orders)
        return per_country.select(
            "country",
            C.dbl(F.col("revenue")).alias("revenue"),
            "orders",
            "customers",
            share_of_total(per_country, "revenue").alias("revenue_share"),
            "repeat_rate",
        )

    def top_countries(self, limit: int = 10) -> DataFrame:
        """The largest countries, shares and repeat rates in percent."""
        return (
            self.country_rollup()
            .orderBy(F.desc("revenue"), "country")
            .limit(limit)
            .select(
                "country",
                "revenue",
                "orders",
                "customers",
                C.rounded(F.col("revenue_share") * 100, 1).alias("revenue_share_pct"),
                C.rounded(F.col("repeat_rate") * 100, 1).alias("repeat_rate_pct"),
            )
        )

    def countries_by_revenue(self) -> DataFrame:
        """Countries and their sale revenue, for a filter list."""
        return self.sales.groupBy("country").agg(
            C.dbl(F.sum("line_revenue")).alias("revenue")
        )

    def region_monthly(self) -> DataFrame:
        """Turnover by market group and month."""
        orders = base.with_market_group(self._orders, self.rules)
        return distinct_rollup(orders, ["region", "month_start"], ["revenue"]).select(
            "region",
            C.month_label(F.col("month_start")).alias("month"),
            C.dbl(F.col("revenue")).alias("revenue"),
            "orders",
            "customers",
        )

    def region_totals(self) -> DataFrame:
        """Revenue and share by market group (E5)."""
        per_region = (
            base.with_market_group(self.sales, self.rules)
            .groupBy("region")
            .agg(F.sum("line_revenue").alias("revenue"))
        )
        return per_region.select(
            "region",
            C.dbl(F.col("revenue")).alias("revenue"),
            share_of_total(per_region, "revenue").alias("revenue_share"),
        )

    # ------------------------------------------------------------ by product
    def top_products(self, limit: int = 25, by: str = "revenue") -> DataFrame:
        """The top codes by revenue, units or orders (D5); labels only for the winners."""
        if by not in ("revenue", "units", "orders"):
            raise ValueError(f"cannot rank products by {by!r}")
        total = self.sales.agg(F.sum("line_revenue")).scalar()
        top = (
            self.sales.filter("stock_code IS NOT NULL")
            .groupBy("stock_code", "invoice_no")
            .agg(F.sum("line_revenue").alias("revenue"), F.sum("quantity").alias("units"))
            .groupBy("stock_code")
            .agg(
                F.sum("revenue").alias("revenue"),
                F.sum("units").alias("units"),
                F.count("invoice_no").alias("orders"),
            )
            .orderBy(F.desc(by), "stock_code")
            .limit(limit)
        )
        return with_labels(top, self.sales).select(
            "stock_code",
            "description",
            C.dbl(F.col("revenue")).alias("revenue"),
            "units",
            "orders",
            C.ratio(F.col("revenue"), F.col("units")).alias("avg_price"),
            C.ratio(F.col("revenue"), total).alias("revenue_share"),
        )

    def reversal_reasons(self, limit: int = 12) -> DataFrame:
        """Reversed money by description; non-goods share one bucket."""
        bucket = F.when(F.col("is_merchandise"), F.col("description")).otherwise(
            self.rules.labels.non_goods_reason
        )
        return (
            self.reversals.groupBy(bucket.alias("reason"))
            .agg(F.sum("line_revenue").alias("value"), F.count("*").alias("lines"))
            .orderBy("value", "reason")
            .limit(limit)
            .select("reason", C.dbl(F.col("value")).alias("value"), "lines")
        )

    # ------------------------------------------------------------ by customer
    def _customer_money(self) -> DataFrame:
        return (
            self.sales.filter("customer_id IS NOT NULL")
            .groupBy("customer_id")
            .agg(F.sum("line_revenue").alias("revenue"))
        )

    def customer_revenue(self) -> DataFrame:
        """Revenue, orders and first and last moment per known customer."""
        return (
            self.sales.filter("customer_id IS NOT NULL")
            .groupBy("customer_id")
            .agg(
                C.dbl(F.sum("line_revenue")).alias("revenue"),
                F.count_distinct("invoice_no").alias("orders"),
                F.min("invoice_date").alias("first_purchase"),
                F.max("invoice_date").alias("last_purchase"),
            )
        )

    def _by_money(self) -> DataFrame:
        return running_total(
            self._customer_money(), [F.desc("revenue"), F.asc("customer_id")], "revenue"
        )

    def pareto(self) -> DataFrame:
        """Customers by falling revenue with cumulative shares."""
        return self._shares(self._by_money())

    @staticmethod
    def _shares(ranked: DataFrame) -> DataFrame:
        return ranked.select(
            "customer_id",
            C.dbl(F.col("revenue")).alias("revenue"),
            C.ratio(F.col("revenue"), F.col("total")).alias("share"),
            C.ratio(F.col("cum"), F.col("total")).alias("cum_share"),
            "rank",
            C.ratio(F.col("rank"), F.col("rows")).alias("customer_share"),
        )

    def pareto_head(self, limit: int = 8) -> DataFrame:
        """The first rows of the Pareto table (N19): only ``limit`` of them are ranked."""
        money = stage(self._customer_money(), "customer-money")
        whole = money.agg(F.sum("revenue"), F.count("*"))
        total, rows = (whole.select(F.col(c)).scalar() for c in whole.columns)
        order = [F.desc("revenue"), F.asc("customer_id")]
        first = Window.orderBy(*order)  # over the rows kept by the limit
        head = money.orderBy(*order).limit(limit).withColumns(
            {
                "rank": F.row_number().over(first).cast("bigint"),
                "cum": F.sum("revenue").over(first.rowsBetween(Window.unboundedPreceding, 0)),
                "total": total,
                "rows": rows,
            }
        )
        return self._shares(head)

    def concentration(self, *targets: str) -> DataFrame:
        """Share of customers that holds each target share of revenue.

        Targets are decimal texts such as ``"0.8"``: they are compared exactly.
        """
        wanted = targets or ("0.8",)
        money = self._customer_money()
        found = leaders(money, "revenue", [Decimal(t) for t in wanted])
        if found is None:  # the sum of all is negative: count along the whole ranking
            return self._ranked_concentration(wanted)
        rows = [(float(t), n / found.rows if found.rows else None) for t, n in zip(wanted, found.needed)]
        return money.sparkSession.createDataFrame(rows, "target double, share_of_customers double")

    def _ranked_concentration(self, wanted: Sequence[str]) -> DataFrame:
        below = [
            F.count_if(F.col("cum") < F.col("total") * F.lit(t).cast("decimal(9,6)"))
            for t in wanted
        ]
        needed = [F.least(n + 1, F.count("*")) for n in below]
        rows = [
            F.struct(
                F.lit(float(t)).alias("target"),
                C.ratio(n, F.count("*")).alias("share_of_customers"),
            )
            for t, n in zip(wanted, needed)
        ]
        return self._by_money().agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))

    # ------------------------------------------------------------ between purchases
    def gap_counts(self) -> DataFrame:
        return elapsed_gap_counts(self.sales)

    def purchase_gap_days(self) -> DataFrame:
        """One row per gap between a customer's purchase moments."""
        return one_row_per_gap(self.gap_counts())

    def gap_quantiles(self) -> DataFrame:
        """Median and upper quartile of the gaps."""
        cuts = compact_quantiles(self.gap_counts(), "gap_days", [0.5, 0.75], weight="gaps")
        return cuts.select(
            F.col("quantiles")[0].alias("median_gap_days"),
            F.col("quantiles")[1].alias("p75_gap_days"),
        )

    def gap_histogram(self, longest: int = 365, width: int = 8) -> DataFrame:
        """Gaps in equal bins, the tail clipped into the last one."""
        clipped = F.least(F.col("gap_days"), F.lit(longest).cast("bigint"))
        start = (F.floor(clipped / width) * width).cast("bigint")
        return (
            self.gap_counts()
            .groupBy(start.alias("bin_start"))
            .agg(F.sum("gaps").alias("gaps"))
            .select("bin_start", (F.col("bin_start") + width).alias("bin_end"), "gaps")
        )

    # ------------------------------------------------------------ extent
    def extent(self) -> DataFrame:
        """First and last day, lines and invoices."""
        per_invoice = self.lines.groupBy("invoice_no").agg(
            F.count("*").alias("lines"),
            F.min("invoice_date").alias("first"),
            F.max("invoice_date").alias("last"),
        )
        return per_invoice.agg(
            F.to_date(F.min("first")).alias("first_day"),
            F.to_date(F.max("last")).alias("last_day"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
            F.count("invoice_no").alias("invoices"),
        )
