"""Shared relations of one fact, each derived once for all marts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import base
from tillroll.operators.rfm import score_customers
from tillroll.plans.staging import stage
from tillroll.rules import Rules


class Context:
    """A cleaned fact plus the relations several marts read.

    The order rollup and the per-customer base are staged on first use: at scale
    they are a small part of the line count, and every reader would otherwise scan
    and shuffle all lines again.
    """

    def __init__(self, fact: DataFrame, rules: Rules | None = None):
        self.fact = fact
        self.rules = rules or Rules()

    @property
    def sales_all(self) -> DataFrame:
        return base.sales_all(self.fact)

    @property
    def sales_id(self) -> DataFrame:
        return base.sales_id(self.fact)

    @property
    def all_lines(self) -> DataFrame:
        return base.all_lines(self.fact)

    @property
    def snapshot(self) -> DataFrame:
        return base.snapshot(self.fact)

    @cached_property
    def orders(self) -> DataFrame:
        """Goods sales by invoice, customer, country and day."""
        return stage(base.order_rollup(self.sales_all), "orders")

    @property
    def known_orders(self) -> DataFrame:
        return self.orders.filter("customer_id IS NOT NULL")

    @cached_property
    def customer_base(self) -> DataFrame:
        """Per known customer: recency, distinct orders, money, first and last day."""
        as_of = self.orders.agg(F.max("day")).scalar()
        per_customer = self.known_orders.groupBy("customer_id").agg(
            F.max("day").alias("last_purchase"),
            F.min("day").alias("first_purchase"),
            F.count_distinct("invoice_no").alias("frequency"),
            F.sum("revenue").alias("monetary"),
        )
        return stage(
            per_customer.withColumn(
                "recency_days", F.date_diff(as_of, "last_purchase").cast("bigint")
            ),
            "customers",
        )

    @cached_property
    def rfm(self) -> DataFrame:
        """Scored customers (C4); the segment mart and three reports read them too."""
        return stage(score_customers(self.customer_base, self.rules), "rfm")
