"""Scale building blocks against the plain form, on data with one hot value."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators.scale import (
    compact_quantiles,
    distinct_rollup,
    exact_quantiles,
    most_common,
    running_total,
    salted_left_join,
)

PROBABILITIES = [0.0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 1.0]


@pytest.fixture(scope="module")
def money(spark):
    """2,000 customers; a third of them spent the same amount."""
    rng = random.Random(3)
    rows = [
        (i, Decimal("9.99") if i % 3 == 0 else Decimal(rng.randrange(1, 100_000)) / 100)
        for i in range(2000)
    ]
    return spark.createDataFrame(rows, "id long, amount decimal(18,2)")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_total_equals_one_window(money):
    order = [F.desc("amount"), F.asc("id")]
    whole = Window.orderBy(*order)
    plain = money.select(
        "id",
        F.row_number().over(whole).cast("long").alias("rank"),
        F.sum("amount").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
    )
    ours = running_total(money, order, "amount")
    assert sorted(ours.select("id", "rank", "cum").collect()) == sorted(plain.collect())
    first = ours.first()
    assert first.rows == 2000
    assert first.total == money.agg(F.sum("amount")).first()[0]


def test_a_hot_value_is_split_over_ranges(money):
    """Ties are cut by the later order columns, not kept in one range."""
    split = money.repartitionByRange(4, F.desc("amount"), F.asc("id"))
    per_range = split.groupBy(F.spark_partition_id()).agg(
        F.count("*").alias("n"), F.count_if(F.col("amount") == Decimal("9.99")).alias("hot")
    )
    sizes = per_range.collect()
    assert max(row.n for row in sizes) < 1000
    assert sum(row.hot > 0 for row in sizes) > 1


def test_running_total_sorts_no_rows_in_one_partition(money):
    plan = executed(running_total(money, [F.desc("amount"), F.asc("id")], "amount"))
    # the only single partition holds one row per range
    assert plan.count("SinglePartition") == 1
    assert plan.index("SinglePartition") < plan.index("functions=[sum(amount")


@pytest.mark.parametrize("size", [1, 2, 5, 6, 11, 2000])
def test_exact_quantiles_equal_percentile(money, size):
    some = money.filter(F.col("id") < size)
    wanted = F.array(*(F.lit(p) for p in PROBABILITIES))
    plain = some.agg(F.percentile(F.col("amount").cast("double"), wanted)).first()[0]
    assert exact_quantiles(some, "amount", PROBABILITIES).first()[0] == pytest.approx(
        plain, rel=1e-12
    )


def test_quantiles_with_weights_and_nulls(spark):
    counted = spark.createDataFrame([(1, 3), (5, 1), (9, 2), (None, 7)], "v long, n long")
    spread = spark.createDataFrame([(v,) for v in (1, 1, 1, 5, 9, 9)], "v long")
    for quantiles in (exact_quantiles, compact_quantiles):
        weighted = quantiles(counted, "v", PROBABILITIES, weight="n").first()[0]
        assert weighted == pytest.approx(quantiles(spread, "v", PROBABILITIES).first()[0])


def test_quantiles_of_nothing(money):
    none = money.filter("id < 0")
    assert exact_quantiles(none, "amount", [0.5]).first()[0] is None
    assert compact_quantiles(none, "id", [0.5]).first()[0] is None


def test_most_common_breaks_ties_by_value(spark):
    rows = [("a", "z"), ("a", "b"), ("a", None), ("b", "q"), ("b", "q"), ("b", "a"), ("c", None)]
    found = most_common(spark.createDataFrame(rows, "k string, v string"), ["k"], "v")
    assert {row.k: row.v for row in found.collect()} == {"a": "b", "b": "q"}


def test_salted_join_equals_plain_join(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(600)]
    left = spark.createDataFrame(rows, "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    plain = left.join(right, "k", "left").select("id", "k", "v").collect()
    salted = salted_left_join(left, right, ["k"], spread=["id"])
    assert sorted(salted.collect(), key=repr) == sorted(plain, key=repr)


def test_salts_spread_a_hot_key(spark):
    left = spark.range(1000).withColumn("k", F.lit("hot"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = salted_left_join(left, right, ["k"], spread=["id"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and joined.filter("v = 1").count() == 1000


def test_distinct_rollup_equals_distinct_counts(spark):
    """Orders of several customers and groups, a hot customer, guests, absent orders."""
    rng = random.Random(12)
    rows = [
        (rng.choice("abc") if rng.random() < 0.95 else None,
         f"o{rng.randrange(60)}" if rng.random() < 0.97 else None,
         1 if rng.random() < 0.4 else rng.choice([None, *range(2, 30)]),
         Decimal(rng.randrange(100)), rng.randrange(9))
        for _ in range(900)
    ]
    df = spark.createDataFrame(rows, "g string, invoice_no string, customer_id long, m decimal(9,2), d int")
    found = distinct_rollup(df.repartition(5), ["g"], ["m"], ["d"])
    plan = executed(found)
    # dealt once by order, then summed per customer and per group
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 3
    plain = df.groupBy("g").agg(
        F.sum("m").alias("m"), F.min("d").alias("d"), F.count_distinct("invoice_no").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
    )
    per = df.filter("customer_id IS NOT NULL").groupBy("g", "customer_id").agg(F.count_distinct("invoice_no").alias("n"))
    again = per.groupBy("g").agg(F.count_if(F.col("n") > 1).alias("repeaters"))
    want = plain.join(again, plain.g.eqNullSafe(again.g)).select(plain.g, "m", "d", "orders", "customers", "repeaters")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    whole = distinct_rollup(df, [], ["m"]).first()
    assert (whole.orders, whole.customers) == tuple(
        df.agg(F.count_distinct("invoice_no"), F.count_distinct("customer_id")).first()
    )
    none = distinct_rollup(df.limit(0), [], ["m"]).first()
    assert (none.m, none.orders, none.customers) == (None, 0, 0)
