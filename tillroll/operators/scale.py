"""Building blocks for steps that plain Spark would pull into one task.

* :func:`running_total` - global rank and running sum without a one-partition sort
* :func:`exact_quantiles` - interpolated quantiles, any number of values, no sort
* :func:`compact_quantiles` - the same for days and counts, in one aggregate
* :func:`most_common` - mode per key from counts, safe for hot keys
* :func:`salted_left_join` - lookups whose big side may hold a hot key
* :func:`distinct_rollup` - orders and customers per group without multiplying rows
* :func:`share_of_total` - share of a whole-table total without an empty window
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators import selection
from tillroll.plans.staging import stage

SALTS = 32


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """Add ``rank``, ``cum`` (running sum of ``value`` in ``order``), ``rows`` and ``total``.

    1. Range-split the rows on the whole order. Ties on the value are split by the
       later order columns, so no single value can fill one range.
    2. Stage the split rows: sampled range borders must not move between reads.
    3. Sum and count every range - one row per range - and turn those into offsets.
    4. Add the offset to a running sum inside each range.

    ``order`` must be unique per row and list columns of ``df``. With exact
    ``value`` types (decimal, integer) the result equals a one-partition window.
    """
    split = stage(
        df.repartitionByRange(_partitions(df), *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    per_range = split.groupBy("_range").agg(
        F.sum(value).alias("_sum"), F.count("*").alias("_rows")
    )
    # one row per range from here on: windows over them and a broadcast are safe
    whole = Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_sum").over(whole).alias("total"),
        F.sum("_rows").over(whole).alias("rows"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        split.join(F.broadcast(offsets), "_range")
        .withColumns(
            {
                "rank": (F.col("_rows_before") + F.row_number().over(inside)).cast("bigint"),
                "cum": F.col("_sum_before") + F.sum(value).over(up_to_here),
            }
        )
        .drop("_range", "_sum_before", "_rows_before")
    )


def _value_counts(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    rows = F.sum(weight) if weight else F.count("*")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("_value"))
        .agg(rows.alias("_n"))
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], weight: str | None = None
) -> DataFrame:
    """One row ``quantiles array<double>``: linear interpolation between ranks.

    Money and whole numbers are found by refining histograms (``selection``): no sort, and
    neither rows nor distinct values have to fit anywhere. Other numbers are ranked as
    (value, count) pairs. Nulls are ignored; no values -> null.
    """
    if selection.places(df.schema[value].dataType) is None:
        return _ranked_quantiles(df, value, probabilities, weight)
    found = selection.quantiles(df, value, probabilities, weight)
    cuts = F.array(*(F.lit(x) for x in found)) if found else F.lit(None)
    return df.sparkSession.range(1).select(cuts.cast("array<double>").alias("quantiles"))


def _ranked_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], weight: str | None
) -> DataFrame:
    ranked = running_total(_value_counts(df, value, weight), [F.col("_value")], "_n")

    def near(p: float, edge) -> Column:
        """The value whose ranks cover the position just below or above ``p``."""
        position = edge((F.col("total") - 1) * float(p))
        hit = (F.col("cum") - F.col("_n") <= position) & (position < F.col("cum"))
        return F.max(F.when(hit, C.dbl(F.col("_value"))))

    parts = [F.max("total").alias("_total")]
    for i, p in enumerate(probabilities):
        parts += [near(p, F.floor).alias(f"_lo{i}"), near(p, F.ceil).alias(f"_hi{i}")]

    def between(i: int, p: float) -> Column:
        position = (F.col("_total") - 1) * float(p)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return low + (high - low) * (position - F.floor(position))

    cuts = F.array(*(between(i, p) for i, p in enumerate(probabilities)))
    return ranked.agg(*parts).select(
        F.when(F.col("_total").isNotNull(), cuts).alias("quantiles")
    )


def compact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], weight: str | None = None
) -> DataFrame:
    """:func:`exact_quantiles` for measures with few distinct values.

    Whole days are bounded by the calendar. Order counts are bounded by their own
    sum: d different counts need at least d(d+1)/2 orders, so 10^12 orders cannot
    show more than 1.5 million. The built-in exact percentile over (value, count)
    pairs then needs no ranking; money must use :func:`exact_quantiles`.
    """
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    return _value_counts(df, value, weight).agg(
        F.percentile("_value", wanted, F.col("_n")).alias("quantiles")
    )


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null ``value`` per key; ties go to the smallest value.

    Counts first, so a hot key arrives at its reducer as one row per distinct value
    and map task, and the winner is an ordinary minimum with map-side combine.
    """
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    )
    best = F.min_by(value, F.struct(-F.col("_n"), F.col(value)))
    return counted.groupBy(*keys).agg(best.alias(value))


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    salts: int = SALTS,
    hint: str | None = None,
) -> DataFrame:
    """Look up ``right`` (one row per key) for every row of ``left``; one key may hold most of it.

    Left rows of a key are spread by the hash of ``spread`` over ``salts``; each right row is
    repeated once per salt. Null keys match each other. A large ``right`` needs a join ``hint``:
    its estimated size leaves the repetition out.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts))).alias("l")
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    repeated = right.withColumn("_salt", F.explode(every)).alias("r")
    repeated = repeated.hint(hint) if hint else repeated
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_salt"]]
    joined = salted.join(repeated, reduce(Column.__and__, same), "left")
    extra = [c for c in right.columns if c not in keys]
    return joined.select(
        *(F.col(f"l.{c}") for c in left.columns), *(F.col(f"r.{c}") for c in extra)
    )


def distinct_rollup(
    df: DataFrame,
    group: Sequence[str],
    sums: Sequence[str] = (),
    least: Sequence[str] = (),
    most: Sequence[str] = (),
) -> DataFrame:
    """Per ``group``: ``orders`` and ``customers`` (distinct, nulls apart), and ``repeaters``.

    Repeaters are known customers with two orders or more in the group. ``sums``, ``least`` and
    ``most`` name columns to add up or take the extreme of.

    Several distinct counts in one aggregate would multiply every row and shuffle each copy. Here
    rows are dealt by (group, order) once: that puts all rows of an order together, so the first
    of them can stand for it. From there on orders are a plain sum, and the rows of a customer,
    summed on the map side, are the customers of the group.
    """

    def added() -> list[Column]:
        return [
            *(F.sum(n).alias(n) for n in sums), *(F.min(n).alias(n) for n in least),
            *(F.max(n).alias(n) for n in most),
        ]

    order = [*group, "invoice_no"]
    columns = dict.fromkeys([*order, "customer_id", *sums, *least, *most])
    per_order = (
        df.select(*columns).repartition(*order).groupBy(*order, "customer_id").agg(*added())
    )
    place = F.row_number().over(Window.partitionBy(*order).orderBy("customer_id"))
    per_customer = (
        per_order.withColumn("_first", (place == 1) & F.col("invoice_no").isNotNull())
        .groupBy(*group, "customer_id")
        .agg(*added(), F.count_if("_first").alias("_orders"), F.count("invoice_no").alias("_own"))
    )
    known = F.col("customer_id").isNotNull()
    return per_customer.groupBy(*group).agg(
        *added(),
        F.coalesce(F.sum("_orders"), F.lit(0)).alias("orders"),
        F.count("customer_id").alias("customers"),
        F.count_if(known & (F.col("_own") > 1)).alias("repeaters"),
    )


def share_of_total(df: DataFrame, part: str) -> Column:
    """``part`` over its whole-table sum; the sum is a scalar subquery, one value."""
    return C.ratio(F.col(part), df.agg(F.sum(part)).scalar())
