"""Recency, frequency and money scores by shared thresholds (C4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators.scale import compact_quantiles, exact_quantiles
from tillroll.rules import Rules

# --- fixed values: score borders ------------------------------------------------
SCORE_QUANTILES: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)


def _cuts_passed(customers: DataFrame, measure: str, quantiles=compact_quantiles) -> Column:
    """How many of the four cuts a customer strictly exceeds, 0-4."""
    cuts = quantiles(customers, measure, SCORE_QUANTILES).scalar()
    passed = [
        (C.dbl(F.col(measure)) > cuts[i]).cast("int") for i in range(len(SCORE_QUANTILES))
    ]
    return reduce(Column.__add__, passed)


def segment_of(r: Column, f: Column, m: Column, rules: Rules) -> Column:
    names = rules.labels
    recent, lapsed = r >= 4, r <= 2
    return (
        F.when(recent & (f >= 4) & (m >= 4), names.core)
        .when(recent & (f >= 3), names.loyal)
        .when(recent, names.fresh)
        .when(~lapsed & (f >= 3), names.cooling)
        .when(lapsed & (m >= 4), names.costly_churn)
        .when(lapsed, names.churn)
        .otherwise(names.other)
    )


def score_customers(customers: DataFrame, rules: Rules) -> DataFrame:
    """Score every customer against the same cuts: equal customers, equal scores."""
    scored = customers.select(
        "*",
        (5 - _cuts_passed(customers, "recency_days")).alias("r_score"),
        (1 + _cuts_passed(customers, "frequency")).alias("f_score"),
        (1 + _cuts_passed(customers, "monetary", exact_quantiles)).alias("m_score"),
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "customer_id",
        "recency_days",
        "frequency",
        C.dbl(F.col("monetary")).alias("monetary"),
        "first_purchase",
        "last_purchase",
        "r_score",
        "f_score",
        "m_score",
        C.rounded(C.ratio(F.col("monetary"), F.col("frequency")), 2).alias("avg_order_value"),
        (r + f + m).alias("rfm_score"),
        segment_of(r, f, m, rules).alias("segment"),
    )
