"""Histogram selection against sorting: skewed, constant, huge, negative and empty values."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tillroll.operators import selection
from tillroll.operators.scale import exact_quantiles
from tillroll.operators.slices import Slice

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0]


def draws(kind, n=1500, seed=5):
    rng = random.Random(seed)
    return {
        "constant": lambda: [250] * n,
        "skewed": lambda: [999 if i % 3 == 0 else rng.randrange(1, 10**6) for i in range(n)],
        "signed": lambda: [rng.randrange(-(10**4), 10**5) for _ in range(n)],
        "wide": lambda: [int(10 ** rng.uniform(0, 16)) for _ in range(n)],
        "edges": lambda: [0, -1, 1, 2**62, -(2**62), 2**62 - 1, 0],
        "negative": lambda: [-rng.randrange(1, 500) for _ in range(n)],
        "zero": lambda: [0] * 7,
        "one": lambda: [42],
    }[kind]()


KINDS = ["constant", "skewed", "signed", "wide", "edges", "negative", "zero", "one"]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in [*values, None]], "v long").repartition(3)


@pytest.fixture(params=[(8192, 8192), (4, 1), (16, 5)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(selection, "BINS", request.param[0])
    monkeypatch.setattr(selection, "LISTED", request.param[1])


@pytest.mark.parametrize("kind", KINDS)
def test_quantiles_equal_sorting(spark, kind, sizes):
    values = sorted(draws(kind))
    want = []
    for p in PROBABILITIES:
        at = (len(values) - 1) * p
        low = values[int(at)]
        high = values[min(len(values) - 1, int(at) + 1)]
        want.append(float(low) + (float(high) - float(low)) * (at - int(at)))
    assert selection.quantiles(frame(spark, values), "v", PROBABILITIES) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("kind", [k for k in KINDS if k not in ("negative", "edges")])
def test_leaders_equal_running_sum(spark, kind, sizes):
    values = sorted(draws(kind), reverse=True)
    shares = [Decimal(s) for s in ("0", "0.001", "0.5", "0.8", "1", "1.5")]
    want = []
    for share in shares:
        goal, cum, need = Fraction(share) * sum(values), 0, len(values)
        for i, v in enumerate(values, 1):
            cum += v
            if cum >= goal:
                need = i
                break
        want.append(need)
    found = selection.leaders(frame(spark, values), "v", shares)
    assert (found.rows, found.needed) == (len(values), want)


def test_leaders_of_nothing_and_of_losses(spark):
    assert selection.leaders(frame(spark, []), "v", [Decimal("0.5")]).needed == [0]
    assert selection.leaders(frame(spark, [-5, 2]), "v", [Decimal("0.5")]) is None


def test_decimals_keep_their_places(spark):
    money = [Decimal(c).scaleb(-2) for c in (1, 199, 200, 10**17)]
    df = spark.createDataFrame([(m, 2) for m in money], "m decimal(28,2), n long")
    assert selection.quantiles(df, "m", [0.0, 0.5, 1.0], "n") == [0.01, 1.995, 1e15]
    with pytest.raises(TypeError):
        selection.keys(df.select(F.col("m").cast("double").alias("m")), "m")


def test_doubles_are_still_ranked(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (None,)], "v double")
    assert exact_quantiles(df, "v", [0.5]).first()[0] == pytest.approx([0.2])


def test_plan_has_no_sort(spark, monkeypatch):
    """Every pass is one hash aggregate over the staged keys."""
    seen = []
    tally = selection._tally

    def watched(keyed, span, bin_, sums):
        found = keyed.withColumns({"_span": span, "_bin": bin_}).groupBy("_span", "_bin").agg(F.sum("n"))
        seen.append(found._jdf.queryExecution().executedPlan().toString())
        return tally(keyed, span, bin_, sums)

    monkeypatch.setattr(selection, "_tally", watched)
    selection.quantiles(frame(spark, draws("wide")), "v", PROBABILITIES)
    assert len(seen) <= 8
    for plan in seen:
        assert "Sort" not in plan and "rangepartitioning" not in plan and "HashAggregate" in plan


def test_concentration_of_losses_counts_along_the_ranking(spark):
    from retail_rows import build_fact

    lines = [
        ("1", 1, "p", "2013-05-03 10:00", 1, 5.0, "sale", True),
        ("2", 2, "p", "2013-05-03 10:00", 1, -9.0, "sale", True),
    ]
    found = Slice.of(build_fact(spark, lines)).concentration("0.5")
    assert [tuple(r) for r in found.collect()] == [(0.5, 1.0)]
