"""Order statistics and shares of a sum without sorting, by refining histograms.

A pass counts values into bins, combined on the map side; a search goes on only in the bin that
holds what is wanted. The first pass bins by sign and power of two, later ones cut the occupied part
of a bin into ``BINS`` equal parts, and a span of at most ``LISTED`` rows is listed by value. So a
search takes a few counting passes whatever the number of rows or distinct values, equal values cost
nothing, and at most a fixed number of bins comes to the driver. Results are exact.

Values are whole numbers or decimals; decimals are taken as whole numbers of their last place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.staging import stage

BINS = 8192
LISTED = 8192
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SUM = "decimal(38,0)"


def places(kind: T.DataType) -> int | None:
    """Decimal places of a type that can be searched; None if it cannot."""
    if isinstance(kind, T.DecimalType):
        return kind.scale
    return 0 if isinstance(kind, _WHOLE) else None


def keys(df: DataFrame, value: str, weight: str | None = None, falling: bool = False) -> DataFrame:
    """(key, n): values as whole numbers, negated if ``falling``; nulls are left out. Staged."""
    scale = places(df.schema[value].dataType)
    if scale is None:
        raise TypeError(f"{value} is neither whole nor decimal")
    unit = F.lit(Decimal(10**scale)) if scale else F.lit(1)
    key = (F.col(value) * unit).cast("bigint")
    n = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    chosen = df.filter(F.col(value).isNotNull())
    return stage(chosen.select((-key if falling else key).alias("key"), n.alias("n")), "keys")


@dataclass
class Group:
    """Neighbouring values: first and last key, rows and sum inside and before it."""

    least: int
    most: int
    rows: int
    total: int
    rows_before: int = 0
    total_before: int = 0


def _tally(keyed: DataFrame, span: Column, bin_: Column, sums: bool) -> dict[int, list[Group]]:
    total = F.sum(F.col("key").cast("decimal(20,0)") * F.col("n")) if sums else F.lit(0)
    found = (
        keyed.withColumns({"_span": span, "_bin": bin_})
        .filter("_span IS NOT NULL")
        .groupBy("_span", "_bin")
        .agg(
            F.min("key").alias("least"), F.max("key").alias("most"), F.sum("n").alias("rows"),
            total.cast(_SUM).alias("total"),
        )
    )
    groups: dict[int, list[Group]] = {}
    for r in found.collect():  # BINS or LISTED rows per span, two spans per wanted place
        groups.setdefault(r["_span"], []).append(Group(r.least, r.most, r["rows"], int(r.total)))
    for own in groups.values():
        own.sort(key=lambda g: g.least)
    return groups


def overview(keyed: DataFrame, sums: bool = False) -> list[Group]:
    """All keys by sign and power of two, in order."""
    size = F.length(F.bin(F.abs(F.col("key"))))
    found = _tally(keyed, F.lit(0), F.signum("key").cast("int") * size, sums).get(0, [])
    return _running(found, 0, 0)


def _running(groups: list[Group], rows: int, total: int) -> list[Group]:
    for g in groups:
        g.rows_before, g.total_before = rows, total
        rows, total = rows + g.rows, total + g.total
    return groups


def search(
    keyed: DataFrame,
    groups: list[Group],
    holds: Sequence[Callable[[Group], bool]],
    sums: bool = False,
) -> list[Group | None]:
    """For each condition the single value whose group is the first to meet it.

    ``groups`` come from :func:`overview`. If a group of neighbours meets a condition, one of its
    values has to; that value is sought by cutting the group up.
    """

    def first(own: list[Group], wanted: Callable[[Group], bool]) -> Group | None:
        return next((g for g in own if wanted(g)), None)

    found = [first(groups, wanted) for wanted in holds]
    key = F.col("key")
    while open_ := list({g.least: g for g in found if g and g.least < g.most}.values()):
        inside = [key.between(g.least, g.most) for g in open_]
        span = reduce(lambda a, i: a.when(inside[i], i), range(1, len(open_)), F.when(inside[0], 0))

        def cut(g: Group) -> Column:
            width = 1 if g.rows <= LISTED else -(-(g.most - g.least + 1) // BINS)
            return F.floor((key - F.lit(g.least)) / F.lit(width)) if width > 1 else key

        bin_ = reduce(
            lambda a, i: a.when(inside[i], cut(open_[i])), range(1, len(open_)), F.when(inside[0], cut(open_[0]))
        )
        parts = _tally(keyed, span, bin_, sums)
        for i, g in enumerate(open_):
            own = _running(parts[i], g.rows_before, g.total_before)
            found = [
                first(own, wanted) if old and old.least == g.least and old.most == g.most else old
                for old, wanted in zip(found, holds)
            ]
    return found


def quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], weight: str | None = None
) -> list[float] | None:
    """Linear interpolation between the ranks around each probability; None without values."""
    keyed = keys(df, value, weight)
    groups = overview(keyed)
    rows = groups[-1].rows_before + groups[-1].rows if groups else 0
    if not rows:
        return None
    at = [(rows - 1) * float(p) for p in probabilities]
    ranks = sorted({int(x) for x in at} | {min(rows - 1, int(x) + (x > int(x))) for x in at})
    holds = [lambda g, r=r: g.rows_before <= r < g.rows_before + g.rows for r in ranks]
    unit = 10 ** places(df.schema[value].dataType)
    of = {r: g.least / unit for r, g in zip(ranks, search(keyed, groups, holds))}
    out = []
    for x in at:
        low, part = of[int(x)], x - int(x)
        out.append(low + (of[int(x) + 1] - low) * part if part else low)
    return out


@dataclass
class Leaders:
    """How many of the largest values reach each share of the sum; rows in all."""

    rows: int
    needed: list[int]


def leaders(df: DataFrame, value: str, shares: Sequence[Decimal]) -> Leaders | None:
    """The fewest largest values whose sum is at least each share of the total.

    None if the total is negative: prefix sums then pass a share more than once. A share above
    one is never reached and needs all rows.
    """
    keyed = keys(df, value, falling=True)
    groups = overview(keyed, sums=True)
    if not groups:
        return Leaders(0, [0] * len(shares))
    last = groups[-1]
    rows, total = last.rows_before + last.rows, -(last.total_before + last.total)
    if total < 0:
        return None
    goals = [Fraction(s) * total for s in shares]
    # the first value already reaches nothing, so that only positive values are searched
    holds = [lambda g, t=t: -(g.total_before + g.total) >= t for t in goals]
    found = search(keyed, groups, holds, sums=True)
    needed = []
    for goal, g in zip(goals, found):
        if g is None:
            needed.append(rows)
        elif goal + g.total_before <= 0:  # reached by whatever comes first
            needed.append(g.rows_before + 1)
        else:
            needed.append(g.rows_before + ceil((goal + g.total_before) / -g.least))
    return Leaders(rows, needed)
