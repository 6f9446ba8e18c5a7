"""One key holds a third of all lines: results match brute force in plain Python."""

import collections
import datetime as dt
import random

import pytest
from retail_rows import build_fact

from tillroll.operators import base, marts, reports
from tillroll.operators.clean import Cleaning
from tillroll.operators.slices import Slice
from tillroll.plans.context import Context
from tillroll.rules import Rules
from tillroll.sources import feed


@pytest.fixture(scope="module")
def lines():
    """900 lines; customer 1 and code HOT hold a third, often many invoices a day."""
    rng = random.Random(11)
    start = dt.datetime(2010, 1, 1)
    out = []
    for i in range(900):
        hot = i % 3 == 0
        minutes = rng.randrange(120 * 24 * 60) // (30 if hot else 1) * (30 if hot else 1)
        kind = rng.choice(["sale"] * 6 + ["cancellation", "return"])
        quantity = rng.randrange(1, 4) * (1 if kind == "sale" else -1)
        out.append(
            (
                f"{'C' if kind == 'cancellation' else ''}{i // 2}",
                1 if hot else rng.choice([None, *range(2, 40)]),
                "HOT" if hot else f"k{rng.randrange(30)}",
                (start + dt.timedelta(minutes=minutes)).isoformat(),
                quantity, rng.randrange(1, 500) / 100, kind, rng.random() < 0.95,
            )
        )
    return out


@pytest.fixture(scope="module")
def fact(spark, lines):
    return build_fact(spark, lines)


def sold(lines):
    return [line for line in lines if line[6] == "sale" and line[7] and line[1] is not None]


def test_gaps_by_moment(fact, lines):
    moments = collections.defaultdict(set)
    for line in sold(lines):
        moments[line[1]].add(dt.datetime.fromisoformat(line[3]))
    expected = sorted(
        (customer, (b - a).days)
        for customer, found in moments.items()
        for a, b in zip(sorted(found), sorted(found)[1:])
    )
    rows = Slice.of(fact).purchase_gap_days().collect()
    assert sorted((row.customer_id, row.gap_days) for row in rows) == expected


def test_gaps_by_day(fact, lines):
    invoices = collections.defaultdict(set)
    for line in sold(lines):
        invoices[line[1]].add((dt.datetime.fromisoformat(line[3]).date(), line[0]))
    gaps = [
        (b[0] - a[0]).days
        for found in invoices.values()
        for a, b in zip(sorted(found), sorted(found)[1:])
    ]
    card = marts.purchase_gaps(Context(fact)).first()
    assert card.gaps_observed == len(gaps)
    assert card.avg_gap_days == pytest.approx(sum(gaps) / len(gaps), abs=0.051)


def test_matched_cancellations(fact, lines):
    sales = collections.defaultdict(list)
    for line in lines:
        if line[6] == "sale" and line[1] is not None:
            sales[line[1], line[2], line[4]].append(dt.datetime.fromisoformat(line[3]))
    expected = {}
    for line in lines:
        if line[6] != "cancellation" or line[1] is None:
            continue
        at = dt.datetime.fromisoformat(line[3])
        before = [
            s for s in sales[line[1], line[2], -line[4]] if at - dt.timedelta(days=2) <= s <= at
        ]
        if before:
            expected[line[1], line[2], -line[4], at] = max(before)
    found = {
        (r.customer_id, r.stock_code, r.units, r.cancelled_at): r.sold_at
        for r in reports.matched_cancellations(fact, within_days=2).collect()
    }
    assert expected and found == expected


def test_first_month_and_cohorts(fact, lines):
    first = {}
    for line in sold(lines):
        month = dt.datetime.fromisoformat(line[3]).date().replace(day=1)
        first[line[1]] = min(first.get(line[1], month), month)
    assert {r.customer_id: r.first_month for r in base.first_month(fact).collect()} == first
    sizes = collections.Counter(first.values())
    cells = marts.cohort_retention(Context(fact)).filter("month_number = 0").collect()
    assert {r.cohort_month: r.cohort_size for r in cells} == dict(sizes)


def test_a_third_of_the_feed_is_one_line(spark):
    """Copies of one line, and null descriptions of one code."""
    at = "2010-01-01 10:00"
    rows = []
    for i in range(600):
        if i % 3 == 0:
            rows.append(("1", "HOT", f"text {i}", 1, at, 1.0, "7", "France", i))
        elif i % 3 == 1:
            rows.append((str(i), "GAP", None, 1, at, 1.0, "7", "France", i))
        else:
            rows.append((str(i), "GAP" if i < 4 else f"{i}", f"name {i}", 1, at, 1.0, "7", "Spain", i))
    columns = "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate string, Price double, `Customer ID` string, Country string, row_ord int"
    raw = feed.ingest([("skewed", spark.createDataFrame(rows, columns).repartition(7))])
    cleaning = Cleaning(raw, Rules())
    fact = cleaning.fact.collect()
    assert len(fact) == 401
    assert [r.description for r in fact if r.stock_code == "HOT"] == ["text 0"]
    assert {r.description for r in fact if r.stock_code == "GAP"} == {"name 2"}
    log = {r.rule: r.rows for r in cleaning.change_log().collect()}
    assert log["exact duplicates removed"] == 199
    assert log["description filled from stock_code"] == 200
