"""Audits on the fifteen-row feed and on lines the driver tables do not have."""

import datetime as dt

import pytest
from retail_rows import FIRST_HEADERS, build_fact

from tillroll.operators import audit, reports
from tillroll.operators.clean import Cleaning
from tillroll.operators.slices import Slice
from tillroll.rules import Rules
from tillroll.sources import feed

ODD = [
    ("1", "20725", "Red bag", 2, "2010-01-01 10:00", 1.25, 1.0, "EIRE"),
    ("1", "20725", "Red bag", 2, "2010-01-01 10:00", 1.25, 1.0, "EIRE"),
    ("2", "20725", "SMALL LACQUER TRAY", 1, "2010-01-01 11:00", 4.0, 2.0, "France"),
    ("2", "20725", "LACQUER TRAY, SMALL", 1, "2010-01-01 11:00", 4.0, 2.0, "France"),
    ("C3", "M", "Manual", 1, "2010-01-02 10:00", 373.57, None, "France"),
    ("C4", "M", "Manual", -1, "2010-01-02 10:00", 500.0, None, "France"),
    ("5", "gift", None, -3, "2010-01-02 10:00", 0.0, None, "Unspecified"),
    ("6", "85123a", "21494", 1, "2010-01-03 10:00", 2.5500000000000003, 3.0, "RSA"),
    ("7", "22111", "Carriage clock", 1, "2010-01-03 10:00", 12.5, 3.0, "RSA"),
    ("8", "C2", "CARRIAGE", 1, "2010-01-03 10:00", 50.0, 3.0, "RSA"),
    ("9", "C2", "CARRIAGE", 1, "2010-01-04 10:00", 50.0, 3.0, "RSA"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*row, position) for position, row in enumerate(ODD)]
    return feed.ingest([("odd", spark.createDataFrame(rows, FIRST_HEADERS))])


@pytest.fixture(scope="module")
def raw(raw_sources):
    return feed.ingest(raw_sources)


def test_source_profile(raw):
    found = {r.source: r for r in feed.source_profile(raw).collect()}
    assert (found["north"].rows, found["south"].rows) == (16, 3)
    assert found["south"].first_moment == dt.datetime(2012, 2, 8, 10)


def test_overlap(raw_sources):
    (_, north), _ = raw_sources
    both = feed.ingest([("a", north), ("b", north.filter("Invoice >= '70008'"))])
    days = {r.day: r.lines for r in audit.overlap_by_day(both).collect()}
    assert days[dt.date(2012, 2, 5)] == 4 and days[dt.date(2012, 2, 9)] == 2
    assert min(days) == dt.date(2012, 2, 4) and max(days) == dt.date(2012, 2, 9)


def test_duplicates(odd, raw):
    counts = audit.duplicate_counts(odd).first()
    assert (counts.by_all_columns, counts.by_business_key) == (1, 2)
    conflicts = audit.conflicting_duplicates(odd).collect()
    assert {r.description for r in conflicts} == {"SMALL LACQUER TRAY", "LACQUER TRAY, SMALL"}
    counts = audit.duplicate_counts(raw).first()
    assert (counts.by_all_columns, counts.by_business_key) == (2, 2)


def test_negative_lines(odd):
    split = audit.negative_split(odd).first()
    assert tuple(split) == (2, 1, 1, 2)
    (line,) = audit.positive_cancellations(odd).collect()
    assert (line.invoice_no, line.quantity) == ("C3", 1)


def test_returns_without_price(raw):
    card = audit.return_price_audit(raw).first()
    assert (card.return_lines, card.zero_price_lines) == (2, 1)
    assert (card.value, card.units) == (-15.0, -36)


def test_nonstandard_codes(odd):
    found = {r.stock_code: r for r in audit.nonstandard_codes(odd).collect()}
    assert set(found) == {"M", "gift", "85123a", "C2"}
    assert found["gift"].description == "-"
    assert (found["M"].lines, found["M"].amount) == (2, -126.43)
    top = audit.nonstandard_codes(odd, limit=1).collect()
    assert [r.stock_code for r in top] == ["M"]


def test_words(odd):
    found = {(r.word, r.place): r for r in audit.word_audit(odd).collect()}
    assert found["carriage", 1].lines == 3
    assert (found["carriage", 1].description, found["carriage", 1].description_lines) == ("CARRIAGE", 2)
    assert found["carriage", 2].description == "Carriage clock"
    assert found["wrapping", None].lines == 0


def test_numeric_descriptions(odd):
    (line,) = audit.numeric_descriptions(odd).collect()
    assert line.description == "21494"


def test_nulls(odd):
    found = {r.column_name: (r.nulls, r.percent) for r in audit.null_profile(odd).collect()}
    assert found == {"description": (1, 9.1), "customer_id": (3, 27.3)}


def test_countries(odd):
    found = {r.country: r for r in audit.country_audit(odd).collect()}
    assert set(found) == {"EIRE", "RSA", "Unspecified"}
    assert found["RSA"].lines == 4 and found["RSA"].countries_in_feed == 4


def test_code_types(odd):
    profile = audit.code_type_profile(odd).first()
    assert (profile.numeric_invoices, profile.text_invoices) == (9, 2)
    assert (profile.numeric_codes, profile.text_codes, profile.codes_not_upper) == (5, 6, 2)


def test_price_noise(odd):
    noise = audit.price_noise(odd).first()
    assert (noise.noisy_lines, noise.example_price) == (1, 2.5500000000000003)


def test_before_after(odd):
    cards = {
        r.state: r for r in audit.before_after(odd, Cleaning(odd, Rules()).fact).collect()
    }
    assert (cards["raw"].lines, cards["cleaned"].lines) == (11, 9)
    assert (cards["raw"].invoices, cards["raw"].customers) == (9, 3)
    # two bags once, one bunting, the odd code and the clock
    assert cards["cleaned"].revenue == 2.5 + 4.0 + 2.55 + 12.5


def test_customer_coverage(spark):
    lines = [
        ("A", 1, "x", "2010-01-01 09:00", 1, 1.0, "sale", True),
        ("B", 2, "POST", "2010-01-01 09:00", 1, 1.0, "sale", False),
        ("C", 3, "x", "2010-01-01 09:00", -1, 1.0, "cancellation", True),
        ("D", None, "x", "2010-01-01 09:00", 1, 1.0, "sale", True),
    ]
    card = reports.customer_coverage(build_fact(spark, lines)).first()
    assert tuple(card) == (3, 1, 2, 1, 1)


def test_gap_histogram_clips_the_tail(spark):
    lines = [
        ("A", 1, "x", "2009-01-01 09:00", 1, 1.0, "sale", True),
        ("B", 1, "x", "2009-01-10 09:00", 1, 1.0, "sale", True),
        ("C", 1, "x", "2011-01-10 09:00", 1, 1.0, "sale", True),
    ]
    bins = {r.bin_start: r.gaps for r in Slice.of(build_fact(spark, lines)).gap_histogram().collect()}
    assert bins == {8: 1, 360: 1}


def test_sample_is_repeatable(spark):
    scores = spark.range(100).selectExpr(
        "id AS customer_id", "id AS recency_days", "1.0D AS monetary", "'core' AS segment"
    )
    first = sorted(r.customer_id for r in reports.rfm_sample(scores, 10).collect())
    again = sorted(r.customer_id for r in reports.rfm_sample(scores.repartition(7), 10).collect())
    assert first == again and len(first) == 10
    other = sorted(r.customer_id for r in reports.rfm_sample(scores, 10, seed=8).collect())
    assert other != first


def test_absent_values_do_not_stand_for_each_other(spark):
    """Fingerprints of lines whose values differ only in where they are missing."""
    rows = [
        ("5", "X", None, 1, "2011-01-01 10:00", 1.0, None, "France"),
        ("5", "X", "X", 1, "2011-01-01 10:00", 1.0, None, "France"),
        ("5", None, "X", 1, "2011-01-01 10:00", 1.0, None, "France"),
        ("5", None, "X", 1, "2011-01-01 10:00", 1.0, None, "France"),
        (None, "5", "X", 1, "2011-01-01 10:00", 1.0, None, "France"),
    ]
    headers = FIRST_HEADERS.rsplit(",", 1)[0]
    raw = feed.ingest([("s", spark.createDataFrame(rows, headers))])
    assert tuple(audit.duplicate_counts(raw).first()) == (1, 2)
    found = audit.conflicting_duplicates(raw).collect()
    assert {(r.stock_code, r.description) for r in found} == {("X", None), ("X", "X")}
    assert len(found) == 2
