"""Cleaning rules on a small two-source feed and on edge cases."""

import datetime as dt
from decimal import Decimal

import pytest
from retail_rows import FIRST_HEADERS, NORTH, SOUTH, numbered
from pyspark.sql import functions as F

from tillroll.functions.columns import whole_number
from tillroll.operators.clean import Cleaning, fact_summary, keep_first_copy
from tillroll.rules import Rules
from tillroll.schema import FACT_COLUMNS, RAW_COLUMNS
from tillroll.sources import feed


@pytest.fixture(scope="module")
def cleaning(raw_sources):
    return Cleaning(feed.ingest(raw_sources), Rules())


@pytest.fixture(scope="module")
def lines(cleaning):
    return [row.asDict() for row in cleaning.fact.collect()]


@pytest.fixture(scope="module")
def log(cleaning):
    return {row.rule: (row.rows, row.note) for row in cleaning.change_log().collect()}


def of(lines, invoice):
    return [line for line in lines if line["invoice_no"] == invoice]


def test_sources_are_stacked_under_one_set_of_names(raw_sources):
    raw = feed.ingest(raw_sources)
    assert raw.columns[: len(RAW_COLUMNS)] == list(RAW_COLUMNS)
    assert raw.groupBy("source").count().count() == 2 == feed.ingest_log(raw).count()
    assert raw.count() == len(NORTH) + len(SOUTH)


@pytest.mark.parametrize("gone, name", [("Price", "unit_price"), ("InvoiceDate", "invoice_date")])
def test_a_source_without_a_column_is_refused(spark, gone, name):
    broken = spark.createDataFrame(numbered(NORTH), FIRST_HEADERS).drop(gone)
    with pytest.raises(ValueError, match=f"'attic'.*{name}"):
        feed.ingest([("attic", broken.withColumn("spare", F.lit(0)))])


def test_each_line_has_its_type(lines):
    types = {line["invoice_no"]: line["line_type"] for line in lines}
    assert {i for i, t in types.items() if t == "cancellation"} == {"C70006", "C70007", "C80002"}
    assert {i for i, t in types.items() if t == "return"} == {"70008", "70009"}


def test_goods_are_told_by_code_and_word(lines):
    other = {line["stock_code"] for line in lines if not line["is_merchandise"]}
    assert {"POST", "M"} <= other
    assert other.isdisjoint({"A100", "B200", "E500"})  # a lantern for carriages is goods


def test_copies_and_test_lines_go(lines, log):
    assert len(lines) == len(NORTH) + len(SOUTH) - 2 - 2
    assert log["exact duplicates removed"][0] == 2
    assert log["test items removed"][0] == 2
    assert sorted(i["invoice_no"] for i in lines if i["stock_code"] in ("A100", "E500")) == [
        "70001", "70014", "80001", "C70006", "C80002"
    ]


def test_missing_text_is_the_commonest_or_the_marker(lines, log):
    assert of(lines, "70002")[0]["description"] == "BRASS HOOK"
    assert of(lines, "70015")[0]["description"] == Rules().labels.no_description
    assert log["description filled from stock_code"][0] == 1


def test_countries_and_guests(lines, log):
    assert {line["country"] for line in lines} == {
        "United Kingdom", "Ireland", "Norway", "Unspecified", "Sweden"
    }
    assert log["country mapped by lookup"] == (3, "EIRE -> Ireland")
    assert {i["invoice_no"] for i in lines if i["is_guest"]} == {"70004", "70008", "70009"}


def test_fact_shape_and_money(cleaning, lines, log):
    assert list(cleaning.fact.columns) == list(FACT_COLUMNS) and len(FACT_COLUMNS) == 14
    # 60 + 9 + 45 + 4.5 + 4.5 + 35 + 1 + 100
    assert fact_summary(cleaning.fact).first().revenue == 259.0
    assert of(lines, "C70007")[0]["line_revenue"] == Decimal("-18.00")
    assert len(log) == 11
    assert log["returns kept as they are"] == (2, "zero prices: 1 of 2")


# ---------------------------------------------------------------- edge cases
EDGE = [
    # two texts for one business key: the first line decides
    ("1", "10", "LACQUER TRAY, SMALL", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    ("1", "10", "SMALL LACQUER TRAY", 1, "2010-01-01 10:00", 1.0, "8", "France"),
    # tie for the commonest text: the smaller one fills the gap
    ("2", "20", "ZEBRA", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    ("3", "20", "APPLE", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    ("4", "20", None, 1, "2010-01-01 10:00", 1.0, "7", "France"),
    # no-break spaces and runs of blanks
    ("5", "30", " RED  \tMUG ", 1, "2010-01-01 10:00", 1.0, "7", " EIRE "),
    # lower and upper spelling of one code, stray blanks
    ("6", " 72349b", "LAMP", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    ("6", "72349B ", "LAMP", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    # unreadable customer, a C-invoice with positive quantity, zero quantity
    ("7", "40", "CUP", 1, "2010-01-01 10:00", 1.0, "n/a", "France"),
    ("c8", "40", "CUP", 5, "2010-01-01 10:00", 1.0, "12346.0", "France"),
    ("9", "40", "CUP", 0, "2010-01-01 10:00", 1.0, "7", "France"),
    # missing ids stay missing; empty text with an unknown code gets the marker
    (None, None, "  ", 1, "2010-01-01 10:00", 1.6499999999999998, "7", "France"),
    # words must be whole: damaged counts, undamaged does not
    ("10", "50", "Undamaged SAMPLER", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    ("11", "51", "damages, lost bits", 1, "2010-01-01 10:00", 1.0, "7", "France"),
    ("12", "52", "FRENCH CARRIAGE  LANTERN", 1, "2010-01-01 10:00", 1.0, "7", "France"),
]


@pytest.fixture(scope="module")
def edge(spark):
    headers = FIRST_HEADERS.replace("`Customer ID` double", "`Customer ID` string")
    rows = [(*row, position) for position, row in enumerate(EDGE)]
    raw = feed.ingest([("edge", spark.createDataFrame(rows, headers))])
    return [row.asDict() for row in Cleaning(raw, Rules()).fact.collect()]


def test_first_of_conflicting_copies_wins(edge):
    (line,) = of(edge, "1")
    assert (line["description"], line["customer_id"]) == ("LACQUER TRAY, SMALL", 7)


def test_tie_for_commonest_text_takes_the_smaller(edge):
    assert of(edge, "4")[0]["description"] == "APPLE"


def test_no_break_spaces_are_spaces(edge):
    (line,) = of(edge, "5")
    assert (line["description"], line["country"]) == ("RED MUG", "Ireland")


def test_code_spelling_is_one_product(edge):
    (line,) = of(edge, "6")
    assert line["stock_code"] == "72349B"


def test_customer_ids(edge):
    assert of(edge, "7")[0]["customer_id"] is None and of(edge, "7")[0]["is_guest"]
    assert of(edge, "C8")[0]["customer_id"] == 12346


def test_prefix_beats_positive_quantity_and_zero_is_a_sale(edge):
    assert of(edge, "C8")[0]["line_type"] == "cancellation"
    assert of(edge, "9")[0]["line_type"] == "sale"


def test_missing_ids_stay_null_and_price_noise_goes(edge):
    (line,) = of(edge, None)
    assert line["stock_code"] is None
    assert line["description"] == Rules().labels.no_description
    assert line["unit_price"] == Decimal("1.65")
    assert line["month_start"] == dt.date(2010, 1, 1)


def test_whole_words_only(edge):
    assert of(edge, "10")[0]["is_merchandise"]
    assert not of(edge, "11")[0]["is_merchandise"]
    assert of(edge, "12")[0]["is_merchandise"]


def test_numeric_ids_lose_the_decimal_point(spark):
    headers = FIRST_HEADERS.replace("Invoice string", "Invoice double")
    rows = [(489225.0, "1", "A", 1, "2010-01-01 10:00", 1.0, 5.0, "France", 0)]
    raw = feed.ingest([("numbers", spark.createDataFrame(rows, headers))])
    assert Cleaning(raw, Rules()).fact.first().invoice_no == "489225"


@pytest.mark.parametrize(
    "kind, value, expected",
    [
        ("string", "12346", 12346), ("string", " 12346.0 ", 12346), ("string", "1.2346E4", 12346),
        ("string", "12346.5", None), ("string", "n/a", None), ("string", "", None),
        ("string", "nan", None), ("string", "99999999999999999999", None), ("string", "-5", -5),
        ("double", 12346.0, 12346), ("double", 12346.5, None), ("double", float("nan"), None),
        ("double", float("inf"), None), ("int", 7, 7), ("decimal(10,2)", Decimal("7.00"), 7),
        ("decimal(10,2)", Decimal("7.50"), None), ("string", None, None),
    ],
)
def test_customer_number(spark, kind, value, expected):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    assert df.select(whole_number(F.col("c"), df.schema["c"].dataType)).first()[0] == expected


def test_files_without_line_numbers_keep_file_order(spark, tmp_path):
    header = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    line = "1,10,{},1,2010-01-01 10:00,1.0,7,France\n"
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(header + line.format('"first, quoted"') + line.format("second"))
    (folder / "b.csv").write_text(header + line.format("third") * 50)
    raw = feed.ingest([("csv", feed.read_csv(spark, str(folder)))])
    cleaning = Cleaning(raw, Rules())
    (kept,) = cleaning.fact.collect()
    assert kept.description == "first, quoted"
    assert raw.count() == 52


def test_hot_copies_are_cut_before_the_shuffle(cleaning):
    plan = keep_first_copy(cleaning.typed)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 1, Partial")
    assert plan.index("Exchange hashpartitioning(invoice_no") < partial
