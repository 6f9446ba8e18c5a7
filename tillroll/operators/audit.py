"""Data-quality audits of the raw lines, before cleaning.

They read :func:`tillroll.sources.feed.ingest` output as it came; ids and text are
only trimmed or cased where an audit says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators.scale import most_common
from tillroll.plans.staging import stage
from tillroll.rules import BUSINESS_KEY
from tillroll.schema import MONEY, RAW_COLUMNS
from tillroll.sources.feed import source_profile

# --- fixed values: words to look for in descriptions, names to watch ------------
PROBE_WORDS: tuple[str, ...] = ("carriage", "wrapping", "display", "sample", "adjust")
WATCHED_COUNTRIES: tuple[str, ...] = (
    "EIRE", "RSA", "United Kingdom", "Unspecified", "European Community",
)


def _is_cancelled():
    return F.coalesce(F.col("invoice_no").cast("string").startswith("C"), F.lit(False))


def _amount():
    """Line value in exact cents, so that sums do not depend on their order."""
    return (F.col("quantity").cast("int") * C.money(F.col("unit_price"))).cast(MONEY)


def overlap_by_day(raw: DataFrame) -> DataFrame:
    """Lines per source day inside the days every source covers."""
    spans = source_profile(raw)
    first = spans.agg(F.to_date(F.max("first_moment"))).scalar()
    last = spans.agg(F.to_date(F.min("last_moment"))).scalar()
    day = F.to_date(F.col("invoice_date").cast("timestamp_ntz"))
    return (
        raw.filter(day.between(first, last))
        .groupBy(day.alias("day"))
        .agg(F.count("*").alias("lines"))
    )


def _fingerprint(names: Sequence[str]) -> Column:
    """128 bits that stand for the values of a line, absent ones included."""
    absent = [F.col(n).isNull() for n in names]
    return F.struct(
        F.xxhash64(*names, *absent).alias("a"), F.xxhash64(F.lit(1), *names, *absent).alias("b")
    )


def _copies(raw: DataFrame) -> DataFrame:
    """(key, line, copies): fingerprints of business key and whole line, one row per distinct line.

    Fingerprints travel, not lines.
    """
    marked = raw.select(
        _fingerprint(BUSINESS_KEY).alias("key"), _fingerprint(RAW_COLUMNS).alias("line")
    )
    return marked.groupBy("key", "line").agg(F.count("*").alias("copies"))


def duplicate_counts(raw: DataFrame) -> DataFrame:
    """Extra copies by all columns and by business key (N3). Nulls are equal."""
    per_key = (
        _copies(raw)
        .groupBy("key")
        .agg(F.sum("copies").alias("lines"), F.sum(F.col("copies") - 1).alias("extra"))
    )
    return per_key.agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("by_all_columns"),
        F.coalesce(F.sum(F.col("lines") - 1), F.lit(0)).alias("by_business_key"),
    )


def conflicting_duplicates(raw: DataFrame) -> DataFrame:
    """Lines that share a business key with others but have no exact copy.

    Fingerprints tell which lines those are: lines seen once under a key seen more often. Only
    their fingerprints, staged, meet the lines, each of them one line at most. Keys with more
    lines are found per key by two sums, so no key is gathered.
    """
    copies = stage(_copies(raw), "line-copies")
    shared = copies.groupBy("key").agg(F.sum("copies").alias("lines")).filter("lines > 1")
    single = copies.filter("copies = 1").join(shared, "key", "left_semi")
    wanted = stage(single.select("line"), "conflicting-lines")
    marked = raw.select(*RAW_COLUMNS, _fingerprint(RAW_COLUMNS).alias("line"))
    return marked.join(wanted, "line", "left_semi").select(*RAW_COLUMNS)


def negative_split(raw: DataFrame) -> DataFrame:
    """Negative lines in and outside cancelled invoices; all cancelled lines."""
    negative = F.col("quantity").cast("int") < 0
    return raw.agg(
        F.count_if(negative).alias("negative_lines"),
        F.count_if(negative & _is_cancelled()).alias("in_cancelled_invoices"),
        F.count_if(negative & ~_is_cancelled()).alias("in_normal_invoices"),
        F.count_if(_is_cancelled()).alias("cancelled_lines"),
    )


def positive_cancellations(raw: DataFrame) -> DataFrame:
    """Lines of cancelled invoices with a positive quantity."""
    return raw.filter(_is_cancelled() & (F.col("quantity").cast("int") > 0)).select(
        "invoice_no", "stock_code", "description", "quantity", "unit_price"
    )


def return_price_audit(raw: DataFrame) -> DataFrame:
    """Returns in normal invoices: how many are free, their value and units."""
    quantity = F.col("quantity").cast("int")
    returned = raw.filter(~_is_cancelled() & (quantity < 0))
    return returned.agg(
        F.count("*").alias("return_lines"),
        F.count_if(F.col("unit_price").cast("double") == 0).alias("zero_price_lines"),
        C.dbl(F.coalesce(F.sum(_amount()), F.lit(0))).alias("value"),
        F.coalesce(F.sum(quantity), F.lit(0)).alias("units"),
    )


def nonstandard_codes(raw: DataFrame, limit: int = 14) -> DataFrame:
    """Codes that are not five or six digits, most negative amount first."""
    code = F.col("stock_code").cast("string")
    odd = raw.withColumn("stock_code", code).filter(~code.rlike(r"^\d{5,6}$"))
    top = (
        odd.groupBy("stock_code")
        .agg(F.count("*").alias("lines"), F.sum(_amount()).alias("amount"))
        .orderBy("amount", "stock_code")
        .limit(limit)
    )
    # the limit tells the planner how small `top` is
    lines = odd.join(top.select("stock_code"), "stock_code", "left_semi")
    labels = most_common(lines, ["stock_code"], "description")
    return top.join(labels, "stock_code", "left").select(
        "stock_code",
        "lines",
        F.coalesce("description", F.lit("-")).alias("description"),
        C.dbl(F.col("amount")).alias("amount"),
    )


def word_audit(raw: DataFrame, words: Sequence[str] = PROBE_WORDS, top: int = 2) -> DataFrame:
    """Lines whose description contains a word, with the commonest descriptions.

    Descriptions are counted first; words are tried on distinct descriptions only.
    """
    counted = raw.groupBy("description").agg(F.count("*").alias("n"))
    low = F.lower(F.coalesce("description", F.lit("")))
    hits = F.filter(F.array(*(F.lit(w) for w in words)), lambda w: low.contains(F.lower(w)))
    found = counted.withColumn("word", F.explode(hits))
    totals = found.groupBy("word").agg(F.sum("n").alias("lines"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "description"))
    best = found.withColumn("place", place).filter(F.col("place") <= top)
    asked = raw.sparkSession.range(1).select(
        F.explode(F.array(*(F.lit(w) for w in words))).alias("word")
    )
    return (
        asked.join(totals, "word", "left")
        .join(best, "word", "left")
        .select(
            "word",
            F.coalesce("lines", F.lit(0)).alias("lines"),
            "place",
            "description",
            F.col("n").alias("description_lines"),
        )
    )


def numeric_descriptions(raw: DataFrame) -> DataFrame:
    """Lines whose description is a number."""
    return raw.filter(F.col("description").rlike(r"^\d+$")).select(*RAW_COLUMNS)


def null_profile(raw: DataFrame) -> DataFrame:
    """Nulls per column in one pass, columns with nulls only."""
    counts = raw.agg(
        F.count("*").alias("_lines"),
        *(F.count_if(F.col(name).isNull()).alias(name) for name in RAW_COLUMNS),
    )
    return (
        counts.unpivot("_lines", list(RAW_COLUMNS), "column_name", "nulls")
        .filter("nulls > 0")
        .select(
            "column_name",
            "nulls",
            C.rounded(C.ratio(F.col("nulls") * 100, F.col("_lines")), 1).alias("percent"),
        )
    )


def country_audit(raw: DataFrame, watched: Sequence[str] = WATCHED_COUNTRIES) -> DataFrame:
    """Number of country spellings, and lines of the watched ones."""
    counted = (
        raw.filter("country IS NOT NULL").groupBy("country").agg(F.count("*").alias("lines"))
    )
    spellings = counted.agg(F.count("*")).scalar()
    return counted.filter(F.col("country").isin(list(watched))).select(
        "country", "lines", spellings.alias("countries_in_feed")
    )


def code_type_profile(raw: DataFrame) -> DataFrame:
    """Ids that are numbers or text, and codes not in upper case."""
    invoice, code = (F.col(name).cast("string") for name in ("invoice_no", "stock_code"))
    number = r"^\d+$"
    return raw.agg(
        F.count_if(invoice.rlike(number)).alias("numeric_invoices"),
        F.count_if(~invoice.rlike(number)).alias("text_invoices"),
        F.count_if(code.rlike(number)).alias("numeric_codes"),
        F.count_if(~code.rlike(number)).alias("text_codes"),
        F.count_if(code != F.upper(code)).alias("codes_not_upper"),
    )


def price_noise(raw: DataFrame) -> DataFrame:
    """Prices with digits past the cents, and the smallest such price."""
    price = F.col("unit_price").cast("double")
    noisy = price != F.rint(price * 100) / 100
    return raw.agg(
        F.count_if(noisy).alias("noisy_lines"),
        F.min(F.when(noisy, price)).alias("example_price"),
    )


def before_after(raw: DataFrame, fact: DataFrame) -> DataFrame:
    """Lines, money, invoices, customers and days, raw against cleaned.

    Raw money is quantity times price of everything; cleaned money is goods sales.
    """
    goods_sale = (F.col("line_type") == C.SALE) & F.col("is_merchandise")

    def card(name: str, lines: DataFrame) -> DataFrame:
        per_invoice = lines.groupBy("invoice_no", "customer_id").agg(
            F.count("*").alias("lines"),
            F.sum("amount").alias("amount"),
            F.min("moment").alias("first"),
            F.max("moment").alias("last"),
        )
        return per_invoice.agg(
            F.lit(name).alias("state"),
            F.sum("lines").alias("lines"),
            C.dbl(F.sum("amount")).alias("revenue"),
            F.count_distinct("invoice_no").alias("invoices"),
            F.count_distinct("customer_id").alias("customers"),
            F.to_date(F.min("first")).alias("first_day"),
            F.to_date(F.max("last")).alias("last_day"),
        )

    before = raw.select(
        F.col("invoice_no").cast("string").alias("invoice_no"),
        C.whole_number(F.col("customer_id"), raw.schema["customer_id"].dataType).alias(
            "customer_id"
        ),
        _amount().alias("amount"),
        F.col("invoice_date").cast("timestamp_ntz").alias("moment"),
    )
    after = fact.select(
        "invoice_no",
        "customer_id",
        F.when(goods_sale, F.col("line_revenue")).alias("amount"),
        F.col("invoice_date").alias("moment"),
    )
    return card("raw", before).unionByName(card("cleaned", after))
