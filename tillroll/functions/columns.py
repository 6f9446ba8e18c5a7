"""Column expressions shared by the operators. All run inside codegen, no UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.rules import Rules
from tillroll.schema import MONEY

SALE, CANCELLATION, RETURN = "sale", "cancellation", "return"

# --- fixed values: the characters Unicode counts as white space -----------------
_WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Java needs (?U) for no-break spaces and letters beyond ASCII
_SPACE = r"(?U)\s+"
_DIGITS = r"^[0-9]{1,18}$"
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


# ---------------------------------------------------------------- cleaning
def id_text(col: Column, dtype: T.DataType) -> Column:
    """Ids come as numbers or text; ``489225.0``, ``' 72349b '`` -> ``489225``, ``72349B``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = col.cast("decimal(20,0)").cast("string")
        text = F.when(col == F.floor(col), whole).otherwise(col.cast("string"))
    else:
        text = col.cast("string")
    return F.upper(F.trim(text, F.lit(_WHITE)))


def clean_text(col: Column) -> Column:
    """Collapse whitespace runs, strip the ends, turn empty text into null."""
    collapsed = F.trim(F.regexp_replace(col.cast("string"), _SPACE, " "))
    return F.nullif(collapsed, F.lit(""))


def whole_number(col: Column, dtype: T.DataType) -> Column:
    """Customer ids: ``12346``, ``'12346.0'`` -> 12346; anything unreadable -> null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(col == F.floor(col), col.try_cast("bigint"))
    if not isinstance(dtype, T.StringType):
        return F.when(col % 1 == 0, col.try_cast("bigint"))
    # plain digits need no decimal, and a failed cast costs far more than a test
    number = col.try_cast("decimal(38,6)")
    whole = F.when(number % 1 == 0, number.try_cast("bigint"))
    return F.when(col.rlike(_DIGITS), col.try_cast("bigint")).when(col.rlike(_NUMBER), whole)


def money(price: Column) -> Column:
    """Round half-even to cents (as binary doubles do) and keep as an exact decimal."""
    return (F.rint(price.cast("double") * 100) / 100).cast(MONEY)


def mapped_country(col: Column, rules: Rules) -> Column:
    """Replace listed spellings; every other value passes through."""
    return reduce(
        lambda rest, pair: F.when(col == pair[0], F.lit(pair[1])).otherwise(rest),
        rules.country_map.items(),
        col,
    )


def is_mapped_country(col: Column, rules: Rules) -> Column:
    return F.coalesce(col.isin(list(rules.country_map)), F.lit(False))


def line_type(invoice_no: Column, quantity: Column) -> Column:
    return (
        F.when(invoice_no.startswith("C"), CANCELLATION)
        .when(quantity < 0, RETURN)
        .otherwise(SALE)
    )


def is_goods(stock_code: Column, description: Column, rules: Rules) -> Column:
    by_code = F.coalesce(stock_code.isin(list(rules.non_goods_codes)), F.lit(False))
    by_text = F.coalesce(description, F.lit("")).rlike("(?iU)" + rules.non_goods_pattern)
    return ~(by_code | by_text)


def is_test_code(stock_code: Column, rules: Rules) -> Column:
    return F.coalesce(stock_code.isin(list(rules.test_codes)), F.lit(False))


# ---------------------------------------------------------------- market groups
def market_group(country: Column, rules: Rules) -> Column:
    """Country -> one of four groups; the last is the remainder, so no line is lost."""
    labels = rules.labels
    return (
        F.when(country == rules.home_country, labels.home)
        .when(country == rules.unspecified_country, labels.unspecified)
        .when(country.isin(list(rules.listed_export)), labels.listed_export)
        .otherwise(labels.other_export)
    )


# ---------------------------------------------------------------- calendar
def month_label(month_start: Column) -> Column:
    return F.date_format(month_start, "yyyy-MM")


def months_between_starts(first: Column, later: Column) -> Column:
    """Whole calendar months from one month start to another."""
    return (
        (F.year(later) - F.year(first)) * 12 + F.month(later) - F.month(first)
    ).cast("bigint")


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods between two moments; no time zone is involved."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def whole_minutes(start: Column, end: Column) -> Column:
    part = lambda unit: F.extract(F.lit(unit), end - start).cast("bigint")
    return part("DAY") * 1440 + part("HOUR") * 60 + part("MINUTE")


# ---------------------------------------------------------------- numbers
def dbl(col: Column) -> Column:
    return col.cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in doubles; null where the whole is null or zero."""
    return F.try_divide(dbl(part), dbl(whole))


def rounded(col: Column, places: int) -> Column:
    """Round a double by scaling, so 1.005 -> 1.0 as its binary value says."""
    scale = float(10**places)
    return F.round(dbl(col) * scale, 0) / scale
