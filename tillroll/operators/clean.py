"""Raw lines -> fact, with a log of every change.

Plan: types and tags are column expressions; the only wide steps are the
keep-first de-duplication (shuffle by business key) and the description backfill
(shuffle by code, null-description lines only). The de-duplicated lines are
staged once, because the label dictionary, the backfill, the fact and the log all
read them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators.scale import distinct_rollup, most_common, salted_left_join
from tillroll.plans.staging import stage
from tillroll.rules import BUSINESS_KEY, Rules
from tillroll.schema import FACT_COLUMNS, MONEY
from tillroll.sources.feed import source_lines


#: a lookup up to this size is broadcast; a row counts its text and ROW_BYTES
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64


# ---------------------------------------------------------------- row-wise steps
def normalize_ids(raw: DataFrame) -> DataFrame:
    kinds = {field.name: field.dataType for field in raw.schema.fields}
    return raw.withColumns(
        {name: C.id_text(F.col(name), kinds[name]) for name in ("invoice_no", "stock_code")}
    )


def normalize_text(raw: DataFrame) -> DataFrame:
    return raw.withColumns({name: C.clean_text(F.col(name)) for name in ("description", "country")})


def map_country(df: DataFrame, rules: Rules, lookup: DataFrame | None = None) -> DataFrame:
    """Replace listed spellings: the entries of the rules, or those of a ``lookup`` table."""
    if lookup is None:
        return df.withColumn("country", C.mapped_country(F.col("country"), rules))
    return map_values(df, "country", lookup)


def country_lookup(table: DataFrame, spelling: str, country: str) -> DataFrame:
    """(value, mapped) for :func:`map_values`; of several entries for a spelling the smallest.

    Spellings are cleaned as the lines are; empty ones map nothing.
    """
    entries = table.select(C.clean_text(F.col(spelling)).alias("value"), F.col(country).alias("mapped"))
    return entries.filter("value IS NOT NULL").groupBy("value").agg(F.min("mapped").alias("mapped"))


def with_entry(
    df: DataFrame, column: str, lookup: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Add the struct ``_entry`` (mapped): the row of ``lookup`` (value, mapped), null if none.

    ``lookup`` has one row per value. It is staged and measured: up to ``broadcast_bytes`` it is
    sent to every task. A larger one is first cut to the values that occur; if that is still too
    large, both sides are shuffled, values salted, as one country may hold most lines.
    """
    lookup = stage(lookup.select("value", "mapped"), "lookup")
    if _text_bytes(lookup) > broadcast_bytes:
        occurring = df.select(F.col(column).alias("value")).distinct()
        lookup = stage(lookup.join(occurring, "value", "left_semi"), "lookup-used")
    entries = lookup.select(F.col("value").alias(column), F.struct("mapped").alias("_entry"))
    if _text_bytes(lookup) <= broadcast_bytes:
        return df.join(F.broadcast(entries), column, "left").select(*df.columns, "_entry")
    spread = [c for c in df.columns if c != column] or [column]
    return salted_left_join(df, entries, [column], spread=spread, hint="merge")


def _text_bytes(lookup: DataFrame) -> int:
    text = F.octet_length("value") + F.coalesce(F.octet_length("mapped"), F.lit(0))
    return lookup.agg(F.sum(text + ROW_BYTES)).first()[0] or 0


def map_values(
    df: DataFrame, column: str, lookup: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Replace the values of ``column`` that ``lookup`` lists (:func:`with_entry`)."""
    found = with_entry(df, column, lookup, broadcast_bytes)
    listed = F.when(F.col("_entry").isNotNull(), F.col("_entry.mapped")).otherwise(F.col(column))
    return found.withColumn(column, listed).select(*df.columns)


def normalize_types(
    raw: DataFrame, rules: Rules, countries: DataFrame | None = None
) -> DataFrame:
    typed = normalize_text(normalize_ids(raw)).withColumns(
        {
            "invoice_date": F.col("invoice_date").cast("timestamp_ntz"),
            "quantity": F.col("quantity").cast("int"),
            "unit_price": C.money(F.col("unit_price")),
            "customer_id": C.whole_number(
                F.col("customer_id"), raw.schema["customer_id"].dataType
            ),
        }
    )
    return map_country(typed, rules, countries)


def tag_line_type(df: DataFrame) -> DataFrame:
    return df.withColumn("line_type", C.line_type(F.col("invoice_no"), F.col("quantity")))


def tag_merchandise(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn(
        "is_merchandise", C.is_goods(F.col("stock_code"), F.col("description"), rules)
    )


def tag_guest_bulk(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumns(
        {
            "is_guest": F.col("customer_id").isNull(),
            "is_bulk": F.col("quantity") >= rules.bulk_quantity,
        }
    )


def tag_rows(df: DataFrame, rules: Rules) -> DataFrame:
    return tag_guest_bulk(tag_merchandise(tag_line_type(df), rules), rules)


def drop_test_rows(df: DataFrame, rules: Rules) -> DataFrame:
    return df.filter(~C.is_test_code(F.col("stock_code"), rules))


def fill_sentinel(df: DataFrame, rules: Rules) -> DataFrame:
    marker = F.lit(rules.labels.no_description)
    return df.withColumn("description", F.coalesce("description", marker))


def derive_measures(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "line_revenue": (F.col("quantity") * F.col("unit_price")).cast(MONEY),
            "month_start": F.trunc(F.to_date("invoice_date"), "MM"),
        }
    )


# ---------------------------------------------------------------- wide steps
def keep_first_copy(df: DataFrame) -> DataFrame:
    """First row per business key, in source, file and line order.

    ``row_number() = 1`` lets Spark cut every key to one row per map task before
    the shuffle (WindowGroupLimit), so a key holding a third of the feed sends a
    handful of rows to its reducer. Text and customer only settle equal positions.
    """
    first = Window.partitionBy(*BUSINESS_KEY).orderBy(
        F.asc_nulls_last("src_ord"),
        F.asc_nulls_last("file_ord"),
        F.asc_nulls_last("row_ord"),
        F.asc_nulls_last("description"),
        F.asc_nulls_last("customer_id"),
    )
    return df.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy")


def usual_descriptions(df: DataFrame) -> DataFrame:
    """The commonest description of each code among goods lines; ties -> smallest."""
    goods = df.filter("is_merchandise AND stock_code IS NOT NULL")
    return most_common(goods, ["stock_code"], "description")


def needed_descriptions(df: DataFrame) -> DataFrame:
    """:func:`usual_descriptions` of the codes that have a line without one."""
    wanted = df.filter("description IS NULL").select("stock_code").distinct()
    return usual_descriptions(df).join(wanted, "stock_code", "left_semi")


def backfill_description(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Fill null descriptions of codes that other lines name; flags them ``is_backfilled``.

    Lines that have a description skip the join. ``known`` holds the usual descriptions, if
    they have been worked out already.
    """
    nameless = df.filter("description IS NULL")
    known = needed_descriptions(df) if known is None else known
    filled = salted_left_join(
        nameless.drop("description"),
        known,
        ["stock_code"],
        spread=["invoice_no", "invoice_date", "quantity", "unit_price"],
    ).withColumn("is_backfilled", F.col("description").isNotNull())
    named = df.filter("description IS NOT NULL").withColumn("is_backfilled", F.lit(False))
    return named.unionByName(filled)


def line_counts(rules: Rules) -> dict[str, Column]:
    """What the change log counts among de-duplicated, tagged lines."""
    kept = ~C.is_test_code(F.col("stock_code"), rules)
    is_return = F.col("line_type") == C.RETURN
    wanted = {
        "kept": F.lit(True),
        "tests": ~kept,
        "non_goods": kept & ~F.col("is_merchandise"),
        "unspecified": kept & (F.col("country") == rules.unspecified_country),
        "guests": kept & F.col("is_guest"),
        "bulk": kept & F.col("is_bulk"),
        "returns": kept & is_return,
        "free_returns": kept & is_return & (F.col("unit_price") == 0),
    }
    return {name: F.count_if(condition).alias(name) for name, condition in wanted.items()}


def stage_counted(lines: DataFrame, rules: Rules, name: str) -> tuple[DataFrame, dict[str, int]]:
    """Stage tagged lines and take :func:`line_counts` on the way.

    The counts are observed in the stage that writes, behind the shuffle: each of its tasks
    counts once, even if executors are lost.
    """
    seen = Observation()
    staged = stage(lines.observe(seen, *line_counts(rules).values()), name)
    return staged, seen.get


def raw_profile(raw: DataFrame, rules: Rules, countries: DataFrame | None = None) -> DataFrame:
    """Per source: lines, first and last moment, lines whose country is mapped. One pass."""
    moment = F.col("invoice_date").cast("timestamp_ntz")
    lines = raw.select("source", "invoice_date", C.clean_text(F.col("country")).alias("country"))
    if countries is None:
        mapped = C.is_mapped_country(F.col("country"), rules)
    else:
        lines, mapped = with_entry(lines, "country", countries), F.col("_entry").isNotNull()
    return lines.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.min(moment).alias("first_moment"),
        F.max(moment).alias("last_moment"),
        F.count_if(mapped).alias("mapped"),
    )


def log_lines(
    sources: DataFrame, counts: DataFrame, rules: Rules, by_table: bool = False
) -> DataFrame:
    """``(rule, rows, note)`` from a :func:`raw_profile` and one row of counts."""
    read = sources.agg(F.sum("rows").alias("read"), F.sum("mapped").alias("mapped"))
    counts = counts.select("*", read.select(F.struct("*")).scalar().alias("before"))
    none = F.lit(0)
    entries = ", ".join(f"{old} -> {new}" for old, new in rules.country_map.items())
    mapping = "lookup table" if by_table else entries
    lines = [
        ("exact duplicates removed", F.coalesce("before.read", none) - F.col("kept"),
         F.lit("key: " + ", ".join(BUSINESS_KEY))),
        ("test items removed", F.col("tests"), F.lit(", ".join(sorted(rules.test_codes)))),
        ("description filled from stock_code", F.col("backfilled"), F.lit("empty descriptions")),
        ("country mapped by lookup", F.coalesce("before.mapped", none), F.lit(mapping)),
        ("non-goods lines flagged, not removed", F.col("non_goods"),
         F.lit("postage, manual bookings, write-offs and the like")),
        ("country not recovered", F.col("unspecified"),
         F.lit(f"{rules.unspecified_country} kept as its own category")),
        ("lines without customer_id flagged as guests", F.col("guests"),
         F.lit("count in revenue, not in retention")),
        ("bulk lines flagged", F.col("bulk"), F.lit(f"quantity >= {rules.bulk_quantity}")),
        ("returns kept as they are", F.col("returns"),
         F.format_string("zero prices: %d of %d", "free_returns", "returns")),
    ]
    entry = [
        F.struct(F.lit(rule).alias("rule"), rows.cast("bigint").alias("rows"), note.alias("note"))
        for rule, rows, note in lines
    ]
    return source_lines(sources).unionByName(counts.select(F.inline(F.array(*entry))))


class Cleaning:
    """One cleaning run over ingested raw lines. Shared steps are staged once."""

    def __init__(self, raw: DataFrame, rules: Rules, countries: DataFrame | None = None):
        self.raw = raw
        self.rules = rules
        #: a table of spellings (:func:`country_lookup`) in place of the entries of the rules
        self.countries = countries

    @cached_property
    def typed(self) -> DataFrame:
        return normalize_types(self.raw, self.rules, self.countries).drop("source")

    @cached_property
    def _counted(self) -> tuple[DataFrame, dict[str, int]]:
        lines = tag_rows(keep_first_copy(self.typed), self.rules).drop("file_ord")
        return stage_counted(lines, self.rules, "unique-lines")

    @property
    def unique(self) -> DataFrame:
        """De-duplicated lines. Tags are added after the shuffle: they need not travel."""
        return self._counted[0]

    @cached_property
    def _known(self) -> DataFrame:
        """Usual descriptions of the codes that some line leaves out; staged, as two jobs read it."""
        kept = drop_test_rows(self.unique, self.rules)
        return stage(needed_descriptions(kept), "usual-descriptions")

    @property
    def fact(self) -> DataFrame:
        """The 14-column fact; sorted only where it is written."""
        kept = drop_test_rows(self.unique, self.rules)
        filled = fill_sentinel(backfill_description(kept, self._known), self.rules)
        return derive_measures(filled).select(*FACT_COLUMNS)

    def change_log(self) -> DataFrame:
        """``(rule, rows, note)``: one narrow pass over the raw lines, none over staged ones.

        Lines without a description are looked at again: how many could be named.
        """
        nameless = drop_test_rows(self.unique, self.rules).filter("description IS NULL")
        backfilled = nameless.join(self._known.select("stock_code"), "stock_code", "left_semi")
        counts = backfilled.agg(F.count("*").alias("backfilled")).select(
            "*", *(F.lit(n).alias(name) for name, n in self._counted[1].items())
        )
        sources = stage(raw_profile(self.raw, self.rules, self.countries), "raw-profile")
        return log_lines(sources, counts, self.rules, self.countries is not None)


def fact_summary(fact: DataFrame) -> DataFrame:
    """Size of the fact; revenue, invoices and customers among goods sales."""
    sale = (F.col("line_type") == C.SALE) & F.col("is_merchandise")
    per_invoice = fact.groupBy(
        F.when(sale, F.col("invoice_no")).alias("invoice_no"),
        F.when(sale, F.col("customer_id")).alias("customer_id"),
    ).agg(
        F.count("*").alias("lines"),
        F.sum(F.when(sale, F.col("line_revenue"))).alias("revenue"),
        F.min("invoice_date").alias("first"),
        F.max("invoice_date").alias("last"),
    )
    whole = distinct_rollup(per_invoice, [], ["lines", "revenue"], ["first"], ["last"])
    return whole.select(
        "lines",
        C.dbl(F.col("revenue")).alias("revenue"),
        F.col("orders").alias("invoices"),
        "customers",
        F.to_date("first").alias("first_day"),
        F.to_date("last").alias("last_day"),
    )
