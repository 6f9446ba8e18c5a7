"""Every operator as a named query over the driver tables: (spark, sf_dir) -> DataFrame.

Ratios that the operators leave unrounded are rounded here, and decimals become
doubles, so that both sides of the comparison print the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import star
from checks.workspace import Workspace, workspace
from tillroll.functions import columns as C
from tillroll.operators import audit, base, clean, marts, reports
from tillroll.plans.staging import new_path
from tillroll.schema import FACT_COLUMNS
from tillroll.sources import tables
from tillroll.sources.feed import ingest, ingest_log, source_profile

Query = Callable[[SparkSession, str], DataFrame]

FILTERS = {
    "period": ("1996-03-05", "1999-11-20"),
    "countries": ["NATION_0", "NATION_2", "NATION_5", "Unspecified"],
    "include_bulk": False,
    "identified_only": True,
}
COUNTRIES = ["NATION_0", "NATION_2", "NATION_5"]
YEARS = (1997, 1998)
CUTOFF = "12-09"
MATCH_DAYS = 365
LAST_MONTH = 83  # the feed spans seven calendar years; a longer cohort raises
SAMPLE = 100  # fewer than the customers of any table size, so that the sample is one
LINE = ["src_ord", "row_ord"]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({name: C.dbl(F.col(name)) for name in decimals}) if decimals else df


def even(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round unrounded ratios."""
    return df.withColumns({name: C.rounded(F.col(name), places) for name in names})


def _typed(w: Workspace) -> DataFrame:
    return clean.normalize_types(w.raw, w.rules)


def _backfilled(w: Workspace) -> DataFrame:
    kept = clean.drop_test_rows(w.cleaning().unique, w.rules)
    return clean.backfill_description(kept)


def _write_fact(w: Workspace) -> DataFrame:
    path = new_path(w.spark, "fact-sink")
    tables.write_fact(w.fact, path)
    return tables.load_fact(w.spark, path)


def _write_change_log(w: Workspace) -> DataFrame:
    fact, log = new_path(w.spark, "run-fact"), new_path(w.spark, "run-log")
    tables.write_run(w.cleaning(), fact, log)
    return w.spark.read.parquet(log)


def _from_csv(w: Workspace) -> DataFrame:
    lines = star.feed_lines(w.spark, w.sf_dir)
    raw = ingest(star.csv_sources(lines, new_path(w.spark, "csv-feeds")))
    return clean.normalize_types(raw, w.rules).drop("file_ord", "source")


def as_text(df: DataFrame) -> Column:
    """One text per row, columns by name; doubles to four places, absent values as ``~``."""
    parts = [
        F.coalesce(
            F.col(name).cast("decimal(38,4)" if kind == "double" else kind).cast("string"), F.lit("~")
        )
        for name, kind in sorted(plain(df).dtypes)
    ]
    return F.concat_ws("|", *parts)


def _write_marts(w: Workspace) -> DataFrame:
    """Every row of every mart, as read back from the written version."""
    folder = new_path(w.spark, "marts-sink")
    written = [
        plain(tables.load_mart(w.spark, folder, name))
        for name in tables.write_marts(w.context, folder)
    ]
    rows = [
        df.select(F.lit(name).alias("mart"), as_text(df).alias("row"))
        for name, df in zip(marts.REGISTRY, written)
    ]
    return reduce(DataFrame.unionByName, rows)


def _by_lookup(w: Workspace) -> DataFrame:
    """Countries mapped by a table: the feed's old spelling, and nations as their region's."""
    nation = w.spark.read.parquet(f"{w.sf_dir}/nation.parquet")
    old = nation.filter("n_name = 'NATION_2'").select(F.lit(" OLD_2").alias("spelling"), "n_name")
    odd = nation.filter("n_nationkey % 3 = 1").select(
        "n_name", F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string"))
    )
    lookup = clean.country_lookup(old.union(odd), "spelling", "n_name")
    mapped = clean.map_country(clean.normalize_text(w.raw), w.rules, lookup)
    return mapped.groupBy("country").agg(F.count("*").alias("lines"))


CLEANING: dict[str, Callable[[Workspace], DataFrame]] = {
    "ingest_union": lambda w: w.raw.drop("file_ord"),
    "ingest_log": lambda w: ingest_log(w.raw),
    "normalize_ids": lambda w: clean.normalize_ids(w.raw).select(*LINE, "invoice_no", "stock_code"),
    "normalize_text": lambda w: clean.normalize_text(w.raw).select(
        *LINE, "description", "country"
    ),
    "normalize_types": lambda w: _typed(w).drop("file_ord", "source"),
    "map_country": lambda w: clean.map_country(clean.normalize_text(w.raw), w.rules)
    .groupBy("country")
    .agg(F.count("*").alias("lines")),
    "map_country_lookup": _by_lookup,
    "tag_line_type": lambda w: clean.tag_line_type(_typed(w)).select(
        *LINE, "invoice_no", "quantity", "line_type"
    ),
    "tag_merchandise": lambda w: clean.tag_merchandise(_typed(w), w.rules).select(
        *LINE, "stock_code", "description", "is_merchandise"
    ),
    "tag_guest_bulk": lambda w: clean.tag_guest_bulk(_typed(w), w.rules).select(
        *LINE, "customer_id", "quantity", "is_guest", "is_bulk"
    ),
    "dedup_business_key": lambda w: clean.tag_rows(
        clean.keep_first_copy(w.cleaning().typed), w.rules
    ).drop("file_ord"),
    "drop_test_rows": lambda w: clean.drop_test_rows(w.cleaning().typed, w.rules)
    .groupBy("stock_code")
    .agg(F.count("*").alias("lines")),
    "backfill_description": lambda w: _backfilled(w).select(
        *LINE, "invoice_no", "stock_code", "description", "is_backfilled"
    ),
    "fill_sentinel": lambda w: clean.fill_sentinel(_backfilled(w), w.rules).select(
        *LINE, "invoice_no", "stock_code", "description"
    ),
    "derive_measures": lambda w: clean.derive_measures(_typed(w)).select(
        *LINE, "quantity", "unit_price", "line_revenue", "invoice_date", "month_start"
    ),
    "clean_fact": lambda w: w.cleaning().fact,
    "dq_change_log": lambda w: w.cleaning().change_log(),
    "fact_summary": lambda w: clean.fact_summary(w.fact),
    "write_fact": _write_fact,
    "write_change_log": _write_change_log,
    "write_marts": _write_marts,
    "clean_fact_appended": lambda w: w.store.fact(),
    "change_log_appended": lambda w: w.store.change_log(),
    "normalize_types_csv": _from_csv,
}

BASE: dict[str, Callable[[Workspace], DataFrame]] = {
    "sales_all": lambda w: w.context.sales_all,
    "sales_id": lambda w: w.context.sales_id,
    "all_lines": lambda w: w.context.all_lines,
    "snapshot": lambda w: w.context.snapshot,
    "apply_filters": lambda w: base.apply_filters(w.fact, **FILTERS),
    "sales": lambda w: base.sales(w.fact).select(*FACT_COLUMNS),
    "reversals": lambda w: base.reversals(w.fact).select(*FACT_COLUMNS),
    "region_of": lambda w: base.with_market_group(w.fact, w.rules)
    .groupBy("country", "region")
    .agg(F.count("*").alias("lines")),
}


def _first_month(w: Workspace) -> DataFrame:
    return base.first_month(w.fact)


_GROWTH = ("aov", "revenue_per_customer", "mom_revenue", "yoy_revenue")

SLICES: dict[str, Callable[[Workspace], DataFrame]] = {
    "summary": lambda w: even(w.slice().summary(), "aov", "median_order", "guest_share", places=4),
    "monthly": lambda w: even(w.slice().monthly(_first_month(w)), *_GROWTH),
    "monthly_in_countries": lambda w: even(
        w.slice(countries=COUNTRIES).monthly(_first_month(w)), *_GROWTH
    ),
    "monthly_unrestricted": lambda w: even(
        w.slice(countries=COUNTRIES).monthly(_first_month(w), unrestricted=True), *_GROWTH
    ),
    "monthly_own_history": lambda w: even(w.slice(period=FILTERS["period"]).monthly(), *_GROWTH),
    "monthly_kpi_calendar": lambda w: marts.monthly_kpi(w.context, calendar_lag=True),
    "country_rollup": lambda w: even(w.slice().country_rollup(), "revenue_share", "repeat_rate"),
    "region_monthly": lambda w: w.slice().region_monthly(),
    "top_products": lambda w: even(w.slice().top_products(), "avg_price", "revenue_share"),
    "top_products_by_units": lambda w: even(
        w.slice().top_products(by="units"), "avg_price", "revenue_share"
    ),
    "top_products_by_orders": lambda w: even(
        w.slice().top_products(by="orders"), "avg_price", "revenue_share"
    ),
    "cancellations_monthly": lambda w: even(w.slice().cancellations_monthly(), "share_of_sales"),
    "reversal_reasons": lambda w: w.slice(merchandise_only=False).reversal_reasons(),
    "customer_revenue": lambda w: w.slice().customer_revenue(),
    "pareto": lambda w: even(w.slice().pareto(), "share", "cum_share", "customer_share"),
    "concentration": lambda w: even(
        w.slice().concentration("0.5", "0.8", "1.0"), "share_of_customers"
    ),
    "purchase_gap_days": lambda w: w.slice().purchase_gap_days(),
    "cohort_pivot": lambda w: reports.cohort_pivot(
        marts.cohort_retention(w.context), last_month=LAST_MONTH
    ),
    "cohort_pivot_active": lambda w: reports.cohort_pivot(
        marts.cohort_retention(w.context), "active_customers", LAST_MONTH
    ),
    "repeat_stats": lambda w: even(
        w.slice(identified_only=True).repeat_stats(),
        "repeat_rate", "one_time_share", "median_gap_days", "p75_gap_days", "avg_orders",
    ),
    "countries_by_revenue": lambda w: w.slice(merchandise_only=False).countries_by_revenue(),
    "first_month": _first_month,
    "net_delta": lambda w: even(w.slice().net_delta(), "net_delta"),
    "top_countries": lambda w: w.slice().top_countries(),
    "region_totals": lambda w: even(w.slice().region_totals(), "revenue_share"),
    "retention_curve": lambda w: even(
        reports.retention_curve(marts.cohort_retention(w.context)), "retention"
    ),
    "gap_quantiles": lambda w: w.slice().gap_quantiles(),
    "gap_histogram": lambda w: w.slice().gap_histogram(),
    "segment_share_long": lambda w: reports.segment_share_long(marts.rfm_segments(w.context)),
    "rfm_sample": lambda w: reports.rfm_sample(marts.rfm(w.context), SAMPLE),
    "top_reversed": lambda w: reports.top_reversed(w.context),
    "fact_extent": lambda w: w.slice(merchandise_only=False).extent(),
}

AUDITS: dict[str, Callable[[Workspace], DataFrame]] = {
    "source_profile": lambda w: source_profile(w.raw),
    "overlap_by_day": lambda w: audit.overlap_by_day(w.raw),
    "duplicate_counts": lambda w: audit.duplicate_counts(w.raw),
    "conflicting_duplicates": lambda w: audit.conflicting_duplicates(w.raw),
    "negative_split": lambda w: audit.negative_split(w.raw),
    "positive_cancellations": lambda w: audit.positive_cancellations(w.raw),
    "return_price_audit": lambda w: audit.return_price_audit(w.raw),
    "nonstandard_codes": lambda w: audit.nonstandard_codes(w.raw),
    "word_audit": lambda w: audit.word_audit(w.raw),
    "numeric_descriptions": lambda w: audit.numeric_descriptions(w.raw),
    "null_profile": lambda w: audit.null_profile(w.raw),
    "null_profile_typed": lambda w: audit.null_profile(_typed(w)),
    "country_audit": lambda w: audit.country_audit(w.raw, ("OLD_2", "NATION_0", "Unspecified")),
    "code_type_profile": lambda w: audit.code_type_profile(w.raw),
    "price_noise": lambda w: audit.price_noise(w.raw),
    "before_after": lambda w: audit.before_after(w.raw, w.fact),
}

REPORTS: dict[str, Callable[[Workspace], DataFrame]] = {
    "yearly_totals": lambda w: reports.yearly_totals(marts.monthly_kpi(w.context)),
    "year_over_year": lambda w: even(
        reports.year_over_year(w.context, YEARS), "earlier", "later", places=4
    ),
    "year_over_year_cutoff": lambda w: even(
        reports.year_over_year(w.context, YEARS, CUTOFF), "earlier", "later", places=4
    ),
    "cohort_revenue_curve": lambda w: even(
        reports.cohort_revenue_curve(marts.cohort_revenue(w.context)), "revenue_share", places=4
    ),
    "pareto_head": lambda w: even(
        w.slice().pareto_head(), "share", "cum_share", "customer_share"
    ),
    "matched_cancellations": lambda w: reports.matched_cancellations(w.fact, MATCH_DAYS),
    "matched_cancellations_one_day": lambda w: reports.matched_cancellations(w.fact),
    "score_group_sizes": lambda w: reports.score_group_sizes(marts.rfm(w.context)),
    "customer_coverage": lambda w: reports.customer_coverage(w.fact),
    "region_yoy": lambda w: reports.region_yoy(w.context, YEARS),
    "region_yoy_cutoff": lambda w: reports.region_yoy(w.context, YEARS, CUTOFF),
}


def _named(build: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(build(workspace(spark, sf_dir)))


def _mart(build) -> Query:
    return lambda spark, sf_dir: plain(build(workspace(spark, sf_dir).context))


def all_queries() -> dict[str, Query]:
    found = {name: _named(q) for group in (CLEANING, BASE) for name, q in group.items()}
    found |= {name: _mart(build) for name, build in marts.REGISTRY.items()}
    found |= {
        name: _named(q) for group in (SLICES, AUDITS, REPORTS) for name, q in group.items()
    }
    return found
