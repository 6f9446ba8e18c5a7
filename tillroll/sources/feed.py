"""Raw invoice lines: read every source, agree on the headers, stack them (A1-A3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.rules import HEADER_ALIASES
from tillroll.schema import ORIGIN_COLUMNS, RAW_COLUMNS


def read_csv(
    spark: SparkSession, path: str, multi_line: bool = False, schema: str | None = None
) -> DataFrame:
    """Delimited source with a header row; every column stays text until cleaning.

    Files are split between tasks. ``multi_line`` is for values with line breaks inside; each
    file is then read by one task. A folder that may hold no file needs its ``schema``.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def canonical(source: str, df: DataFrame) -> DataFrame:
    """Rename through the alias map, keep the required columns, drop the rest."""
    spelled = {HEADER_ALIASES.get(name, name): name for name in df.columns}
    missing = [name for name in RAW_COLUMNS if name not in spelled]
    if missing:
        raise ValueError(f"source {source!r} lacks columns {missing}")
    return _with_position(df).select(
        *(F.col(f"`{spelled[name]}`").alias(name) for name in RAW_COLUMNS), "file_ord", "row_ord"
    )


def _with_position(df: DataFrame) -> DataFrame:
    """Give every line its place in the source: ``file_ord`` text, then ``row_ord``.

    A ``row_ord`` column in the source wins. Otherwise lines are ordered by file
    path, then by block offset, then by reading order inside the block; that order
    does not depend on how the files are split into tasks. Frames that are not
    read from files have only the reading order.
    """
    if "row_ord" in df.columns:
        return df.withColumns({"file_ord": F.lit(""), "row_ord": F.col("row_ord").cast("bigint")})
    read_order = F.monotonically_increasing_id()
    try:
        block = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
        return df.withColumns(
            {
                "file_ord": F.concat_ws("#", F.col("_metadata.file_path"), block),
                "row_ord": read_order,
            }
        )
    except AnalysisException:
        return df.withColumns({"file_ord": F.lit(""), "row_ord": read_order})


def ingest(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Stack ``(name, frame)`` sources in order; columns by name, not position."""
    stacked: DataFrame | None = None
    for position, (name, df) in enumerate(sources):
        part = canonical(name, df).withColumns(
            {"source": F.lit(name), "src_ord": F.lit(position)}
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no sources given")
    return stacked.select(*RAW_COLUMNS, *ORIGIN_COLUMNS)


def source_profile(raw: DataFrame) -> DataFrame:
    """Rows and first/last moment per source."""
    moment = F.col("invoice_date").cast("timestamp_ntz")
    return raw.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.min(moment).alias("first_moment"),
        F.max(moment).alias("last_moment"),
    )


def source_lines(profile: DataFrame) -> DataFrame:
    """One change-log line per source of a :func:`source_profile`."""
    day = lambda name: F.date_format(F.to_date(name), "yyyy-MM-dd")
    return profile.select(
        F.concat(F.lit("source "), "source", F.lit(" read")).alias("rule"),
        "rows",
        F.concat_ws(" - ", day("first_moment"), day("last_moment")).alias("note"),
    )


def ingest_log(raw: DataFrame) -> DataFrame:
    """One change-log line per source: rows read and the days they span (A3)."""
    return source_lines(source_profile(raw))
