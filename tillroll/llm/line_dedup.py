"""Line dedup: drop lines that stand on too many pages of their host.

Per host, the pages that contain a line are divided by all pages of the host; lines above
``max_ratio`` are boilerplate and go. Pages of one host and equal text are one page, so the text of
a page with many copies is no boilerplate. ``ALLOWANCE`` pages are not counted against a line: one
or two pages that share a line say nothing, and the border moves smoothly with the host's size.
Native: split, hash, count, join, filter.

Cases: a null or empty text is a page without lines and stays as it is; blank lines are never
boilerplate; lines are compared without spaces, tabs and carriage returns at their ends; a line
repeated inside one page counts once; null hosts form one host; equal rows are one page and are all
cleaned alike; an empty table gives an empty table; other columns pass through untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import whole_rows
from tillroll.plans.staging import stage

_PAD = " \t\r"
MAX_RATIO = 0.02
ALLOWANCE = 2


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_PAD))


def _key(line: Column) -> Column:
    """128 bits that stand for a line: two hashes whose seeds differ."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    allowance: int = ALLOWANCE,
) -> DataFrame:
    """(host, boiler): per host the keys of its boilerplate lines.

    A host has at most (mean lines per page) / ``max_ratio`` of them. Only line keys travel,
    copies of a page combined first. Counting is a plain aggregate with map-side combine, so a
    hot host or a line on every page costs one row per map task.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    bare = F.filter(F.transform(_lines(F.col("text")), _bare), lambda x: x != "")
    keys = F.transform(F.array_distinct(bare), _key)
    once = pages.select("host", _key(F.col("text")).alias("page"), keys.alias("keys"))
    pages = stage(once.dropDuplicates(["host", "page"]).select("host", "keys"), "pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counted = (
        pages.select("host", F.explode("keys").alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("on_pages"))
        .filter(F.col("on_pages") > allowance)
    )
    common = counted.alias("c").join(
        totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))
    )
    return (
        common.filter(F.col("on_pages") - allowance > F.col("pages") * float(max_ratio))
        .groupBy(F.col("c.host").alias("host"))
        .agg(F.collect_list("key").alias("boiler"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    allowance: int = ALLOWANCE,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with its boilerplate lines cut out of ``text``; no row goes.

    ``counts`` names two more columns: lines of the page (0 for null), lines dropped. The small
    key lists are staged, so the optimiser sees their size: under its limit they are broadcast,
    beyond it both sides shuffle by host and adaptive execution splits the hot host.
    """
    found = stage(boilerplate(docs, host, text, max_ratio, allowance), "boilerplate")
    listed = found.withColumnRenamed("host", "of")
    rows = whole_rows(docs, host=F.col(host), text=F.col(text))
    joined = rows.join(listed, F.col("host").eqNullSafe(F.col("of")), "left")

    def stays(line: Column) -> Column:
        return ~F.array_contains(F.col("boiler"), _key(_bare(line)))

    lines = _lines(F.col("text"))
    kept = F.when(F.col("boiler").isNull(), lines).otherwise(F.filter(lines, stays))
    joined = joined.withColumn("kept", kept)
    columns = [
        (F.array_join("kept", "\n") if c == text else F.col("doc").getField(c)).alias(c)
        for c in docs.columns
    ]
    if counts:
        none = F.col("text").isNull()
        before = F.when(none, 0).otherwise(F.size(lines)).cast("bigint")
        after = F.when(none, 0).otherwise(F.size("kept")).cast("bigint")
        columns += [before.alias(counts[0]), (before - after).alias(counts[1])]
    return joined.select(*columns)


ORACLE = rf"""
WITH pages AS (SELECT DISTINCT source, text FROM documents),
total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
found AS (
  SELECT source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS bare
  FROM pages),
common AS (
  SELECT l.source, l.bare FROM found l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.bare <> '' GROUP BY l.source, l.bare, t.pages
  HAVING count(DISTINCT l.text) - {ALLOWANCE} > t.pages * {MAX_RATIO}::DOUBLE),
lines AS (
  SELECT doc_id, source, n, trim(line, ' ' || chr(9) || chr(13)) AS bare, line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.bare IS NOT NULL) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE c.bare IS NULL), '') AS text
  FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.bare = c.bare
  GROUP BY l.doc_id)
SELECT d.doc_id, d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
