"""Mixing sources to target weights.

Every document gets a hash-random key. Inside its source, rows are range-sorted on it, prefix
sums of sizes are taken over the ranges, and the source is cut at its exact budget; a budget
above the source's size first takes whole epochs. Texts never move: the sort is over keys and
sizes, and each source's cut, one row, goes back to the documents.

Targets: the mix is ``volume`` times all sizes, shared by weight. A target stops at
``max_epochs`` times its source's size and the excess is shared anew by weight among the rest
until none is above. Sources get the weights in code point order, nulls last, in turn.

Cases: null or empty text has size 0 and takes 0; a source of size 0 has target 0; the document
at the cut gives its leading words only; equal rows are separate documents, and at the cut they
share what is left evenly; a null id counts as empty; empty table, empty mix; columns with
clashing names: the plan reads only the named columns, the mix hands all others through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import partitions, whole_rows, word_count, words_of
from tillroll.plans.staging import stage

WEIGHTS = (3, 1, 2)
VOLUME = (3, 2)
MAX_EPOCHS = 2
SEED = "mix-1"


def targets(
    per_source: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    volume: tuple[int, int] = VOLUME,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``target`` per row of (source, source_size).

    The level L of the filling obeys sum(min(weight * L, cap)) = volume. With sources in order of
    cap / weight the first ones are full, so L is the largest of the levels that each prefix of
    full sources gives, and no loop is needed. Windows here run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(
        F.array(*(F.lit(int(w)) for w in weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    caps = per_source.withColumn("weight", turn.cast("double")).withColumn(
        "cap", (F.col("source_size") * max_epochs).cast("double")
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up, down = volume
    mix = F.sum("source_size").over(whole) * F.lit(float(up)) / F.lit(float(down))
    level = (mix - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = caps.withColumn("level", level)
    # every prefix of full sources gives a level that is too low, but for the right one
    open_level = F.max("level").over(whole)
    share = F.least(F.col("weight") * F.col("open"), F.col("cap"))
    return leveled.withColumn("open", open_level).select(
        "source", "source_size", share.alias("target")
    )


def _key(doc_id: str, text: str, seed: str) -> Column:
    """A random place in the source: the same for equal rows, on every run and cluster."""
    parts = (F.col(doc_id).cast("string"), F.lit(seed), F.col(text))
    return F.md5(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"))


def cuts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = SEED,
    **plan,
) -> DataFrame:
    """Per source: size, target, whole epochs, and the key and words at which it is cut.

    Works on narrow rows (key, size, copies), staged range-split so that borders stay put; a hot
    source is many ranges. Offsets are one row per (range, source).
    """
    spark = docs.sparkSession
    narrow = (
        docs.select(
            F.col(source).alias("source"),
            _key(doc_id, text, seed).alias("key"),
            word_count(F.col(text)).alias("size"),
        )
        .groupBy("source", "key", "size")
        .agg(F.count("*").alias("copies"))
        .withColumn("all", F.col("size") * F.col("copies"))
    )
    split = stage(
        narrow.repartitionByRange(
            partitions(spark), F.col("source").asc_nulls_last(), "key", "size"
        ).withColumn("range", F.spark_partition_id()),
        "mix-ranges",
    )
    sums = split.groupBy("source", "range").agg(F.sum("all").alias("in_range"))
    ahead = (
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.withColumn("before", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)))
    sizes = sums.groupBy("source").agg(F.sum("in_range").cast("bigint").alias("source_size"))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    goals = stage(
        targets(sizes, **plan)
        .withColumn("epochs", epochs.cast("int"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size")),
        "mix-targets",
    )
    facts = starts.alias("s").join(
        goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))
    ).select(F.col("s.source").alias("of"), F.col("range").alias("at"), "before", "rest")
    inside = Window.partitionBy("range", "source").orderBy("key", "size")
    upto = F.sum("all").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = split.withColumn("upto", upto).join(
        facts, (F.col("range") == F.col("at")) & F.col("source").eqNullSafe(F.col("of"))
    )
    end = F.col("before") + F.col("upto")
    at_cut = placed.filter((end - F.col("all") < F.col("rest")) & (F.col("rest") <= end)).select(
        F.col("of").alias("cut_source"),
        F.col("key").alias("cut_key"),
        # equal rows at the cut share the rest evenly
        F.floor((F.col("rest") - end + F.col("all")) / F.col("copies")).alias("cut_words"),
    )
    return goals.join(at_cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_words"
    )


def _with_take(docs: DataFrame, doc_id: str, source: str, text: str, seed: str, **plan) -> DataFrame:
    """Rows as struct ``doc`` plus id, text, size, source_size, target, epochs, cut.

    ``cut`` counts the words of the last epoch. One staged row per source: broadcast by the
    optimiser while that is small.
    """
    table = stage(cuts(docs, doc_id, source, text, seed, **plan), "mix-cuts")
    rows = whole_rows(
        docs,
        id=F.col(doc_id),
        of=F.col(source),
        text=F.col(text),
        key=_key(doc_id, text, seed),
        size=word_count(F.col(text)),
    )
    joined = rows.join(table, F.col("of").eqNullSafe(F.col("source")))
    cut = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.least("cut_words", "size"))
        .otherwise(0)
    )
    return joined.withColumn("cut", cut.cast("bigint"))


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = SEED,
    **plan,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per document, left out ones too."""
    own = docs.select(doc_id, source, text)
    taken = F.col("epochs") * F.col("size") + F.col("cut")
    return _with_take(own, doc_id, source, text, seed, **plan).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        taken.cast("bigint").alias("taken"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = SEED,
    **plan,
) -> DataFrame:
    """The mix itself: a row per epoch and document, all columns of ``docs``.

    The document at its source's cut comes once more with the leading words that fit, joined by
    one space; documents without words never enter.
    """
    rows = _with_take(docs, doc_id, source, text, seed, **plan).filter("size > 0")
    whole = F.col("epochs") + F.when(F.col("cut") == F.col("size"), 1).otherwise(0)
    parted = (F.col("cut") > 0) & (F.col("cut") < F.col("size"))
    none = F.array().cast("array<bigint>")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("bigint"), whole),
        F.when(parted, F.array("cut")).otherwise(none),
    )
    rows = rows.select("doc", "text", F.explode(copies).alias("take"))
    head = F.array_join(F.slice(words_of(F.col("text")), 1, F.col("take").cast("int")), " ")
    given = F.when(F.col("take") < 0, F.col("text")).otherwise(head)
    return rows.select(
        *((given if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns)
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || 'mix-1' || coalesce(text, '')) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
                 (source_size * 2)::DOUBLE AS cap FROM per),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 3.0::DOUBLE / 2.0::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named),
goal AS (SELECT source, source_size, least(weight * max(level) OVER (), cap) AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS first
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - first)) ELSE 0 END AS taken
FROM placed
"""
