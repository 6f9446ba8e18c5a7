"""Quality rules: robust multivariate outliers per language and source.

Every text gives counts of words, characters in words, symbols, repeated lines and repeated
words. Texts that fail a base rule go. The others become vectors of transformed rates, and for
each (lang, source) the minimum-covariance-determinant estimate gives centre and scatter: start
from the half nearest to the group's median and spread, then concentrate - estimate, measure, keep
the nearest ``coverage`` share - until no group's determinant falls (or after ``ROUNDS`` steps); a last estimate over all rows
inside the 97.5 % ellipse sharpens it. A text beyond ``cut`` (squared Mahalanobis distance) goes.

Native throughout. A group is never gathered: medians and the border of the nearest share come
from histograms of bounded width, means and products from aggregates with map-side combine.

Floors: each statistic has a least scale, added to the scatter's diagonal, so groups of any size
(one text included) and statistics without spread are well defined.

Cases: null text has no words and fails the base rules; null lang or source is a group of its own;
equal rows count each; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import whole_rows, words_of
from tillroll.plans.staging import stage

#: fixed value: the characters that count as symbols
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: share of a group its estimate rests on: holds against junk of almost half a group
HALF = 0.5
#: concentration ends here at the latest; a handful of steps is usual
ROUNDS = 20
#: a determinant falls if it loses this share of its least value so far
FALL = 1e-6
#: upper 1e-9 tail of chi-square with four degrees of freedom, about 48: clean texts stay
TAIL = 1e-9
#: least scale of each transformed statistic
FLOORS = (0.06, 0.5, 0.5, 0.5)
P = len(FLOORS)
_X = [f"x{i}" for i in range(P)]


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        # starts ascending: a window adds the words the next one does not begin with
        total = F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, s: F.struct(
                s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")
            ),
            lambda acc: acc["n"],
        )
        return total.cast("bigint")

    def repeated(ordered: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)["h"] == x["h"]
            after = F.get(ordered, i + 1)["h"] == x["h"]
            twin = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
            return F.when(twin, x["i"])

        hit = F.filter(F.transform(ordered, same), lambda s: s.isNotNull())
        return _let(F.array_sort(hit), covered)

    def counted(hashes: Column) -> Column:
        """Most texts repeat no window: only the others are sorted."""
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(F.array_sort(placed), repeated)
        )

    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0)))
    windows = F.transform(
        at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return _let(windows, counted)


def text_counts(text: Column) -> Column:
    """Struct of the five base counts."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(
        F.split(body, "\n", -1), lambda s: F.translate(s, " \t\n\x0b\x0c\r", "") != ""
    )
    return _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, "")))
            .cast("bigint")
            .alias("n_symbols"),
            _let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s)))
            .cast("bigint")
            .alias("n_dup_lines"),
            F.when(F.size(w) >= 4, _repeat_words(w)).otherwise(F.lit(0)).cast("bigint")
            .alias("n_repeat_words"),
        ),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_percent * F.col("n_words")
    )


def _vector() -> list[Column]:
    """Mean word length, symbols, repeated lines and repeated words per 100 words, on log scales."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rate(c: str) -> Column:
        return F.log1p(100 * F.col(c) / n)

    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        rate("n_symbols"),
        rate("n_dup_lines"),
        rate("n_repeat_words"),
    ]


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1.0
    while _chi2_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _consistency(share: float) -> float:
    """Makes the scatter of the nearest ``share`` of a normal cloud that of the whole cloud."""
    return share / _chi2_cdf(chi2_quantile(share, P), P + 2)


def _on_group(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on (lang, source), nulls equal; ``right`` is small and staged, so its size is known."""
    other = right.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    return left.join(
        other,
        F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")),
    ).drop("lang_", "source_")


def _bin(value: Column) -> Column:
    """Histogram bin of a non-negative value: 200 bins per factor e, 8,000 at most."""
    return F.floor(200 * F.log(F.least(F.greatest(value, F.lit(1e-9)), F.lit(1e8))))


def _borders(rows: DataFrame, share: float, bins: dict[str, Column]) -> DataFrame:
    """Per group and named bin: the first bin up to which ``share`` of the group's rows lie."""
    group = ["lang", "source"]
    named = F.explode(
        F.array(*(F.struct(F.lit(k).alias("what"), b.alias("bin")) for k, b in bins.items()))
    )
    counted = (
        rows.select(*group, named.alias("v"))
        .groupBy(*group, "v.what", "v.bin")
        .agg(F.count("*").alias("n"))
    )
    per = Window.partitionBy(*group, "what")
    up = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counted.withColumn("up", F.sum("n").over(up))
        .withColumn("all", F.sum("n").over(per))
        .filter(F.col("up") >= F.col("all") * share)
        .groupBy(*group)
        .agg(*(F.min(F.when(F.col("what") == k, F.col("bin"))).alias(k) for k in bins))
    )


def _moments(of) -> list[Column]:
    """``of`` every statistic, as m*, and of every product of two, as q**."""
    return [*(of(F.col(x)).alias(f"m{i}") for i, x in enumerate(_X))] + [
        of(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)
    ]


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """Per group: mean m*, and the lower triangle l* of the Cholesky factor of the scatter."""
    return _factored(rows.groupBy("lang", "source").agg(*_moments(F.avg)), scale)


def _nearest_estimate(rows: DataFrame, distance: str, share: float) -> DataFrame:
    """The estimate of the share of every group with the smallest distances, whole bins.

    One pass: the histogram holds the sums of each bin beside its rows, and the bins up to the
    border are added up.
    """
    group = ["lang", "source"]
    counted = rows.groupBy(*group, _bin(F.col(distance)).alias("bin")).agg(
        F.count("*").alias("n"), *_moments(F.sum)
    )
    per = Window.partitionBy(*group)
    before = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = (
        counted.withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("all", F.sum("n").over(per))
        .filter(F.col("nearer") < F.col("all") * share)
    )
    names = [c for c in counted.columns if c not in (*group, "bin", "n")]
    found = near.groupBy(*group).agg(*((F.sum(c) / F.sum("n")).alias(c) for c in names))
    return _factored(found, _consistency(share))


def _factored(found: DataFrame, scale: float) -> DataFrame:
    """:func:`_estimate` of the averages of :func:`_moments`."""
    for i in range(P):
        for j in range(i + 1):
            value = (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + FLOORS[i] ** 2
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # rounding aside the pivot is at least the floor's square
            value = (
                F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4)))
                if i == j
                else value / F.col(f"l{j}{j}")
            )
            found = found.withColumn(f"l{i}{j}", value)
    names = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]
    return found.select("lang", "source", *names)


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    joined = _on_group(rows, estimate)
    for i in range(P):
        value = F.col(_X[i]) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", value / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))
    return joined.withColumn("d2", d2).select("lang", "source", *_X, "d2")


def _least(estimate: DataFrame, before: DataFrame | None) -> DataFrame:
    """(lang, source, det, fell): least root of the determinant so far, and whether it fell now."""
    det = F.col("l00")
    for i in range(1, P):
        det = det * F.col(f"l{i}{i}")
    now = estimate.select("lang", "source", det.alias("det"))
    if before is None:
        return now.withColumn("fell", F.lit(True))
    both = _on_group(now, before.select("lang", "source", F.col("det").alias("was")))
    return both.select(
        "lang", "source", F.least("det", "was").alias("det"),
        (F.col("det") < F.col("was") * (1 - FALL)).alias("fell"),
    )


def group_estimates(
    vectors: DataFrame, coverage: float = HALF, steps: int | None = None
) -> DataFrame:
    """The reweighted MCD estimate of every (lang, source) of ``vectors`` (lang, source, x0..).

    ``steps`` fixes the number of concentration steps; without it they end when no group's
    determinant falls below its least so far, which floors bound from below, or after ``ROUNDS``.
    """
    shift = {f"c{i}": F.floor(F.col(x) * 1000) for i, x in enumerate(_X)}
    centre = stage(_borders(vectors, 0.5, shift), "medians")
    centred = _on_group(vectors, centre)
    away = {f"s{i}": F.abs(F.floor(F.col(x) * 1000) - F.col(f"c{i}")) for i, x in enumerate(_X)}
    spread = stage(_borders(centred, 0.5, away), "spreads")
    start = sum(
        (
            F.pow(
                (F.col(x) - F.col(f"c{i}") / 1000)
                / F.greatest(F.col(f"s{i}") * 0.0014826, F.lit(FLOORS[i])),
                2,
            )
            for i, x in enumerate(_X)
        ),
        F.lit(0.0),
    )
    first = _on_group(centred, spread).withColumn("d2", start).select("lang", "source", *_X, "d2")
    estimate, done, least = stage(_nearest_estimate(first, "d2", 0.5), "mcd"), 0, None
    while done != (ROUNDS if steps is None else steps):
        near = _nearest_estimate(_with_distance(vectors, estimate), "d2", coverage)
        estimate = stage(near, "mcd")
        done += 1
        if steps is None:
            least = stage(_least(estimate, least), "determinants")
            if least.filter("fell").isEmpty():
                break
    inside = _with_distance(vectors, estimate).filter(F.col("d2") <= chi2_quantile(0.975, P))
    return stage(_estimate(inside, _consistency(0.975)), "mcd")


def with_verdict(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    coverage: float = HALF,
    steps: int | None = None,
    tail: float = TAIL,
    carry: list[str] | None = None,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Columns ``carry`` (all) of ``docs`` as struct ``doc``, the five counts, ``base_failed``, ``kept``.

    Texts of fewer than ``min_words`` words fail a base rule. Texts are counted once, into a staged table that holds what is carried; the estimates read
    its counts only, and the verdict meets one small row per group.
    """
    rows = whole_rows(
        docs if carry is None else docs.select(text, lang, source, *carry),
        lang=F.col(lang).cast("string"),
        source=F.col(source).cast("string"),
        c=text_counts(F.col(text)),
    )
    if carry is not None:
        rows = rows.withColumn("doc", F.struct(*(F.col("doc").getField(c).alias(c) for c in carry)))
    counted = stage(rows, "counted").select("doc", "lang", "source", "c.*")
    counted = counted.withColumn("base_failed", base_failed(min_words))
    vectors = stage(
        counted.filter(~F.col("base_failed")).select(
            "lang", "source", *(v.alias(x) for x, v in zip(_X, _vector()))
        ),
        "vectors",
    )
    estimate = group_estimates(vectors, coverage, steps)
    scored = counted.withColumns(dict(zip(_X, _vector())))
    other = estimate.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = scored.join(
        other,
        F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")),
        "left",
    )
    for i in range(P):
        value = F.col(_X[i]) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", value / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))
    near = F.coalesce(d2 <= chi2_quantile(1 - tail, P), F.lit(False))
    return joined.select(
        "doc", *BASE, "base_failed", (~F.col("base_failed") & near).alias("kept")
    )


def keep_quality(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return with_verdict(docs, **options).filter("kept").select("doc.*")
