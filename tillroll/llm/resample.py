"""Importance resampling towards a target distribution.

Every feature (a run of words) falls into a bucket. A bucket's gain says how much commoner it is
in the target than in the corpus; the gains are one array of ``buckets`` numbers (8 bytes each),
which is broadcast, and a text's weight is the floored mean over its features, looked up in numpy.
Gumbel noise from a hash of the id makes the highest scores a weighted draw without replacement.

The cut is found without sorting the corpus: a quantile sketch brackets it, exact counts outside
the bracket accept it or widen the side that missed, and only rows inside are sorted to locate
the last row drawn. Drawn rows are then range-split for their ranks.

Cases: null and empty texts have no feature and weight 0; a null id is hashed as empty text and
comes last among equal scores; repeated rows are rows of their own, and where the cut falls among
equal rows as many of them are drawn as fit; an empty target or corpus counts nothing, which
leaves plain smoothing; other columns are carried in one struct, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import whole_rows
from tillroll.llm.tokens import slices
from tillroll.operators.scale import running_total
from tillroll.plans.staging import stage

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: the sketch brackets the cut by this share of the rows on both sides at first
MARGIN = 0.002
_PIECE = 256 << 10
_SLICE = 256 << 10

#: A-Z in lower case; every other ASCII character but 0-9 and a-z ends a word
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of one text, some megabytes at a time."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            # no word is cut: go on to its end
            while end < len(raw) and _PLAIN[raw[end]] != 32:
                end += 1
        yield raw[at:end].translate(_PLAIN).split(b" ")
        at = end


def feature_buckets(raw: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for each piece of a text."""
    before: list[bytes] = []
    for piece in _pieces(raw):
        features = words = [w for w in piece if w]
        both = before + words if longest > 1 else words
        for n in range(2, longest + 1):
            first = max(0, len(before) - n + 1)
            runs = zip(*(both[first + k :] for k in range(n)))
            features = [*features, *map(b" ".join, runs)]
        before = both[len(both) - longest + 1 :] if longest > 1 else []
        codes = np.fromiter(map(zlib.crc32, features), np.int64, len(features))
        yield len(words), codes % buckets


def bucket_counts(
    docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """(bucket, n) over all features of all rows; a task sends one row per bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0, _SLICE):
            for raw in batch.column(0):
                for _, found in feature_buckets(raw.as_py() or b"", longest, buckets):
                    seen += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array(seen[filled], pa.int64())],
            names=["bucket", "n"],
        )

    return (
        docs.select(F.col(text).cast("binary").alias("raw"))
        .mapInArrow(run, "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )


def gains(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target over corpus, floored."""
    sides = bucket_counts(docs, text, longest, buckets).withColumn("target", F.lit(False)).union(
        bucket_counts(target, text, longest, buckets).withColumn("target", F.lit(True))
    )
    counts = np.zeros((2, buckets), np.int64)
    for row in sides.collect():  # two rows per bucket at most
        counts[int(row.target), row.bucket] = row.n
    s, t = counts.tolist()
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array(
        [
            math.floor(1000 * math.log(float((b + 1) * all_s) / float((a + 1) * all_t)))
            for a, b in zip(s, t)
        ],
        np.int64,
    )


def weighted(
    rows: DataFrame, gain: np.ndarray, longest: int = 1
) -> DataFrame:
    """(doc, id, n_words, n_features, weight, mark) of rows (doc, id, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(gain)
    doc, key = (rows.schema[c].dataType.simpleString() for c in ("doc", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches, 2, _SLICE):
            out = []
            for raw in batch.column(2):
                data, n_words, n, total = raw.as_py() or b"", 0, 0, 0
                for words, found in feature_buckets(data, longest, len(table)):
                    n_words, n, total = n_words + words, n + len(found), total + int(table[found].sum())
                out.append((n_words, n, total // n if n else 0, zlib.crc32(data)))
            made = (pa.array(c, pa.int64()) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made],
                names=["doc", "id", "n_words", "n_features", "weight", "mark"],
            )

    return rows.select("doc", "id", F.col("text").cast("binary")).mapInArrow(
        run,
        f"doc {doc}, id {key}, n_words bigint, n_features bigint, weight bigint, mark bigint",
    )


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate drawn by the hash of ``seed:key``, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.substring(F.sha2(text.cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform))).cast("bigint")


def _place(scored: DataFrame) -> list[Column]:
    """Highest score first, then the smaller id; equal rows are told apart by nothing."""
    key = F.col("id")
    return [(-F.col("score")).alias("down"), key.isNull().alias("none"), key, F.col("n_features"), F.col("mark")]


def bracket(scored: DataFrame, rows: int, wanted: int, margin: float = MARGIN) -> tuple[int, int, int]:
    """(low, high, above): the ``wanted``-th highest score of ``rows`` lies in low..high.

    ``above`` rows score more than ``high``. The borders come from a sketch; the counts are exact,
    and a side that misses is moved out until it holds, to the extreme score at last.
    """
    at, below, over = 1 - wanted / rows, margin, margin
    while True:
        shares = [max(0.0, at - below), min(1.0, at + over)]
        low, high = scored.agg(F.percentile_approx("score", shares, 10_000)).first()[0]
        if shares[0] == 0.0 or shares[1] == 1.0:
            least, most = scored.agg(F.min("score"), F.max("score")).first()
            low = least if shares[0] == 0.0 else low
            high = most if shares[1] == 1.0 else high
        above, reached = scored.agg(
            F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)
        ).first()
        if above < wanted <= reached:
            return low, high, above
        if above >= wanted:
            over = over * 2 + 1 / rows
        if reached < wanted:
            below = below * 2 + 1 / rows


def ranked(scored: DataFrame, wanted: int, rows: int, margin: float = MARGIN) -> DataFrame:
    """``rank`` of the first ``wanted`` rows (id, score, n_features, mark, ...); null beyond."""
    none = F.lit(None).cast("bigint").alias("rank")
    if wanted <= 0:
        return scored.select("*", none)
    names = [f"_o{i}" for i in range(5)]
    placed = scored.withColumns(dict(zip(names, _place(scored))))
    order = [F.col(n) for n in names]
    if wanted < rows:
        low, high, above = bracket(scored, rows, wanted, margin)
        inside = placed.filter(F.col("score").between(low, high)).select(*names, F.lit(1).alias("one"))
        last = running_total(inside, order, "one").filter(F.col("rank") == wanted - above).first()
        end = F.struct(
            *(F.lit(last[n]).cast(placed.schema[n].dataType).alias(n) for n in names)
        )
        drawn = F.struct(*names) <= end
    else:
        drawn = F.lit(True)
    taken = running_total(placed.filter(drawn).withColumn("one", F.lit(1)), order, "one")
    first = taken.select(
        *scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    )
    return first.union(placed.filter(~drawn).select(*scored.columns, none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    margin: float = MARGIN,
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank) for every row of ``docs``.

    ``doc`` is the row itself, or its columns ``carry``. Of the rows of ``min_words`` words or more, ``percent`` in a
    hundred get a ``rank``; the others' is null.
    """
    gain = gains(docs, target, text, longest, buckets)
    rows = whole_rows(docs, id=F.col(doc_id), text=F.col(text))
    if carry:
        rows = rows.withColumn("doc", F.struct(*(F.col(f"doc.`{c}`") for c in carry)))
    scored = stage(
        weighted(rows, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)),
        "scored",
    )
    long_enough = F.col("n_words") >= min_words
    eligible = scored.filter(long_enough)
    n = eligible.count()
    others = scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    found = ranked(eligible, n * percent // 100, n, margin).union(others)
    return found.select("doc", "n_words", "n_features", "weight", "score", "rank")


def oracle(percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same rows as SQL for DuckDB; the checksum is worked out byte by byte."""
    upper = "".join(map(chr, range(65, 91)))
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), doc_words AS (
  SELECT doc_id, {words} AS words FROM documents
), said AS (
  SELECT word, sum(in_docs) AS s, sum(in_target) AS t FROM (
    SELECT unnest(words) AS word, 1 AS in_docs, 0 AS in_target FROM doc_words
    UNION ALL
    SELECT unnest({words}), 0, 1 FROM benchmark
  ) GROUP BY word
), bytes AS (
  SELECT word, s, t, list_transform(range(strlen(word)),
    lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT) AS b
  FROM said
), bucketed AS (
  SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket
  FROM bytes, codes
), gain AS (
  SELECT bucket, floor(1000 * ln(
    ((sum(t) + 1) * (any_value(all_s) + {buckets}))::DOUBLE
    / ((sum(s) + 1) * (any_value(all_t) + {buckets}))::DOUBLE))::BIGINT AS gain
  FROM bucketed, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM said) GROUP BY bucket
), weights AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM (SELECT doc_id, unnest(words) AS word FROM doc_words)
  JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))
    )::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {min_words}
)
SELECT s.doc_id, n_features, weight, score, rank
FROM scored s LEFT JOIN drawn d ON s.doc_id = d.doc_id AND rank <= {percent} * n // 100
"""
