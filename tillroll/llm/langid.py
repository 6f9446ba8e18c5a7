"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text into ``buckets`` per language; a task sends
one row per language and filled bucket, so the shuffle follows the data and no text moves. The
model is a matrix (buckets x languages) of log-probabilities. Its size is ``buckets`` times the
number of languages, checked against ``max_languages`` before it is broadcast. Texts are scored in
numpy: the buckets of a batch are looked up and summed per text.

Cases: null text, or a text without a letter: `und`, score 0; no training text at all: `und` for
every text; null labels are not learned from, and text without letters teaches nothing; ties go
to the smaller label; equal rows are scored alike; other columns are not read, and a kept column
named like a result gets ``_in`` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tokens import slices

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
MAX_LANGUAGES = 500
SMOOTHING = 0.5
UNKNOWN = "und"
_SLICE = 256 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all lower-cased texts, each between two zeros."""
    joined = "\0" + "\0".join(t.lower() for t in texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        every = (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        _LETTER[[c for c in every if chr(c).isalpha()]] = True
    return _LETTER


def ngram_buckets(
    texts: list[str], buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram that has a letter; which texts have letters."""
    codes = _codes([t.replace("\0", " ") for t in texts])
    letter = _letters()[codes]
    # digits, punctuation and white space of any kind all mean the same
    plain = np.where(letter, codes, 1).astype(np.uint64)
    of = np.cumsum(codes == 0) - 1
    some = np.bincount(of[letter], minlength=len(texts))[: len(texts)] > 0
    found, owner = [], []
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value = np.full(m, np.uint64(n))
        any_letter = np.zeros(m, bool)
        for k in range(n):
            value = value * _BASE + plain[k : k + m]
            any_letter |= letter[k : k + m]
        # a gram may start or end on the mark between texts, never run across it
        if n > 2:
            for k in range(1, n - 1):
                any_letter &= codes[k : k + m] != 0
        own = np.minimum(of[:m], len(texts) - 1)
        at = np.flatnonzero(any_letter)
        mixed = value[at] * _MIX
        found.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
        owner.append(own[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), some
    return np.concatenate(found), np.concatenate(owner), some


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def ngram_counts(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    buckets: int = BUCKETS,
    sizes: tuple[int, ...] = SIZES,
) -> DataFrame:
    """(lang, bucket, n) over all rows with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0, _SLICE):
            names = batch.column(1).to_pylist()
            kinds = sorted(set(names))
            number = np.array([kinds.index(x) for x in names], np.int64)
            bucket, own, _ = ngram_buckets(_texts(batch.column(0)), buckets, sizes)
            counts = np.bincount(number[own] * buckets + bucket, minlength=len(kinds) * buckets)
            for i, kind in enumerate(kinds):
                part = counts[i * buckets : (i + 1) * buckets]
                seen[kind] = part + seen.get(kind, 0)
        for kind, counts in seen.items():
            filled = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(filled), pa.string()), pa.array(filled, pa.int32()),
                 pa.array(counts[filled], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return (
        rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .mapInArrow(run, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


class Model:
    """Labels in order and the matrix of log-probabilities."""

    def __init__(self, labels: list[str], table: np.ndarray, sizes: tuple[int, ...]):
        self.labels, self.table, self.sizes = labels, table, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Label and its posterior probability."""
        if not self.labels or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bucket, own, some = ngram_buckets(texts, len(self.table), self.sizes)
        sums = np.empty((len(texts), len(self.labels)))
        for k in range(len(self.labels)):
            sums[:, k] = np.bincount(own, self.table[bucket, k], len(texts))
        best = sums.argmax(axis=1)
        top = sums.max(axis=1, keepdims=True)
        score = np.where(some, 1 / np.exp(np.maximum(sums - top, -700)).sum(axis=1), 0.0)
        return [self.labels[b] if s else UNKNOWN for b, s in zip(best, some)], score


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    buckets: int = BUCKETS,
    sizes: tuple[int, ...] = SIZES,
    smoothing: float = SMOOTHING,
    max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Learn from all rows of ``labelled`` that have a label."""
    counts = ngram_counts(labelled, text, lang, buckets, sizes)
    # one row per language, holding at most `buckets` counts
    rows = (
        counts.groupBy("lang")
        .agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
        .limit(max_languages + 1)
        .toArrow()
    )
    if rows.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages: the matrix would be too large")
    table = np.zeros((buckets, rows.num_rows))
    labels = rows.column("lang").to_pylist()
    order = sorted(range(len(labels)), key=labels.__getitem__)
    lists = rows.column("c").combine_chunks()
    for k, i in enumerate(order):
        cells = lists[i].values
        table[cells.field("bucket").to_numpy(), k] = cells.field("n").to_numpy()
    table = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * buckets))
    return Model([labels[i] for i in order], table, tuple(sizes))


_RESULTS = ("held_out", "lang_pred", "score")


def _named(keep: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"{c}_in" if c in _RESULTS else c) for c in keep]


def identify(
    docs: DataFrame, model: Model, keep: list[str], text: str = "text", held_out: Column | None = None
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, and ``held_out`` if given."""
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.sizes))
    more = [] if held_out is None else [held_out.alias("held_out")]
    kept = F.struct(*_named(keep), *more).alias("kept")
    chosen = docs.select(kept, F.col(f"`{text}`").alias("text"))
    kind = chosen.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in slices(batches, 1, _SLICE):
            label, score = own.predict(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label, pa.string()), pa.array(score)],
                names=["kept", "lang_pred", "score"],
            )

    found = chosen.mapInArrow(run, f"kept {kind}, lang_pred string, score double")
    return found.select("kept.*", "lang_pred", "score")


def identify_held_out(
    docs: DataFrame, held_out: Column, keep: list[str], text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    model = train(docs.filter(~held_out), text, lang, **options)
    return identify(docs, model, keep, text, held_out)
