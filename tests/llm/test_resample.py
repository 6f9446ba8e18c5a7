"""Importance resampling against plain Python, on awkward rows and on skewed scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_rows as cases
import pytest
from pyspark.sql import functions as F

from tillroll.llm import resample

TARGET = [(0, "th er on an re"), (1, None), (2, "ch sch ein UNG ung"), (3, "")]


def features(text, longest):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), runs


def plain(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for x in texts for f in features(x, longest)[1])

    s, t = count(r[1] for r in rows), count(x for _, x in target)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text, *_ in rows:
        words, found = features(text, longest)
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
            for b in (zlib.crc32(f.encode()) % buckets for f in found)
        ]
        weight = sum(gain) // len(gain) if gain else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc_id, len(found), weight, score, words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = Counter((*r[:4], i) for i, r in enumerate(able[: len(able) * percent // 100], 1))
    for r in able[len(able) * percent // 100 :] + [r for r in out if r[4] < least]:
        rank[(*r[:4], None)] += 1
    return rank


def target_of(spark):
    return spark.createDataFrame(TARGET, "item_id long, text string")


def found(df, *args, **options):
    got = resample.resample(df, *args, **options)
    rows = got.select("doc.doc_id", "n_features", "weight", "score", "rank").collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("longest, percent", [(1, 10), (1, 50), (2, 35), (3, 100), (1, 0)])
def test_equals_plain_python(spark, corpus, longest, percent):
    got = found(corpus, target_of(spark), longest=longest, percent=percent, buckets=97)
    assert got == plain(cases.rows(), TARGET, longest, 97, percent)


def test_margins_do_not_matter(spark, corpus):
    """A bracket that misses on either side is widened by the exact counts."""
    want = plain(cases.rows(), TARGET, percent=30)
    for margin in (0.0, 0.3, 1.0):
        assert found(corpus, target_of(spark), percent=30, margin=margin) == want


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Ab", "cde", "ü9", "x-y"]) for _ in range(500))
    whole = [sorted(b.tolist()) for _, b in resample.feature_buckets(text.encode(), 3, 50)]
    monkeypatch.setattr(resample, "_PIECE", 7)
    parts = [x for _, b in resample.feature_buckets(text.encode(), 3, 50) for x in b.tolist()]
    assert sorted(parts) == whole[0]


def test_ties_copies_and_empty(spark, empty):
    copies = [(i % 4, "same words " * 15, "en", "hot", 1) for i in range(200)]
    df = cases.table(spark, copies)
    got = found(df, target_of(spark), percent=33)
    assert got == plain(copies, TARGET, percent=33)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, 67))
    assert found(empty, target_of(spark)) == Counter()
    assert found(df, target_of(spark).limit(0)) == plain(copies, [])


def test_clashing_names_are_carried(corpus):
    clash = corpus.withColumns({"id": F.lit(1), "doc": F.lit(2), "weight": F.lit("w"), "score": F.lit("s")})
    got = resample.resample(clash, corpus.limit(3)).select("doc.*", F.col("rank").alias("r"))
    assert got.filter("weight <> 'w' OR score <> 's' OR rank <> 'my rank'").count() == 0
    assert got.count() == corpus.count()
