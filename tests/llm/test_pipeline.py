"""The pipeline and the SQL twins."""

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_rows as cases
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cleaning import plain_counts, plain_targets
from test_copies import plain_components, plain_fingerprint
from test_tokens import crc, encoded

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from checks.compare import connect, difference  # noqa: E402
from tillroll.llm import line_dedup, quality, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_twins(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert difference(got, connect(SF), registry.ORACLE_SQL[name]) is None


def test_stages(spark, corpus):
    docs = corpus.drop("kept")
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, SF)
        assert got.columns == docs.columns, name
        docs = got.cache()
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.filter("length > 2048 or offset < 0").count() == 0
    assert got.count() > 100


def test_much_copied_documents_stay(spark):
    rng = random.Random(3)
    texts = [cases.prose(rng, 120) for _ in range(42)]
    copied = texts[:2]
    rows = [(i, t, "en", "site", len(t)) for i, t in enumerate(texts[2:] + copied[:1] * 20 + copied[1:] * 4)]
    docs = cases.table(spark, rows)
    for _, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, SF).cache()
    found = {r["text"] for r in docs.select("text").collect()}
    # mixing may cut one text at its target; a copied one is long enough to be seen
    assert all(any(x and t.startswith(x) for x in found) for t in copied)
    assert len(found) >= len(texts) and "" not in found


def _border(bins, share):
    return np.sort(bins)[int(np.ceil(len(bins) * share)) - 1]


def _nearest(d2):
    bins = np.floor(200 * np.log(np.clip(d2, 1e-9, 1e8)))
    return bins <= _border(bins, quality.HALF)


def _distances(x, subset, share):
    """Of all rows from the estimate over ``subset``, and the root of its determinant."""
    inside, floors = x[subset], np.array(quality.FLOORS)
    mean = inside.mean(axis=0)
    scatter = (inside.T @ inside / len(inside) - np.outer(mean, mean)) * quality._consistency(share)
    scatter[np.diag_indices(quality.P)] = np.maximum(np.diag(scatter), 0) + floors**2
    root = np.linalg.cholesky(scatter)
    return (np.linalg.solve(root, (x - mean).T) ** 2).sum(axis=0), np.diag(root).prod()


def plain_quality(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        n, chars, symbols, lines, words = plain_counts(r[1])
        if n >= corpus_pipeline.MIN_WORDS and 100 * words <= 50 * n:
            rates = [np.log1p(100 * c / n) for c in (symbols, lines, words)]
            groups[r[2:4]].append((r, [np.log(chars / n), *rates]))
    for found in groups.values():
        x = np.array([v for _, v in found])
        bins = np.floor(x * 1000)
        centre = np.array([_border(c, 0.5) for c in bins.T])
        spread = np.array([_border(c, 0.5) for c in abs(bins - centre).T])
        d2 = (((x - centre / 1000) / np.maximum(spread * 0.0014826, quality.FLOORS)) ** 2).sum(axis=1)
        d2, _ = _distances(x, _nearest(d2), quality.HALF)
        least, fell = np.inf, True
        while fell:
            d2, det = _distances(x, _nearest(d2), quality.HALF)
            fell, least = det < least * (1 - quality.FALL), min(det, least)
        d2, _ = _distances(x, d2 <= quality.chi2_quantile(0.975, quality.P), 0.975)
        near = d2 <= quality.chi2_quantile(1 - quality.TAIL, quality.P)
        out += [r for (r, _), ok in zip(found, near) if ok]
    return out


def plain_lines(rows):
    pages, on = Counter(s for s, _ in {(r[3], r[1]) for r in rows}), Counter()
    for source, text in {(r[3], r[1]) for r in rows}:
        on.update((source, x) for x in {x.strip(" \t\r") for x in text.split("\n")} - {""})

    def stays(source, line):
        n = on[source, line.strip(" \t\r")]
        return not n - line_dedup.ALLOWANCE > line_dedup.MAX_RATIO * pages[source]

    return [
        (r[0], "\n".join(x for x in r[1].split("\n") if stays(r[3], x)), *r[2:]) for r in rows
    ]


def plain_one_of_each(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(fps)
    group, least = [root[f] for f in fps], {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r[0]), r[0])
    return [r for r, g in zip(rows, group) if r[0] == least[g]]


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    goal, out = plain_targets(sizes), []
    for source, size in sizes.items():
        epochs, rest = divmod(int(goal[source] + 0.5), size)
        own = [r for r in rows if r[3] == source]
        for r in sorted(own, key=lambda r: hashlib.md5(f"{r[0]}mix-1{r[1]}".encode()).hexdigest()):
            words = r[1].split()
            take = min(len(words), rest)
            rest -= take
            if words:
                out += [r] * (epochs + (take == len(words)))
                out += [(r[0], " ".join(words[:take]))] * (0 < take < len(words))
    return out


def plain_pieces(rows):
    out = Counter()
    for r in rows:
        ids = encoded(corpus_pipeline.VOCABULARY, r[1], 0)
        for p, a in enumerate(range(0, len(ids), 2048)):
            out[r[0], p, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])] += 1
    return out


def chain_rows():
    """Clean texts, half a source of copies, a third of one of junk copies, common lines, odd rows."""
    rng = random.Random(21)
    texts = [(cases.prose(rng, rng.randint(60, 300)), "ab"[i % 2]) for i in range(60)]
    texts = [("Subscribe to our letter\n" + t if i % 3 == 0 else t, s) for i, (t, s) in enumerate(texts)]
    copied = cases.prose(rng, 150)
    junk = " ".join(w + "#$%" for w in cases.prose(rng, 120).split())
    texts += [(copied, "a")] * 30 + [(junk, "b")] * 15 + [(cases.prose(rng, 3000), "b")]
    texts += [(texts[1][0].replace(" ", "  ", 4), "b"), (texts[3][0] + "\n", "a")]
    texts += [(None, "a"), ("", "b"), ("too short", "a"), ("the same again " * 60, "b")]
    rng.shuffle(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(texts)]
    return rows, copied, junk


def test_run_is_the_plain_chain(spark, tmp_path):
    rows, copied, junk = chain_rows()
    cases.table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = rows
    for step in (plain_quality, plain_lines, plain_one_of_each, plain_mix):
        kept = step(kept)
    assert Counter(tuple(r)[:5] for r in got) == plain_pieces(kept)
    ids = {text: {r[0] for r in rows if r[1] == text} for text in (copied, junk)}
    assert len({r[0] for r in kept} & ids[copied]) == 1 and not {r[0] for r in kept} & ids[junk]
