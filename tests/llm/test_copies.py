"""Suffix dedup, SimHash and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_rows as cases
import numpy as np
import pytest
import xxhash

from tillroll.llm import phrases, simhash, suffixes
from tillroll.llm.graph import components

ALL = cases.rows()


def plain_spans(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [40, 400])
def test_repeated_strings_are_cut(corpus, length):
    texts = [(r[1] or "").encode() for r in ALL]
    want = Counter((r[0], *w) for r, w in zip(ALL, plain_spans(texts, length)))
    got = suffixes.remove_repeats(corpus, length)
    rows = got.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)


def test_a_hot_passage_and_periods(spark):
    rng = random.Random(2)
    passage = cases.prose(rng, 30)
    rows = [
        (i, cases.prose(rng, rng.randint(0, 40)) + (passage if i % 3 else "") + cases.prose(rng, 10), "en", "s", 1)
        for i in range(150)
    ]
    rows += [(900, "ab" * 300, "en", "s", 1), (901, "x" * 77, "en", "s", 1), (902, "x" * 39, "en", "s", 1)]
    texts = [r[1].encode() for r in rows]
    got = suffixes.remove_repeats(cases.table(spark, rows).repartition(7), 40, with_kept=False)
    assert Counter(map(tuple, got.collect())) == Counter(
        (r[0], *w) for r, w in zip(rows, plain_spans(texts, 40))
    )


def test_multikey_order():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 5, 5000).astype(np.uint64) for _ in range(3)]
    got = suffixes.multikey_order(tokens)
    rows = list(zip(*(t.tolist() for t in tokens)))
    assert [rows[i] for i in got] == sorted(rows)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    known = sorted(set(fps))
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_near_duplicates(corpus):
    fps = [plain_fingerprint(r[1]) for r in ALL]
    root = plain_components(fps)
    least = defaultdict(list)
    for r, f in zip(ALL, fps):
        least[root[f]] += [r[0]] if r[0] is not None else []
    want = Counter(
        (r[0], f"{f:016x}", min(least[root[f]], default=None)) for r, f in zip(ALL, fps)
    )
    assert Counter(map(tuple, simhash.near_duplicates(corpus).collect())) == want
    kept = simhash.keep_one(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len(set(root.values()))


@pytest.mark.parametrize("block", [8, 4096])
def test_links_of_dense_groups(spark, block):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(200)} | {centre, 0, (1 << 64) - 1}
    for _ in range(300):
        fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 6))) & (1 << 64) - 1)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.close_links(df, block=block)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f, r in plain_components(list(fps)).items():
        want[r].add(f)
    for f in signed:
        got[found.get(f, f)].add(f & (1 << 64) - 1)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    order = list(range(40))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (5, 5)], "a long, b long")
    found = components(links).collect()
    assert {r["node"] for r in found} == {*order, 100, 101}
    assert len({r["root"] for r in found if r["node"] < 100}) == 1


WORD = (1 << 64) - 1


def scramble(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


def plain_level(names):
    """Runs, three coin tosses, phrases from each local maximum on: one name after another."""
    merged = []
    for name in names:
        if merged and merged[-1][0] == name:
            merged[-1][1] += 1
        else:
            merged.append([name, 1])
    names = [scramble((n + 0x9E3779B97F4A7C15 * k) & WORD) if k > 1 else n for n, k in merged]
    colours = names
    for _ in range(3):
        tossed = [colours[0] & 1]
        for left, own in zip(colours, colours[1:]):
            bit = ((left ^ own) & -(left ^ own)).bit_length() - 1 if left != own else 64
            tossed.append(2 * (bit & 63) + (own >> (bit & 63) & 1))
        colours = tossed
    phrases_, last = [], len(names) - 1
    for i, name in enumerate(names):
        peak = 0 < i < last and colours[i - 1] < colours[i] >= colours[i + 1]
        if i == 0 or peak:
            phrases_.append([])
        phrases_[-1].append(name)
    return [
        scramble(sum(scramble((n + 0x9E3779B97F4A7C15 * (i + 1)) & WORD) for i, n in enumerate(p)) & WORD)
        for p in phrases_
    ]


def plain_fingerprint_of(text, slots=64):
    least, names, level = [None] * slots, [ord(c) + 1 for c in text], 0
    while names:
        if level >= 2 or len(names) == 1:
            for name in names:
                value = scramble((name + level * 0xBF58476D1CE4E5B9) & WORD)
                slot = value % slots
                least[slot] = value if least[slot] is None else min(least[slot], value)
        if len(names) == 1:
            break
        names, level = plain_level(names), level + 1
    return [0 if v is None else (v >> 20) % 65535 + 1 for v in least]


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints(corpus):
    """Against the parsing written out one name at a time."""
    rows = sorted(ALL, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    edited = [
        a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])
    ]
    own, other = ([plain_fingerprint_of(t) for t in some] for some in (texts, edited))

    def written(f):
        return "".join(f"{x:04x}" for x in f)

    want = Counter(
        (r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), written(f), written(g),
         plain_likeness(f, g), plain_likeness(f, h))
        for r, t, e, f, g, h in zip(rows, texts, edited, own, other, own[1:] + own[:1])
    )
    assert Counter(map(tuple, phrases.with_fingerprints(corpus).collect())) == want


@pytest.mark.parametrize("n", [0, 1, 2, 17, 400])
def test_every_id_finds_its_range(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(0, 900, 3)]), f"text {i}", "en", "s", 1) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = phrases.with_fingerprints(cases.table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])]
    assert Counter(r["edited_sha256"] for r in got) == Counter(
        hashlib.sha256(e.encode()).hexdigest() for e in edited
    )


def test_shared_text_is_seen_at_any_offset():
    rng = random.Random(4)
    body = cases.prose(rng, 400)
    texts = [body, "x" + body, cases.prose(rng, 7) + body, cases.prose(rng, 400), body, ""]
    found = phrases.short(phrases.sketches(texts))

    def alike(i, j):
        return phrases.likeness(found[i : i + 1], found[j : j + 1])[0]

    assert alike(0, 1) > 0.8 and alike(0, 2) > 0.8
    assert alike(0, 3) < 0.2 and alike(0, 4) == 1 and alike(5, 5) == 1 and alike(0, 5) == 0
    # phrases inside equal substrings are equal
    names, owner = phrases.next_level(
        np.array([ord(c) for c in texts[0] + texts[1]], np.uint64),
        np.repeat([0, 1], [len(body), len(body) + 1]),
    )
    first, second = set(names[owner == 0].tolist()), set(names[owner == 1].tolist())
    assert len(first ^ second) <= 6


def test_empty_tables(empty):
    assert suffixes.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert phrases.with_fingerprints(empty).count() == 0


def test_a_text_that_repeats_itself_is_collapsed_before_the_shuffle(spark):
    """A hot passage in few documents: exact, and no bucket holds all of it."""
    rng = random.Random(3)
    hot = "the very same passage of words " * 3000
    rows = [(1, hot, "en", "s", 1), (2, "x" + hot, "en", "s", 1)]
    rows += [(10 + i, cases.prose(rng, 150), "en", "s", 1) for i in range(60)]
    df = cases.table(spark, rows).repartition(4)
    none = np.zeros((0, 4), np.uint64)
    made = suffixes._run_suffixes(suffixes.numbered(df, "doc_id", "text"), none, 400).toPandas()
    still = made[made.known != suffixes._DONE]
    assert len(made) > 2000 and still.groupby(["t0", "t1"]).size().max() <= 4  # one per task
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(df).collect()}
    assert got[1] == len(hot) and got[2] >= len(hot) and not any(got[10 + i] for i in range(60))


def test_buckets_of_suffixes_equal_to_splitters():
    rng = np.random.default_rng(5)
    tokens = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    splitters = np.unique(np.stack([t[:40] for t in tokens], axis=1), axis=0)
    want = [sum(tuple(s) < own for s in splitters.tolist()) for own in zip(*(t.tolist() for t in tokens))]
    assert suffixes._bucket_of(splitters, tokens).tolist() == want
