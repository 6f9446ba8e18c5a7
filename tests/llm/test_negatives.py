"""Hard negatives against brute force: random, clustered, copied and awkward vectors."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import negatives
from tillroll.llm.cover_tree import CoverTree, Window

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, low=80, high=100):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = Counter()
    for a, (anchor, query, own) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(query, v)), i is None, i or 0, n, label)
            for n, (i, v, label) in enumerate(used) if n != a
        )
        for down, none, positive, _, label in [s for s in scored if s[4] == own][:k]:
            score = -down
            window = [s for s in scored if s[4] != own and low * score <= -100 * s[0] <= high * score]
            for rank, (d, no_id, other, *_) in enumerate(window[:k], 1):
                out[(anchor, None if none else positive, rank, None if no_id else other, score, -d)] += 1
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(df, F.col("id") % 100 == 0, label=label, **options)
    return Counter(tuple(r) for r in got.collect())


def vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, d))
    which = rng.integers(0, 6, n)
    points = middle[which] + spread * rng.normal(size=(n, d))
    return [(i, p.astype(np.float32).tolist(), int(w) % 4) for i, (p, w) in enumerate(zip(points, which))]


@pytest.mark.parametrize("spread, block, pack", [(0.05, 64, 2), (1.0, 4096, 512), (0.4, 100, 1)])
def test_equals_brute_force(spark, spread, block, pack):
    rows = vectors(4, 620, 6, spread)
    want = plain(rows)
    assert want and mined(spark, rows, block=block, pack=pack) == want


def test_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i * 25, [rng.choice([0.5, 1.0, -0.25]) for _ in range(3)], i % 3) for i in range(60)]
    rows += [(900, [1.0, 1.0, 1.0], 2)] * 40  # copies, anchors among them
    rows += [(1, None, 1), (2, [1.0, None, 1.0], 1), (3, [1.0, math.inf, 0.0], 1), (4, [math.nan] * 3, 1),
             (5, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 0.9], 1), (None, [0.9, 1.0, 1.0], 2),
             (100, [], 1), (200, [1.0], 1), (700, [3e30, 0.0, 0.0], 8)]
    rows = [r for r in rows if r[0] != 700]
    padded = [(i, v + [0.0] * (3 - len(v)) if v is not None else v, c) for i, v, c in rows]
    assert mined(spark, rows, block=16, pack=3) == plain(padded)


def test_nothing_to_find(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(100, [1.0], 1)])
    assert not mined(spark, [(100, [1.0], 1), (101, [1.0], 1)])
    assert not mined(spark, [(3, [1.0], 1), (101, [1.0], 2)])
    extra = spark.createDataFrame([(100, [1.0], 1, "x", 2)], SCHEMA + ", row string, id int")
    assert negatives.mine(extra, F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_tree_covers_and_skips(seed):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-300, 300, (8, 5))
    points = (middle[rng.integers(0, 8, 400)] + rng.integers(-6, 7, (400, 5))).astype(np.int32)
    points[:50] = points[0]
    ids = np.arange(400)
    built = CoverTree(points, ids, ids, np.zeros(400, bool), np.zeros(400, np.int64))
    tree = CoverTree.load(built.dump())
    assert sorted(tree.order) == list(range(400))
    top = int((points.astype(np.int64) ** 2).sum(axis=1).max())
    lifted = np.column_stack([points, np.sqrt(top - (points.astype(np.int64) ** 2).sum(axis=1))])

    def members(i):
        a, b = tree.children[i]
        own = tree.order[slice(*tree.members[i])].tolist()
        return own + [m for c in range(a, b) for m in members(c)]

    for i in range(len(tree.node)):
        far = np.sqrt(((lifted[members(i)] - lifted[tree.node[i]]) ** 2).sum(axis=1)).max()
        assert far <= tree.radius[i] + 1e-9
        a, b = tree.children[i]
        assert (tree.radius[a:b] <= tree.radius[i] / 2 + 1e-9).all()

    looked = []
    offer = tree._offer
    tree._offer = lambda m, *rest: (looked.append(len(m)), offer(m, *rest))[1]
    score = points.astype(np.int64) @ points[7].astype(np.int64)
    window = Window(int(score.max()) * 9 // 10, int(score.max()) * 97 // 100, 5, [])
    tree.search(points[7], 7, 1, False, [window])
    inside = [(-s, False, i, i) for i, s in enumerate(score.tolist()) if window.low <= s <= window.high]
    assert window.found == sorted(inside)[:5]
    assert sum(looked) < 400  # whole nodes outside the window were never opened


def test_large_values_stay_exact():
    points = np.array([[2.0**28, 3.0], [2.0**28, 4.0], [1.0, 1.0]])
    tree = CoverTree(points, np.arange(3), np.arange(3), np.zeros(3, bool), np.zeros(3, np.int64))
    window = Window(-math.inf, math.inf, 3, [])
    tree.search(points[0], 0, 0, True, [window])
    assert [(-d, i) for d, _, i, _ in window.found] == [(2**56 + 12, 1), (2**28 + 3, 2)]
