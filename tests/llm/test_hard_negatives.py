"""Hard negatives against scoring every pair, and the intervals against true scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitloom.llm import hard_negatives as hard
from commitloom.llm.common import prepare

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("windows", T.StringType()),
])


def brute(rows, every):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    made = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:5]:
            some = [i for i in order if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            made += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(some[:3])]
    return sorted(made)


def mined(spark, rows, every, **options):
    prepare(spark)
    df = spark.createDataFrame([(i, v, label, "x", None) for i, v, label in rows], SCHEMA)
    found = hard.mine(df, "embedding", F.col("label"), F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [
        (i, (centres[i % 6] + 0.4 * rng.normal(size=width)).tolist(), int(rng.integers(0, 3))) for i in range(n)
    ]


def test_equals_scoring_every_pair(spark):
    rows = clustered(300, 8, 1)
    assert mined(spark, rows, 10) == brute(rows, 10) != []


def test_small_groups_and_salts(spark):
    rows = clustered(200, 5, 2)
    assert mined(spark, rows, 4, group=16, asked=9) == brute(rows, 4) != []


def test_awkward_rows(spark):
    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, vector(), rng.randrange(2)) for i in range(60)]  # many ties
    rows += [(60, None, 1), (61, [1.0, None, 0.0, 0.0], 1), (62, [math.nan] * 4, 0), (63, [math.inf, 0.0, 0.0, 0.0], 0)]
    rows += [(None, vector(), 1), (64, vector(), None), (70, [0.0] * 4, 1), (80, [], 0), (75, [1.0], 1), (85, [1.0] * 6, 0)]
    rows += [(-5, vector(), 1), (5, vector(), 1), (5, vector(), 0), (10, rows[10][1], rows[10][2])]
    rows += [(90 + k, [0.5, 0.5, 0.0, 1.0], k % 2) for k in range(30)]  # copies
    assert mined(spark, rows, 5) == brute(rows, 5) != []


def test_huge_components_stay_whole(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**19 for _ in range(3)], i % 2) for i in range(40)]
    got = mined(spark, rows, 5)
    assert got == brute(rows, 5) != [] and max(r[4] for r in got) > 1 << 53


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 0)], [(50, None, None)]])
def test_small_tables(spark, rows):
    assert mined(spark, rows, 50) == brute(rows, 50)


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(5)
    for scale in (1, 1e3, 1e6):
        a = np.floor(rng.normal(size=(40, 6)) * scale)
        b = np.concatenate([a[:20], -a[:5], np.floor(rng.normal(size=(40, 6)) * scale)])
        directions, _ = hard.unit(np.concatenate([a[:3], rng.normal(size=(4, 6))]))
        (u, n), (v, m) = hard.unit(a), hard.unit(b)
        own, other = hard.angles(u, directions), hard.angles(v, directions)
        true = a @ b.T
        low, high = hard.bounds(own, n, other, other, m, m)
        assert (low <= true).all() and (true <= high).all()
        cell = [x[None] for x in (other.min(axis=0), other.max(axis=0))]
        low, high = hard.bounds(own, n, *cell, m.min(keepdims=True), m.max(keepdims=True))
        assert (low <= true.min(axis=1, keepdims=True)).all() and (true.max(axis=1, keepdims=True) <= high).all()


def test_intervals_spare_scores():
    """Of clustered vectors most pairs need no score for a window near the top."""
    rows = clustered(600, 8, 6)
    matrix = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], float)
    u, n = hard.unit(matrix)
    directions, _ = hard.unit(np.array([matrix[k] for k in range(6)]))
    own = hard.angles(u, directions)
    low, high = hard.bounds(own, n, own, own, n, n)
    limit = np.sort(matrix @ matrix.T, axis=1)[:, -5]
    assert (high >= limit[:, None]).mean() < 0.5
