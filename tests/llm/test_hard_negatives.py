"""Hard negatives against brute force; Strassen's recursion against plain products."""

from math import floor, isfinite
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm.hard_negatives import Heaps, hard_negatives, strassen

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (17, 64, 33), (100, 65, 130), (256, 64, 300), (40, 0, 40)])
def test_strassen(shape):
    m, k, n = shape
    rnd = np.random.default_rng(m)
    a, b = rnd.integers(-300, 300, (m, k)), rnd.integers(-300, 300, (k, n))
    assert (strassen(a, b) == a @ b).all()
    assert (strassen(a, b, leaf=2) == a @ b).all()
    big = (rnd.integers(-(1 << 28), 1 << 28, (m, k)), rnd.integers(-(1 << 28), 1 << 28, (k, n)))
    assert (strassen(*big, leaf=4) == big[0].astype(object) @ big[1].astype(object)).all()


def test_heaps_merge_like_one_sort():
    rnd = np.random.default_rng(1)
    score = rnd.integers(0, 6, (9, 400))
    usable = rnd.random((9, 400)) < 0.4
    order = rnd.permutation(400)
    heap = Heaps(9, 5)
    for i in range(0, 400, 37):
        at = np.arange(i, min(400, i + 37))
        heap.add(score[:, at], usable[:, at], at, order)
    for r in range(9):
        want = sorted(np.flatnonzero(usable[r]), key=lambda c: (-score[r, c], order[c]))[:5]
        assert heap.at[r].tolist() == list(want)


def brute(rows, anchor):
    whole = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            whole.append((i, label, [floor(256 * x) for x in v]))
    hold = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for n, (i, label, v) in enumerate(whole):
        if not anchor(i):
            continue
        scored = sorted((-hold(sum(x * y for x, y in zip(v, w))), j, m) for m, (j, _, w) in enumerate(whole) if m != n)
        for s, j, m in [x for x in scored if whole[x[2]][1] == label][:5]:
            fits = [x for x in scored if whole[x[2]][1] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def vectors(rnd, n, scale=1.0):
    centres = [[rnd.gauss(0.3, 0.4) for _ in range(8)] for _ in range(4)]
    return [[(c + rnd.gauss(0, 0.3)) * scale for c in rnd.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e30])
def test_equals_brute_force(spark, scale):
    rnd = Random(3)
    rows = [(i, v, rnd.choice([0, 0, 0, 1, 2])) for i, v in enumerate(vectors(rnd, 300, scale))]
    rows += [(300 + i, rows[4][1], i % 2) for i in range(60)]  # copies: ties by id
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [nan] * 8, 1), (402, [inf, 1.0], 1), (403, [None, 1.0], 1), (404, rows[0][1], None), (None, rows[0][1], 1), (405, [1.0 * scale], 0), (410, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("id", F.lit(0)).repartition(5)
    want = brute(rows, lambda i: i % 10 == 0)
    for tile in (4096, 50):
        got = hard_negatives(df, F.col("vec_id") % 10 == 0, anchor_rows=2 * tile // 5, tile_rows=tile)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want
    assert want


def test_repeated_rows_and_empty(spark):
    rnd = Random(4)
    rows = [(i % 40, v, i % 3) for i, v in enumerate(vectors(rnd, 80))]
    rows = [(i, rows[i % 40][1], i % 40 % 3) for i, _, _ in rows] + [(1000, rows[0][1], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") == 0).collect())) == brute(rows, lambda i: i == 0)
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []
