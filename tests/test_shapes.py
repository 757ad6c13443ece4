"""Hulls, boxes, diameters, clusters and robust fits on large or awkward groups."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import boxes, fitting, pairs, polar, rangeimage
from pointloom.operators.boxes import hull_rows


def test_hull_of_a_large_ring(spark, monkeypatch):
    monkeypatch.setattr(boxes, "CHUNK", 256)
    a = np.sort(np.random.default_rng(1).uniform(0, 2 * np.pi, 2000))
    ring = np.stack([np.cos(a), np.sin(a)], axis=1)
    inner = np.random.default_rng(2).normal(0, 0.2, (900, 2))
    grid = np.array([(x, y) for x in range(20) for y in range(20)], float)  # corners and many points on edges
    frames = [pd.DataFrame({"g": g, "u": p[:, 0], "v": p[:, 1]}) for g, p in ((0, np.concatenate([ring, inner])), (1, grid), (2, ring[:1]), (3, ring[:40]))]
    got = boxes.convex_hull(spark.createDataFrame(pd.concat(frames)).withColumn("more", F.col("u") + 1), ["g"]).toPandas()
    for g, f in enumerate(frames):
        p = f[["u", "v"]].to_numpy()
        want = {tuple(p[i]) for i in hull_rows(p)}
        mine = got[got["g"] == g]
        assert set(map(tuple, mine[["u", "v"]].to_numpy())) == want and len(mine) == len(want)
    assert np.allclose(got["more"], got["u"] + 1)


def test_slabs_equal_one_hull(spark, monkeypatch):
    monkeypatch.setattr(boxes, "CHUNK", 7)
    rng = np.random.default_rng(5)
    for p in (rng.normal(size=(60, 2)), np.round(rng.normal(size=(80, 2)), 0), np.stack([np.zeros(20), np.arange(20.0)], axis=1)):
        p = np.unique(p, axis=0)
        df = spark.createDataFrame(pd.DataFrame({"g": 1, "u": p[:, 0], "v": p[:, 1]}))
        got = {(r["u"], r["v"]) for r in boxes._hull_by_slabs(df, ["g"]).collect()}
        assert got == {tuple(p[i]) for i in hull_rows(p)}


def test_box_of_a_turned_rectangle(spark):
    rng = np.random.default_rng(3)
    flat = rng.uniform(-1, 1, (400, 2)) * [4.0, 1.5]
    a = math.radians(33.0)
    turned = flat @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    pts = spark.createDataFrame(pd.DataFrame({"g": 1, "x": turned[:, 0], "y": turned[:, 1], "z": rng.uniform(0, 0.5, 400)}))
    normal = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "g long, nx double, ny double, nz double")
    box = boxes.tight_boxes(pts, normal, ["g"]).first()
    assert sorted(box["size"][:2]) == pytest.approx([3.0, 8.0], rel=0.05) and box["size"][2] == pytest.approx(0.5, rel=0.05)
    long = np.array([box["gx"], box["gy"]]) if box["size"][0] > box["size"][1] else np.array([box["hx"], box["hy"]])
    assert abs(long @ [math.cos(a), math.sin(a)]) > math.cos(math.radians(2.0))
    # no candidate angle is better than the one taken
    hull = turned[hull_rows(turned)]

    def score(deg):
        t = math.radians(deg)
        q = hull @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]).T
        lo, hi = q.min(axis=0), q.max(axis=0)
        return np.prod(hi - lo) + np.minimum(q - lo, hi - q).min(axis=1).sum()

    best = boxes.best_angles(spark.createDataFrame(pd.DataFrame({"g": 1, "u": hull[:, 0], "v": hull[:, 1]})), ["g"]).first()
    scores = [score((k + 0.5) * 90 / boxes.ANGLES) for k in range(boxes.ANGLES)]
    assert best["score"] == pytest.approx(min(scores)) and best["angle"] == pytest.approx((int(np.argmin(scores)) + 0.5) * 90 / boxes.ANGLES)


def test_set_diameter(spark):
    rng = np.random.default_rng(4)
    sets = {0: rng.normal(size=(500, 3)), 1: rng.normal(size=(2, 3)), 2: np.ones((3, 3)), 3: np.c_[np.arange(60.0), np.zeros((60, 2))]}
    ball = rng.normal(size=(400, 3))
    sets[4] = ball / np.linalg.norm(ball, axis=1)[:, None]  # all points far apart from some other
    frames = [pd.DataFrame({"g": g, **{a: p[:, i] for i, a in enumerate("xyz")}}) for g, p in sets.items()]
    got = {r["g"]: r["diameter"] for r in fitting.set_diameter(spark.createDataFrame(pd.concat(frames)), ["g"]).collect()}
    for g, p in sets.items():
        assert got[g] == pytest.approx(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)).max())


def test_clusters_with_a_full_cell(spark):
    rng = np.random.default_rng(6)
    full = rng.uniform(0, 0.5, (20000, 3))  # one cell of a tolerance of one
    near = full[np.argmax(full[:, 0])] + [0.95, 0.0, 0.0]
    far = np.array([[10.0, 0, 0], [10.7, 0, 0], [11.6, 0.3, 0], [13.0, 0, 0]])
    p = np.concatenate([full, [near], far])
    df = spark.createDataFrame(pd.DataFrame({"cloud": 1, "id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    out = polar.euclidean_cluster(df, ["cloud"], 1.0).toPandas().sort_values("id")
    names = [tuple(dict(c).values()) for c in out["cluster"]]
    assert len(set(names[:20001])) == 1 and len({*names[20001:20004]}) == 1 and len(set(names)) == 3


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 9, (260, 3))
    df = spark.createDataFrame(pd.DataFrame({"cloud": 1, "id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    out = polar.euclidean_cluster(df, ["cloud"], 1.1).toPandas().sort_values("id")
    root = np.arange(len(p))
    for i, j in np.argwhere(((p[:, None] - p[None]) ** 2).sum(axis=2) <= 1.1**2):
        a, b = root[i], root[j]
        root[root == b] = a
    names = [tuple(dict(c).values()) for c in out["cluster"]]
    assert all((names[i] == names[j]) == (root[i] == root[j]) for i in range(0, 260, 3) for j in range(260))


def test_ransac_draws_on_one_row_of_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in ((0, 40), (1, 9), (None, 6)):
        s = rng.uniform(-20, 20, (n, 3))
        t = s + [1.0, 2.0, 3.0] + rng.normal(0, 0.3, (n, 3))
        rows += [(g, i, i // 2, i, *map(float, s[i]), *map(float, t[i])) for i in range(n)]
    rows += [(0, 7, 90, 91, *map(float, rng.uniform(-20, 20, 6))), (0, 44, 92, 93, *map(float, rng.uniform(-20, 20, 6)))]  # repeated and beyond a gap
    rows += [(0, 40, None, 94, *rows[3][4:]), (0, 41, 95, 95, None, *rows[4][5:])]
    corr = spark.createDataFrame(rows, "g long, corr_id long, src_id long, tgt_id long, sx double, sy double, sz double, tx double, ty double, tz double")

    def fitted():
        return {x["g"]: (x["inliers"], x["drawn"], x["converged"], np.round(x["tf"], 6).tolist()) for x in fitting.ransac_fit(corr, ["g"], 0.5, block=100, most=5_000).collect()}

    with monkeypatch.context() as m:
        m.setattr(fitting, "_PACKED", 0)
        by_joins = fitted()

    def joined(*_):
        raise AssertionError("small pairs need no joins")

    monkeypatch.setattr(fitting, "_drawn", joined)
    assert fitted() == by_joins and by_joins[0][0] > 10


def test_ransac_stops_by_confidence(spark):
    rng = np.random.default_rng(8)
    a = 0.7
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    rows = []
    for g, (n, good) in enumerate(((400, 20), (60, 48), (5, 0))):
        s, t = rng.uniform(-20, 20, (n, 3)), rng.uniform(-20, 20, (n, 3))
        t[:good] = s[:good] @ r.T + [1.0, 2.0, 3.0]
        rows += [(g, i, i, i, *map(float, s[i]), *map(float, t[i])) for i in range(n)]
    corr = spark.createDataFrame(rows, "g long, corr_id long, src_id long, tgt_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    got = {x["g"]: x for x in fitting.ransac_fit(corr, ["g"], 0.1, most=70_000).collect()}
    for g, good in ((0, 20), (1, 48)):
        m = np.array(got[g]["tf"]).reshape(4, 4)
        assert got[g]["inliers"] >= good and got[g]["converged"] and np.allclose(m[:3, :3], r, atol=1e-2) and np.allclose(m[:3, 3], [1, 2, 3], atol=0.1)
    assert got[1]["drawn"] == 128 < got[0]["drawn"] and not got[2]["converged"]


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART_ROWS", 20)
    rng = np.random.default_rng(5)
    xyz = rng.uniform(-20, 20, (600, 3))
    xyz[:40] = xyz[0]  # one pixel with many points
    pts = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)], "g long, pid long, x double, y double, z double")
    rule = rangeimage.RangeImageRule(rows=17, cols=90, min_angle=-45.0, max_angle=45.0)
    pixels = rangeimage.project(pts, ["g"], ["pid"], rule)
    assert pixels.rdd.getNumPartitions() == 30
    got = pixels.collect()
    first = {}
    for r in sorted(rangeimage.project(pts.withColumn("one", F.col("pid")), ["g", "one"], ["pid"], rule).collect(), key=lambda r: r["pid"]):
        first.setdefault((r["g"], r["row"], r["col"]), r["pid"])
    assert {(r["g"], r["row"], r["col"]): r["pid"] for r in got} == first and len(got) == len(first) < 600
    runs = rangeimage.runs(rangeimage.with_runs(pixels, ["g"], rule), ["g"])
    assert rangeimage.overlapping_runs(runs, ["g"], rule, 30).rdd.getNumPartitions() == 30
    flat = pts.select("g", F.col("x").alias("u"), F.col("y").alias("v"))
    assert boxes.convex_hull(flat, ["g"]).rdd.getNumPartitions() == 30
    plan = boxes.best_angles(flat.limit(10), ["g"])._jdf.queryExecution().toString()
    assert f"{-(-10 * boxes.ANGLES // 20)})" in plan
