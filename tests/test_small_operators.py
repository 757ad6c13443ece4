"""Operators without a query of their own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions.linalg import rigid_array
from pointloom.functions.scalar import descriptor_distance
from pointloom.operators import boxes, fitting, ground, matching, rangeimage, voxels
from pointloom.plans.features import FeatureRule, classify
from pointloom.plans.synthetic import SIZES, random_features


def test_synthetic_features_have_their_shape(spark):
    pts = random_features(spark, 12)
    assert pts.count() == 12 * sum(SIZES.values())
    shaped = voxels.with_shape(voxels.gaussians(pts, ["id", "class"])).withColumnRenamed("class", "made")
    got = shaped.withColumn("class", classify(FeatureRule())).filter("made <> 'Line' and class <> made").count()
    assert got == 0
    lines = shaped.filter("made = 'Line'").select((F.col("l1") / F.col("l2")).alias("r")).collect()
    assert all(abs(x["r"]) < 1e-6 for x in lines)  # closed-form roots are good to half the digits
    assert sorted(map(str, pts.collect())) == sorted(map(str, random_features(spark, 12).repartition(5).collect()))


def test_plain_centroids(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(30, 3))
    t = s @ np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]).T + [1.0, 2.0, 3.0]
    rows = spark.createDataFrame(pd.DataFrame({"g": 1, "w": rng.uniform(0.1, 1, 30), **{f"s{a}": s[:, i] for i, a in enumerate("xyz")}, **{f"t{a}": t[:, i] for i, a in enumerate("xyz")}}))
    tf = np.array(fitting.fit_pose_plain_centroids(rows, ["g"], F.col("w")).first()["tf"]).reshape(4, 4)
    assert np.allclose(tf, [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]], atol=1e-9)


def test_tuple_test_keeps_true_matches(spark):
    rng = np.random.default_rng(2)
    s, t = rng.uniform(-10, 10, (60, 3)), rng.uniform(-10, 10, (60, 3))
    t[:40] = s[:40] + [5.0, 0.0, 1.0]
    rows = [(1, 2, i, *map(float, s[i]), *map(float, t[i])) for i in range(60)]
    corr = spark.createDataFrame(rows, "src int, tgt int, corr_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    kept = {r["corr_id"] for r in matching.tuple_test(corr, ["src", "tgt"]).collect()}
    assert set(range(40)) <= kept and len(kept) < 60


def test_overlap_of_sizes(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0], [2.0, 2.0, 2.0]), ([1.0, 2.0, 3.0], [2.0, 2.0, 1.0]), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(descriptor_distance(F.col("a"), F.col("b"), "iou3d")).collect()]
    assert got == pytest.approx([0.0, 1.0 - 2.0 / (6.0 + 4.0 - 2.0), 1.0])
    with pytest.raises(ValueError):
        descriptor_distance(F.col("a"), F.col("b"), "other")


def test_ring_closure(spark):
    runs = [(1, 0, r, float(x), float(y)) for r, x, y in ((1, 10.0, 0.0), (2, 0.0, 10.0), (3, -10.0, 0.0), (4, 10.0, -0.1))]
    df = spark.createDataFrame(runs, "cloud int, row int, run int, x double, y double")
    df = df.withColumns({"head": F.struct("x", "y"), "tail": F.struct("x", "y")}).drop("x", "y")
    rule = rangeimage.RangeImageRule(skip=1)
    assert rangeimage.row_links(df, ["cloud"], rule).count() == 0
    closed = rangeimage.row_links(df, ["cloud"], rule, ring=True).collect()
    assert [(r["row"], r["a"], r["b"]) for r in closed] == [(0, 1, 4)]


def test_cells_borrow_a_plane(spark):
    rule = ground.GroundRule()
    rng = np.random.default_rng(3)
    xyz = np.c_[rng.uniform(4, 44, (4000, 2)), np.full(4000, -1.7)]
    df = spark.createDataFrame(pd.DataFrame({"cloud": 1, "pid": np.arange(4000), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    celled = ground.with_cell(ground.ring_filter(df, rule.min_range, rule.max_range), rule)
    cells = ground.cell_planes(celled, ["cloud"], rule)
    assert cells.filter("not ground").count() == 0
    bare = (F.col("row") == 13) & (F.col("col") == 13) & (F.col("tri") == 0)  # as if it had none
    cells = cells.withColumns({"ground": F.col("ground") & ~bare, "nx": F.when(~bare, F.col("nx")), "d": F.when(~bare, F.col("d"))})
    plain = ground.label_points(celled, cells, ["cloud"], rule)
    lent = ground.label_by_best_neighbour(celled, cells, ["cloud"], rule)
    assert plain.filter(bare & (F.col("label") == "ground")).count() == 0 < plain.filter(bare).count()
    assert lent.filter(F.col("label") != "ground").count() == 0 and lent.count() == plain.count()


def test_vertex_features_and_conversions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 1.0, 0.0, 9.0)], "mx double, my double, mz double, xx double, xy double, xz double, yy double, yz double, zz double")
    row = boxes.vertex_features(df).first()
    assert (row["l0"], row["l1"], row["l2"]) == pytest.approx((1.0, 4.0, 9.0)) and row["size"] == pytest.approx([15.63, 31.26, 46.89])
    assert abs(row["ny"]) == pytest.approx(1.0) and abs(row["dz"]) == pytest.approx(1.0)
    pts = spark.createDataFrame([(7, 0.5, 1.5, -2.5)], "pid int, x double, y double, z double")
    back = voxels.with_intensity(voxels.from_array(voxels.as_array(pts)), F.col("pid")).first()
    assert (back["x"], back["y"], back["z"], back["intensity"]) == (0.5, 1.5, -2.5, 7.0)
    moved = spark.range(1).select(rigid_array(tuple(F.lit(float(k % 4 == 0)) for k in range(9)), tuple(F.lit(v) for v in (1.0, 2.0, 3.0))).alias("tf")).first()["tf"]
    assert moved[3::4] == [1.0, 2.0, 3.0, 1.0]
