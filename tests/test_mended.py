"""Answers that were wrong once."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.config import Config, load_config
from pointloom.functions.scalar import eigenvalue_feature
from pointloom.operators import descriptors, voxels
from pointloom.plans.registration import rank_features
from pointloom.sources import datasets, sinks


def test_all_sessions_have_poses_and_clouds(spark, tmp_path):
    for s in datasets.SESSIONS:
        for sub, name, text in (("poses", "gt_poses.txt", "7 0.5 1 2 3 0 0 0 1\n"), ("pcds", "7.pcd", "VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n1 2 3\n")):
            folder = tmp_path / s / sub
            folder.mkdir(parents=True)
            (folder / name).write_text(text)
    layout = datasets.dataset("apollo")
    assert sorted(r["seq"] for r in layout.poses(spark, str(tmp_path)).collect()) == list(range(27))
    assert sorted(r["seq"] for r in layout.clouds(spark, str(tmp_path)).collect()) == list(range(27))


def test_flat_features_have_finite_values(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (-1e-18, 1.0, 1.0), (0.0, 0.0, 3.0), (0.0, 0.0, 0.0)], "l0 double, l1 double, l2 double")
    rows = df.select(*eigenvalue_feature(F.col("l0"), F.col("l1"), F.col("l2"))).collect()
    assert all(v is not None and math.isfinite(v) for r in rows for v in r)


def test_cell_ids_do_not_clash(spark):
    cells = [(0, 0, -1), (0, -1, 999), (-1, 999, 999), (5000, -5000, 0), (0, 0, 0)]
    df = spark.createDataFrame(cells, "vx int, vy int, vz int").select(voxels.cell_id("vx", "vy", "vz").alias("id"))
    assert df.distinct().count() == len(cells)
    with pytest.raises(Exception, match="span"):
        spark.createDataFrame([(1 << 21, 0, 0)], "vx int, vy int, vz int").select(voxels.cell_id("vx", "vy", "vz")).collect()


def test_a_large_cloud_spreads_over_files(spark, tmp_path):
    pts = spark.range(20_000).select(F.lit(1).alias("cloud"), F.col("id").alias("pid"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small here, so they would be joined again
    try:
        sinks.write_pcd(pts, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out" / "cloud=1").glob("part-*"))
    lines = [f.read_text().splitlines() for f in files]
    assert len(files) > 1 and max(map(len, lines)) < 15_000
    whole = sum(lines, [])
    assert whole[0].startswith("# .PCD") and whole[-1].startswith("19999.0") and len(whole) == 20_011


def test_isolated_points_have_a_zero_descriptor(spark):
    rows = [(1, i, float(x), 0.0, 0.1 * i, 0.0, 0.0, 1.0) for i, x in enumerate((0.0, 0.5, 1.0, 500.0))]
    pts = spark.createDataFrame(rows, "cloud int, id long, x double, y double, z double, nx double, ny double, nz double")
    got = {r["id"]: r["desc"] for r in descriptors.fpfh(pts, ["cloud"], 2.0).collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] == [0.0] * 33 and sum(got[0]) > 0


def test_features_are_only_cut_on_request(spark):
    rows = [(1, c, i, 0.1, 0.2, 0.3, 5.0 + i, 0.0, 0.0) for c in ("Line", "Plane") for i in range(70)]
    df = spark.createDataFrame(rows, "cloud int, class string, id long, l0 double, l1 double, l2 double, mx double, my double, mz double")
    assert rank_features(df, Config(min_range=0.0, max_range=1e9)).count() == 140
    assert rank_features(df, Config(min_range=0.0, max_range=1e9, num_lines=5)).count() == 75


def test_keys_without_effect_are_errors(tmp_path):
    (tmp_path / "a.yaml").write_text("association:\n  max_corrs: 10\n")
    with pytest.raises(ValueError, match="max_corrs"):
        load_config(str(tmp_path / "a.yaml"))
    (tmp_path / "b.yaml").write_text("association:\n  num_lines: 7\n")
    assert load_config(str(tmp_path / "b.yaml")).num_lines == 7


def test_short_pair_lines_are_errors(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("header\n1 2 3\n")
    with pytest.raises(Exception, match="pair line"):
        datasets.read_pairs(spark, str(tmp_path / "pairs.txt")).collect()
