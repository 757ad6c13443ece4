import numpy as np
import pandas as pd
import pytest

from pointloom.config import Config
from pointloom.operators import ground
from pointloom.plans import registration as reg


def street(rng):
    """Flat ground at -1.7 with walls, poles and boxes."""
    parts, kinds = [], []

    def add(p, kind):
        parts.append(p)
        kinds.extend([kind] * len(p))

    xy = rng.uniform(-30, 30, (9000, 2))
    add(np.c_[xy, -1.7 + rng.normal(0, 0.02, len(xy))], "ground")
    for x0, y0, yaw, size in ((-20, 12, 0.3, 14), (10, 18, 1.2, 10), (15, -15, 2.2, 12), (-15, -18, 0.9, 9), (25, 5, 1.6, 8)):
        u, h = rng.uniform(0, size, 900), rng.uniform(-1.2, 3, 900)
        add(np.c_[x0 + u * np.cos(yaw), y0 + u * np.sin(yaw), h] + rng.normal(0, 0.02, (900, 3)), "wall")
    for x0, y0 in ((5, 7), (-8, 4), (-6, -9), (9, -6), (18, 3), (-22, -3), (2, -22), (3, 24)):
        add(np.c_[x0 + rng.normal(0, 0.03, 150), y0 + rng.normal(0, 0.03, 150), rng.uniform(-1.2, 4, 150)], "pole")
    for x0, y0 in ((12, 9), (-12, 10), (-3, 14), (6, -14), (20, -4), (-18, -10)):
        add(np.array([x0, y0, -0.4]) + rng.uniform(-1, 1, (250, 3)) * [1.2, 0.8, 0.7], "box")
    return np.concatenate(parts), np.array(kinds)


def clouds(spark, seed=0):
    rng = np.random.default_rng(seed)
    p, kinds = street(rng)
    a = 0.5
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    t = np.array([2.0, -1.5, 0.1])
    q = p @ r.T + t + rng.normal(0, 0.01, p.shape)
    frames = [pd.DataFrame({"cloud": c, "pid": np.arange(len(p)), "x": m[:, 0], "y": m[:, 1], "z": m[:, 2]}) for c, m in ((1, p), (2, q))]
    return spark.createDataFrame(pd.concat(frames)), kinds, r, t


def test_ground_labels(spark):
    pts, kinds, *_ = clouds(spark)
    out = ground.segment_ground(pts.filter("cloud = 1"), ["cloud"], ground.GroundRule(max_range=40.0)).toPandas()
    truth = kinds[out["pid"].to_numpy()]
    is_ground = (out["label"] == "ground").to_numpy()
    assert is_ground[truth == "ground"].mean() > 0.9
    assert is_ground[(truth == "wall") | (truth == "pole")].mean() < 0.05


def test_registers_a_street(spark):
    pts, _, r, t = clouds(spark)
    pairs = spark.createDataFrame([(1, 2)], "src long, tgt long")
    cfg = Config(min_range=1.0, max_range=40.0, min_cluster_size=20, tf_solver="gmm_tls", cluster_method="euc", noise_bounds=(0.2, 0.4),
                 eigen_ratio=10.0, vertex_type="point")
    feats, _, members = reg.extract_features(pts, cfg)
    counts = {(x["cloud"], x["class"]): x["count"] for x in feats.groupBy("cloud", "class").count().collect()}
    assert counts[(1, "Plane")] >= 3 and counts[(1, "Line")] >= 5 and counts[(1, "Cluster")] >= 3
    boxed = reg.with_boxes(reg.rank_features(feats, cfg), members, cfg).filter("cloud = 1").collect()
    tall = [max(b["size"]) for b in boxed if b["class"] == "Line"]
    assert len(boxed) == sum(v for k, v in counts.items() if k[0] == 1) and all(3.0 < h < 6.5 for h in tall)
    out = reg.register(pts, pairs, cfg).first()
    m = np.array(out["tf"]).reshape(4, 4)
    angle = np.degrees(np.arccos(np.clip((np.trace(r.T @ m[:3, :3]) - 1) / 2, -1, 1)))
    assert out["valid"] and angle < 5.0 and np.linalg.norm(m[:3, 3] - t) < 2.0


def test_wrong_front_end(spark):
    with pytest.raises(ValueError):
        reg.front_end(spark.range(1), spark.range(1), Config(front_end="none"))
