import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.config import Config, load_config
from pointloom.functions.scalar import feature_code, feature_name, file_stem, index_to_pair, pair_to_index
from pointloom.operators.evaluate import summarize, with_success
from pointloom.sources import clouds, datasets, poses, sinks
from pointloom.streaming import running_eval

EYE = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def line(values):
    return " ".join(str(float(v)) for v in values)


def test_pair_list(spark, tmp_path):
    pose = list(range(16))
    text = "header\n" + line([0, 3, 0, 9, *pose, 0.5]) + "\n" + line([1, 4, 2, 8, *pose]) + "\n"
    (tmp_path / "pairs.txt").write_text(text)
    rows = sorted(datasets.read_pairs(spark, str(tmp_path / "pairs.txt")).collect())
    assert [(r["seq"], r["src_idx"], r["seq_db"], r["tgt_idx"], r["overlap"]) for r in rows] == [(0, 3, 0, 9, 0.5), (1, 4, 2, 8, 1.0)]
    assert rows[0]["pose"] == [float(v) for v in pose]


def test_kitti_layout(spark, tmp_path):
    rng = np.random.default_rng(0)
    for seq in (0, 3):
        folder = tmp_path / f"{seq:02d}" / "velodyne"
        folder.mkdir(parents=True)
        for frame in range(2):
            rng.normal(size=(5 + frame, 4)).astype("<f4").tofile(folder / f"{frame:06d}.bin")
        (tmp_path / f"{seq:02d}" / "calib.txt").write_text("P0: " + line(range(12)) + "\nTr: " + line([0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3]) + "\n")
        (tmp_path / f"{seq:02d}" / "poses.txt").write_text(line([1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0]) + "\n" + line([1, 0, 0, 20, 0, 1, 0, 0, 0, 0, 1, 0]) + "\n")
    data = datasets.dataset("KITTI")
    pts = data.clouds(spark, str(tmp_path))
    assert sorted((r["seq"], r["frame"], r["count"]) for r in pts.groupBy("seq", "frame").count().collect()) == [(0, 0, 5), (0, 1, 6), (3, 0, 5), (3, 1, 6)]
    p = {(r["seq"], r["frame"]): r["tf"] for r in data.poses(spark, str(tmp_path)).collect()}
    assert p[(3, 1)] == [0.0, -1.0, 0.0, 21.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    assert sorted((r["seq"], r["frames"]) for r in clouds.count_frames(spark, str(tmp_path / "*" / "velodyne" / "*.bin")).collect()) == [(0, 2), (3, 2)]
    with pytest.raises(ValueError):
        datasets.dataset("kitti-10m")


def test_pcd_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(7, 1.5, 2.0, -3.0), (7, 0.25, 4.0, 5.0)], "cloud int, x float, y float, z float")
    sinks.write_pcd(pts, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "cloud=7").glob("part-*"))
    (tmp_path / "a.pcd").write_text("".join(p.read_text() for p in parts))
    got = clouds.read_pcd(spark, str(tmp_path / "a.pcd")).collect()
    assert sorted((r["x"], r["y"], r["z"]) for r in got) == [(0.25, 4.0, 5.0), (1.5, 2.0, -3.0)]
    xyz = np.arange(12, dtype="<f4").reshape(3, 4)
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA binary\n"
    (tmp_path / "b.pcd").write_bytes(head.encode() + xyz.tobytes())
    got = clouds.read_pcd(spark, str(tmp_path / "b.pcd")).orderBy("point_id").collect()
    assert [[r["x"], r["y"], r["z"]] for r in got] == xyz[:, :3].tolist()


def test_quaternion_poses_and_ego_motion(spark, tmp_path):
    (tmp_path / "04").mkdir()
    s = np.sqrt(0.5)
    (tmp_path / "04" / "poses.txt").write_text("\n".join(line([i, 0, 0, 0, 0, s, s]) for i in range(3)))
    p = poses.hit_poses(spark, str(tmp_path / "*" / "poses.txt"))
    tf = np.array(p.filter("frame = 1").first()["tf"]).reshape(4, 4)
    assert np.allclose(tf[:3, :3], [[0, -1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-9) and tf[0, 3] == 1
    sparse = p.filter("frame <> 1").unionByName(spark.createDataFrame([(4, 3, EYE)], p.schema))
    m = {r["frame"]: np.array(r["motion"]).reshape(4, 4) for r in poses.ego_motion(sparse).collect()}
    assert np.allclose(m[0], np.eye(4))  # frame 1 is missing: a gap must not match
    prev = np.array(p.filter("frame = 2").first()["tf"]).reshape(4, 4)
    assert np.allclose(m[3], prev) and np.allclose(m[2], np.linalg.inv(np.eye(4)) @ prev)


def test_deskew_matches_rotation(spark):
    a = 0.4
    motion = [np.cos(a), -np.sin(a), 0.0, 1.0, np.sin(a), np.cos(a), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    pts = spark.createDataFrame([(0, 1, 0.0, 5.0, 1.0), (0, 2, 0.0, 5.0, 1.0)], "seq int, frame int, x float, y float, z float")
    m = spark.createDataFrame([(0, 1, [float(v) for v in motion]), (0, 2, EYE)], "seq int, frame int, motion array<double>")
    got = {r["frame"]: (r["x"], r["y"], r["z"]) for r in clouds.deskew(pts, m).collect()}
    part = 0.25 * a
    want = (-np.sin(part) * 5 + 0.25, np.cos(part) * 5, 1.0)
    assert np.allclose(got[1], want, atol=1e-5) and got[2] == (0.0, 5.0, 1.0)


def test_statistics_and_stream(spark, tmp_path):
    rows = [(s, i, float(i), [*EYE[:3], 0.1 * i, *EYE[4:]], EYE) for s in (0, 1) for i in range(40)]
    res = with_success(spark.createDataFrame(rows, "seq int, i int, total_time double, tf array<double>, truth array<double>"))
    sinks.write_statistics(res, str(tmp_path / "stat"), per_sequence=True)
    lines = [v for p in (tmp_path / "stat" / "seq=1" / "metric=trans_err").glob("part-*") for v in p.read_text().split()]
    assert len(lines) == 20
    res.repartition(3).write.parquet(str(tmp_path / "res"))
    stream = spark.readStream.schema(res.schema).parquet(str(tmp_path / "res"))
    q = running_eval.start(stream, "run_eval", str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r["seq"], r["pairs"], round(r["success_rate"], 6)) for r in spark.table("run_eval").collect()}
    assert got == {(r["seq"], r["pairs"], round(r["success_rate"], 6)) for r in summarize(res).collect()} == {(None, 80, 50.0), (0, 40, 50.0), (1, 40, 50.0)}


def test_config(tmp_path):
    (tmp_path / "run.yaml").write_text("dataset: {name: kitti, max_range: 80}\nfront_end: shapes\nback_end: pyramid\ntf_solver: gmm_tls\nvertex: {type: ellipse, noise_bound_vec: [0.1, 0.3]}\n")
    cfg = load_config(str(tmp_path / "run.yaml"), aliases={"shapes": "ellipsoid"})
    assert (cfg.front_end, cfg.back_end, cfg.max_range, cfg.noise_bounds) == ("ellipsoid", "pyramid", 80.0, (0.1, 0.3))
    for bad in ({"back_end": "x"}, {"noise_bounds": (0.3, 0.1)}, {"front_end": "fpfh", "tf_solver": "gmm_tls"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_scalar_codes(spark):
    n = 9
    pairs = [(i, j, k) for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1, n))]
    df = spark.createDataFrame(pairs, "i long, j long, k long")
    i, j = index_to_pair(F.col("k"), F.lit(n))
    bad = df.filter((pair_to_index(F.col("i"), F.col("j"), F.lit(n)) != F.col("k")) | (i != F.col("i")) | (j != F.col("j")))
    assert bad.isEmpty()
    row = spark.range(1).select(file_stem(F.lit("/a/b/000012.bin")).alias("s"), feature_name(feature_code(F.lit("Plane"))).alias("n"),
                                feature_name(F.lit(-1)).alias("none")).first()
    assert tuple(row) == ("000012", "Plane", "None")
