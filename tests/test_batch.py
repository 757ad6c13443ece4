"""A whole benchmark run from written files, and the KITTI-360 layout."""

import numpy as np
from test_registration import clouds

from pointloom.config import Config
from pointloom.plans import batch
from pointloom.sources import datasets


def line(values):
    return " ".join(str(float(v)) for v in values)


def test_run_from_files(spark, tmp_path):
    pts, _, r, t = clouds(spark)
    sides = pts.toPandas()
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = r, t
    text = ["header"]
    for seq in (0, 5):
        folder = tmp_path / "data" / f"{seq:02d}" / "velodyne"
        folder.mkdir(parents=True)
        for frame, cloud in ((3, 1), (8, 2)):
            xyz = sides[sides["cloud"] == cloud][["x", "y", "z"]].to_numpy()
            np.c_[xyz, np.zeros(len(xyz))].astype("<f4").tofile(folder / f"{frame:06d}.bin")
        (folder / "000004.bin").write_bytes(b"no pair names this sweep")
        text.append(line([seq, 3, seq, 8, *pose.ravel(), 0.7]))
    (tmp_path / "pairs.txt").write_text("\n".join(text) + "\n")
    cfg = Config(dataset="kitti", dataset_root=str(tmp_path / "data"), min_range=1.0, max_range=40.0, tf_solver="gmm_tls", cluster_method="euc",
                 noise_bounds=(0.2, 0.4), eigen_ratio=10.0, vertex_type="point")
    summary = batch.run_registration(spark, cfg, str(tmp_path / "pairs.txt"), str(tmp_path / "out")).collect()
    got = {x["seq"]: x for x in summary}
    assert set(got) == {None, 0, 5} and got[None]["pairs"] == 2 and got[None]["success_rate"] == got[5]["success_rate"] == 100.0
    assert got[0]["success_rate_upper"] == 100.0 and got[0]["plane_inliers_avg"] > 0
    results = spark.read.parquet(str(tmp_path / "out" / "results")).collect()
    assert len(results) == 2 and all(x["success"] and x["rot_err"] < 5 and x["overlap"] > 0.69 for x in results)
    out = tmp_path / "out"
    values = [v for p in sorted((out / "statistics" / "sequences" / "seq=5" / "metric=rot_err").glob("part-*")) for v in p.read_text().split()]
    assert values == [str(x["rot_err"]) for x in results if x["seq"] == 5]
    log = "".join(p.read_text() for p in sorted((out / "log" / "pairs.log").glob("part-*"))).splitlines()
    assert len(log) == 2 and all("success=true" in x for x in log)
    met = batch.run_matching(spark, cfg, str(tmp_path / "pairs.txt"), str(out)).first()
    assert met["pairs"] == 2 and met["success_3"] == 100.0 and met["precision"] > 5


def test_kitti360_layout(spark, tmp_path):
    raw = tmp_path / "data_3d_raw" / "2013_05_28_drive_0003_sync" / "velodyne_points" / "data"
    raw.mkdir(parents=True)
    rows = np.random.default_rng(0).normal(size=(6, 4)).astype("<f4")
    for frame in (1, 2):
        rows.tofile(raw / f"{frame:010d}.bin")
    at = tmp_path / "data_poses" / "2013_05_28_drive_0003_sync"
    at.mkdir(parents=True)
    step = [1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0]
    (at / "poses.txt").write_text(f"1 {line(step)}\n2 {line(step)}\n")
    calib = tmp_path / "calibration"
    calib.mkdir()
    (calib / "calib_cam_to_pose.txt").write_text("image_00: " + line([1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3]) + "\n")
    (calib / "calib_cam_to_velo.txt").write_text(line([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1]) + "\n")
    data = datasets.dataset("KITTI360")
    poses = {(r["seq"], r["frame"]): r["tf"] for r in data.poses(spark, str(tmp_path)).collect()}
    assert poses[3, 2] == [1.0, 0.0, 0.0, 11.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    pts = data.clouds(spark, str(tmp_path)).filter("frame = 2").orderBy("point_id").toPandas()
    assert set(pts["seq"]) == {3} and np.array_equal(pts[["x", "y", "z"]].to_numpy(), rows[:, :3])  # the sensor stood still
