"""Pair lists, correspondences and the four dataset layouts."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import rigid_mul
from . import clouds, poses
from .cloud_source import read_clouds
from .text import numbered_lines, numbers

# Session folders by sequence number.
SESSIONS = (
    "MapData/HighWay237/2018-10-05/",
    "MapData/SunnyvaleBigloop/Caspian_and_Geneva/2017-12-13/",
    "MapData/SunnyvaleBigloop/Borrgas/2017-12-13/",
    "MapData/SunnyvaleBigloop/Java/2017-12-13/",
    "MapData/SunnyvaleBigloop/Mathilda_Moffet/2017-12-28/",
    "MapData/SunnyvaleBigloop/Crossman/2017-12-13/",
    "MapData/SunnyvaleBigloop/Mathilda_Carribean/2017-12-14/",
    "MapData/SunnyvaleBigloop/Bordeaux/2017-12-13/",
    "MapData/MathildaAVE/2018-09-25/",
    "MapData/SanJoseDowntown/2018-10-02/",
    "MapData/BaylandsToSeafood/2018-09-26/",
    "MapData/ColumbiaPark/2018-09-21/2/",
    "MapData/ColumbiaPark/2018-09-21/4/",
    "MapData/ColumbiaPark/2018-09-21/1/",
    "MapData/ColumbiaPark/2018-09-21/3/",
    "TrainData/HighWay237/2018-10-12/",
    "TrainData/MathildaAVE/2018-10-04/",
    "TrainData/SanJoseDowntown/2018-10-11/",
    "TrainData/BaylandsToSeafood/2018-10-05/",
    "TrainData/ColumbiaPark/2018-10-03/",
    "TestData/HighWay237/2018-10-12/",
    "TestData/SunnyvaleBigloop/2018-10-03/",
    "TestData/MathildaAVE/2018-10-12/",
    "TestData/SanJoseDowntown/2018-10-11/2/",
    "TestData/SanJoseDowntown/2018-10-11/1/",
    "TestData/BaylandsToSeafood/2018-10-12/",
    "TestData/ColumbiaPark/2018-10-11/",
)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair list: a header line, then 20 or 21 numbers; a missing overlap is 1.

    Numbers go through float32, as the stored ground truth has that precision.
    """
    n = F.transform(numbers(F.col("value")), lambda v: v.cast("float").cast("double"))
    rows = numbered_lines(spark, path).filter(F.col("line") > 0).select(n.alias("n"))
    short = F.raise_error(F.format_string("pair line with %d numbers, not 20 or 21", F.size("n")))
    return rows.filter(F.size("n") > 0).withColumn("n", F.when(F.size("n") >= 20, F.col("n")).otherwise(short)).select(
        *[F.col("n")[i].cast("int").alias(c) for i, c in enumerate(("seq", "src_idx", "seq_db", "tgt_idx"))],
        F.slice("n", 5, 16).alias("pose"), F.coalesce(F.get(F.col("n"), F.lit(20)), F.lit(1.0)).alias("overlap"),
    )


def read_correspondences(spark: SparkSession, path: str) -> DataFrame:
    """Six numbers per line; file name ``<src>_<tgt>``."""
    n = numbers(F.col("value"))
    return numbered_lines(spark, path).select(
        F.regexp_extract("path", r"(\d+)_(\d+)\.[^/]*$", 1).cast("int").alias("src"),
        F.regexp_extract("path", r"(\d+)_(\d+)\.[^/]*$", 2).cast("int").alias("tgt"),
        F.col("line").cast("long").alias("corr_id"),
        *[n[i].alias(c) for i, c in enumerate(("sx", "sy", "sz", "tx", "ty", "tz"))],
    )


@dataclass(frozen=True)
class Dataset:
    """Readers of one dataset layout."""

    clouds: Callable[[SparkSession, str], DataFrame]
    poses: Callable[[SparkSession, str], DataFrame]
    cloud_file: Callable[[Column, Column], Column]


def _kitti_poses(spark: SparkSession, root: str) -> DataFrame:
    return poses.kitti_poses(spark, f"{root}/*/poses.txt", poses.kitti_calibration(spark, f"{root}/*/calib.txt"))


def _kitti360_clouds(spark: SparkSession, root: str) -> DataFrame:
    raw = read_clouds(spark, root, "kitti360")
    return clouds.deskew(raw, poses.ego_motion(_kitti360_poses(spark, root)))


def _kitti360_poses(spark: SparkSession, root: str) -> DataFrame:
    body = poses.kitti360_poses(spark, f"{root}/data_poses/*/poses.txt")
    calib = poses.kitti360_calibration(spark, f"{root}/calibration/calib_cam_to_pose.txt", f"{root}/calibration/calib_cam_to_velo.txt")
    # one calibration row for the whole dataset
    one = F.broadcast(calib.select(F.lit(1).alias("_k"), F.col("tf").alias("_c")))
    return body.withColumn("_k", F.lit(1)).join(one, "_k").select("seq", "frame", rigid_mul(F.col("tf"), F.col("_c")).alias("tf"))


def sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SESSIONS)), "seq int, session string")


def _apollo_folders(spark: SparkSession, root: str, tail: str) -> list[str]:
    """Sessions lie two or three folders deep."""
    return [f"{root}/*Data/*/*/{tail}", f"{root}/*Data/*/*/*/{tail}"]


def _apollo_clouds(spark: SparkSession, root: str) -> DataFrame:
    named = F.broadcast(sessions(spark))  # 27 fixed rows
    return read_clouds(spark, root, "apollo").join(named, "seq")


# Path formats of the four layouts.
DATASETS: dict[str, Dataset] = {
    "kitti": Dataset(
        lambda s, r: read_clouds(s, r, "kitti"), _kitti_poses,
        lambda seq, frame: F.format_string("%02d/velodyne/%06d.bin", seq, frame),
    ),
    "kitti360": Dataset(
        _kitti360_clouds, _kitti360_poses,
        lambda seq, frame: F.format_string("data_3d_raw/2013_05_28_drive_%04d_sync/velodyne_points/data/%010d.bin", seq, frame),
    ),
    "apollo": Dataset(
        _apollo_clouds, lambda s, r: poses.apollo_poses(s, _apollo_folders(s, r, "poses/gt_poses.txt"), sessions(s)),
        lambda seq, frame: F.concat(F.array(*[F.lit(v) for v in SESSIONS])[seq], F.format_string("pcds/%d.pcd", frame)),
    ),
    "hit_ms": Dataset(
        lambda s, r: read_clouds(s, r, "hit_ms"),
        lambda s, r: poses.hit_poses(s, f"{r}/*/poses.txt"), lambda seq, frame: F.format_string("%02d/pcd/%d.pcd", seq, frame),
    ),
}


def dataset(name: str) -> Dataset:
    """Layout by name, in any case; unknown names are an error."""
    try:
        return DATASETS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}") from None


def with_poses(frames: DataFrame, pose_table: DataFrame) -> DataFrame:
    """Pose of every (seq, frame), null where none was recorded."""
    return frames.join(pose_table.select("seq", "frame", "tf"), ["seq", "frame"], "left")
