"""Pose and calibration text files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import quaternion_rotation, rigid_array, rigid_inverse, rigid_mul
from .text import numbered_lines, numbers


def _rigid12(cells: Column) -> Column:
    """Row-major 3x4 numbers to a 4x4 array."""
    return F.concat(F.slice(cells, 1, 12), F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))


def _seq(path: Column, folder_depth: int = 1) -> Column:
    """Sequence number: the last folder of the path made of digits."""
    return F.regexp_extract(path, r"/(\d+)/[^/]*$" if folder_depth == 1 else r"_(\d+)_sync/[^/]*$", 1).cast("int")


def kitti_calibration(spark: SparkSession, path: str) -> DataFrame:
    """``Tr:`` row of every ``calib.txt``: seq, tf."""
    rows = numbered_lines(spark, path).filter(F.col("value").startswith("Tr:"))
    return rows.select(_seq(F.col("path")).alias("seq"), _rigid12(numbers(F.substring("value", 4, 1 << 20))).alias("tf"))


def kitti_poses(spark: SparkSession, path: str, calibration: DataFrame) -> DataFrame:
    """Twelve numbers per line, frame = line number, right-multiplied by the calibration."""
    rows = numbered_lines(spark, path).select(
        _seq(F.col("path")).alias("seq"), F.col("line").cast("int").alias("frame"), _rigid12(numbers(F.col("value"))).alias("cam")
    )
    tr = calibration.select("seq", F.col("tf").alias("_tr"))
    return rows.join(tr, "seq").select("seq", "frame", rigid_mul(F.col("cam"), F.col("_tr")).alias("tf"))


def kitti360_calibration(spark: SparkSession, cam_to_pose: str, cam_to_velo: str) -> DataFrame:
    """Sensor to body: first line without its nine-character prefix, times the inverse of the second file."""
    pose = numbered_lines(spark, cam_to_pose).filter(F.col("line") == 0)
    velo = numbered_lines(spark, cam_to_velo).filter(F.col("line") == 0)
    a = pose.select("line", _rigid12(numbers(F.substring("value", 10, 1 << 20))).alias("a"))
    b = velo.select("line", _rigid12(numbers(F.col("value"))).alias("b"))
    return a.join(b, "line").select(rigid_mul(F.col("a"), rigid_inverse(F.col("b"))).alias("tf"))


def kitti360_poses(spark: SparkSession, path: str) -> DataFrame:
    """Frame number, then twelve numbers; frames may be missing."""
    n = numbers(F.col("value"))
    return numbered_lines(spark, path).select(
        _seq(F.col("path"), 2).alias("seq"), n[0].cast("int").alias("frame"), _rigid12(F.slice(n, 2, 12)).alias("tf")
    )


def _quaternion_pose(n: Column, at: int) -> Column:
    t = (n[at], n[at + 1], n[at + 2])
    return rigid_array(quaternion_rotation(n[at + 3], n[at + 4], n[at + 5], n[at + 6]), t)


def session_of(path: Column, folder: str) -> Column:
    """The session part of a path: from the folder that ends in Data to the one before ``folder``."""
    return F.regexp_extract(path, rf"/([^/]*Data/[^/]+/[^/]+/(?:[^/]+/)?){folder}/[^/]*$", 1)


def apollo_poses(spark: SparkSession, path: str | list[str], sessions: DataFrame) -> DataFrame:
    """``num ts tx ty tz qx qy qz qw`` per line; the session folder gives the sequence."""
    n = numbers(F.col("value"))
    rows = numbered_lines(spark, path).select(
        "path", n[0].cast("int").alias("frame"), n[1].alias("ts"), _quaternion_pose(n, 2).alias("tf")
    )
    rows = rows.withColumn("session", session_of(F.col("path"), "poses"))
    # the session list is a fixed table of 27 rows
    return rows.join(F.broadcast(sessions), "session").select("seq", "frame", "ts", "tf")


def hit_poses(spark: SparkSession, path: str) -> DataFrame:
    """``x y z qx qy qz qw`` per line, frame = line number."""
    return numbered_lines(spark, path).select(
        _seq(F.col("path")).alias("seq"), F.col("line").cast("int").alias("frame"),
        _quaternion_pose(numbers(F.col("value")), 0).alias("tf"),
    )


def neighbour_frames(poses: DataFrame) -> DataFrame:
    """Partner frame of each pose: the one before, else the one after, else none.

    Exact keys, so a gap in the frame numbers never matches.
    """
    extra = ["tf"] if "tf" in poses.columns else []
    before = poses.select("seq", (F.col("frame") + 1).alias("frame"), F.col("frame").alias("_b"), *[F.col(c).alias("_b" + c) for c in extra])
    after = poses.select("seq", (F.col("frame") - 1).alias("frame"), F.col("frame").alias("_a"), *[F.col(c).alias("_a" + c) for c in extra])
    out = poses.join(before, ["seq", "frame"], "left").join(after, ["seq", "frame"], "left")
    return out.withColumn("partner", F.coalesce("_b", "_a"))


def ego_motion(poses: DataFrame) -> DataFrame:
    """Motion over one frame from the neighbouring pose; identity without neighbours."""
    near = neighbour_frames(poses)
    identity = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    motion = (
        F.when(F.col("_b").isNotNull(), rigid_mul(rigid_inverse(F.col("tf")), F.col("_btf")))
        .when(F.col("_a").isNotNull(), rigid_mul(rigid_inverse(F.col("_atf")), F.col("tf")))
        .otherwise(identity)
    )
    return near.select("seq", "frame", motion.alias("motion"))
