"""Point cloud files as DataFrames of points.

Readers by path pattern, one task per file, for stores that only Spark's own readers reach;
``cloud_source`` reads whole dataset folders by ranges and with pushed filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import axis_angle, rigid
from ..functions.scalar import file_stem
from .pcd import parse_pcd

POINT_SCHEMA = "path string, point_id long, x float, y float, z float"
_ARROW = pa.schema([("path", pa.string()), ("point_id", pa.int64()), ("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32())])


def _batch(path: str, xyz: np.ndarray) -> pa.RecordBatch:
    xyz = np.ascontiguousarray(xyz.T, dtype=np.float32)
    cells = [pa.array([path] * xyz.shape[1]), pa.array(np.arange(xyz.shape[1])), *(pa.array(c) for c in xyz)]
    return pa.record_batch(cells, schema=_ARROW)


def _decode_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            yield _batch(path, np.frombuffer(content.as_buffer(), dtype="<f4").reshape(-1, 4)[:, :3])


def _decode_pcd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            yield _batch(path, parse_pcd(content))


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian float32 x, y, z, intensity records."""
    return _files(spark, path).mapInArrow(_decode_bin, POINT_SCHEMA)


def read_pcd(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _files(spark, path).mapInArrow(_decode_pcd, POINT_SCHEMA)


def with_frame(points: DataFrame, seq_pattern: str) -> DataFrame:
    """Sequence from the path by ``seq_pattern``, frame from the file name."""
    return points.withColumns({
        "seq": F.regexp_extract("path", seq_pattern, 1).cast("int"), "frame": file_stem(F.col("path")).cast("int"),
    })


def count_frames(spark: SparkSession, path: str) -> DataFrame:
    """Number of sweep files per sequence, from the listing alone."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.groupBy(F.regexp_extract("path", r"/(\d+)/[^/]+/[^/]+$", 1).cast("int").alias("seq")).agg(F.count(F.lit(1)).alias("frames"))


def deskew(points: DataFrame, motion: DataFrame, tolerance: float = 0.1, keep_type: bool = False) -> DataFrame:
    """Undo the sensor's motion during a sweep.

    A point turns and moves by its share of the motion, its bearing over a full turn.
    Sweeps whose motion is within ``tolerance`` of none stay as they are.  ``motion`` has
    seq, frame and a 4x4 ``motion``, one row per sweep.  Coordinates come back as float32
    unless ``keep_type``.
    """
    rot, trans = rigid("motion")
    rho = axis_angle(rot)
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    gap = F.sqrt(sum(((F.col("motion")[i] - v) * (F.col("motion")[i] - v) for i, v in enumerate(eye)), F.lit(0.0)))
    per = motion.select("seq", "frame", (gap > tolerance).alias("_move"),
                        *[c.alias("_r" + a) for c, a in zip(rho, "xyz")], *[c.alias("_t" + a) for c, a in zip(trans, "xyz")])
    df = points.join(per, ["seq", "frame"], "left")
    share = 0.5 * F.atan2(F.col("y"), F.col("x")) / F.lit(np.pi)
    df = df.withColumns({**{"_q" + a: F.col("_r" + a) * share for a in "xyz"}, **{"_s" + a: F.col("_t" + a) * share for a in "xyz"}})
    q = [F.col("_q" + a) for a in "xyz"]
    df = df.withColumn("_angle", F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2]))
    angle = F.col("_angle")
    k = [F.when(angle > 1e-10, c / angle).otherwise(0.0) for c in q]
    v = [F.col(c).cast("double") for c in "xyz"]
    c, s = F.cos(angle), F.sin(angle)
    kv = k[0] * v[0] + k[1] * v[1] + k[2] * v[2]
    turned = [
        v[i] * c + (k[(i + 1) % 3] * v[(i + 2) % 3] - k[(i + 2) % 3] * v[(i + 1) % 3]) * s + k[i] * kv * (1.0 - c) + F.col("_s" + a)
        for i, a in enumerate("xyz")
    ]
    df = df.withColumns({"_o" + a: F.when(F.coalesce(F.col("_move"), F.lit(False)), t).otherwise(F.col(a)) for a, t in zip("xyz", turned)})
    kind = "double" if keep_type else "float"
    return df.select(*[F.col("_o" + n).cast(kind).alias(n) if n in ("x", "y", "z") else F.col(n) for n in points.columns])
