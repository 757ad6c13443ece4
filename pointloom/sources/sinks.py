"""Writers for statistics, reports and PCD files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_sink import write_parts

STATISTICS = ("rot_err", "trans_err", "total_time", "feature_time", "clique_time", "graph_time", "verify_time", "tf_solver_time")


def write_statistics(results: DataFrame, folder: str, per_sequence: bool = False) -> None:
    """One value per line for every statistic, optionally split by sequence.

    Errors are written for successful pairs only.
    """
    present = [c for c in STATISTICS if c in results.columns]
    values = F.array(*[
        F.struct(F.lit(c).alias("metric"), (F.when(F.col("success"), F.col(c)) if c.endswith("_err") else F.col(c)).cast("double").alias("value"))
        for c in present
    ])
    by = ["seq"] if per_sequence else []
    rows = results.select(*by, F.explode(values).alias("_s")).select(*by, "_s.*").filter(F.col("value").isNotNull())
    name = F.concat(*([F.lit("seq="), F.col("seq").cast("string"), F.lit("/")] if per_sequence else []), F.lit("metric="), F.col("metric"))
    lines = rows.select(name.alias("file"), F.col("value").cast("string").alias("value"))
    write_parts(lines.repartitionByRange("file", "value").sortWithinPartitions("file", "value"), folder)


def write_report(summary: DataFrame, folder: str) -> None:
    """Overall and per-sequence summary rows as JSON lines."""
    write_parts(summary.select(F.lit("summary.json").alias("file"), F.to_json(F.struct(*summary.columns)).alias("value")), folder)


def write_log(results: DataFrame, folder: str) -> None:
    """The log lines of all pairs."""
    write_parts(pair_log(results).select(F.lit("pairs.log").alias("file"), "value").repartitionByRange("value").sortWithinPartitions("value"), folder)


def pcd_parts(points: DataFrame, coloured: bool = False) -> DataFrame:
    """Header and point lines of ASCII PCD files, keyed by ``cloud``.

    The lines of a cloud stay spread over tasks; only the header is one row per cloud.
    """
    names = ["x", "y", "z"] + (["rgb"] if coloured else [])
    n = len(names)
    kind = "F F F U" if coloured else "F F F"
    counts = points.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"))
    text = (f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE {' '.join(['4'] * n)}\nTYPE {kind}\n"
            f"COUNT {' '.join(['1'] * n)}\nWIDTH %d\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS %d\nDATA ascii")
    order = F.col("pid").cast("long") if "pid" in points.columns else F.xxhash64(*[F.col(c) for c in names])
    head = counts.select("cloud", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.format_string(text, "n", "n").alias("value"))
    body = points.select("cloud", F.lit(1).alias("part"), order.alias("at"), F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("value"))
    return head.unionByName(body)


def write_pcd(points: DataFrame, folder: str, coloured: bool = False) -> None:
    """ASCII PCD text, one folder per cloud, header first in the part order.

    Rows are range-partitioned by (cloud, part, point) and sorted, so a large cloud spreads over
    tasks and concatenating a cloud's part files in name order gives the file.  A failed job
    leaves the old folder whole.
    """
    lines = pcd_parts(points, coloured)
    ordered = lines.repartitionByRange("cloud", "part", "at").sortWithinPartitions("cloud", "part", "at")
    name = F.concat(F.lit("cloud="), F.col("cloud").cast("string"))
    write_parts(ordered.select(name.alias("file"), "value"), folder)


def feature_colours(points: DataFrame, feature: str) -> DataFrame:
    """A repeatable colour per feature, as one packed integer ``rgb``."""
    h = F.pmod(F.xxhash64(feature), F.lit(1 << 24))
    return points.withColumn("rgb", h.cast("long"))


def pair_log(results: DataFrame) -> DataFrame:
    """One line of text per registered pair."""
    return results.select(F.format_string(
        "%s %s-%s success=%s rot_err=%.3f trans_err=%.3f", F.col("seq").cast("string"), F.col("src").cast("string"),
        F.col("tgt").cast("string"), F.col("success").cast("string"), "rot_err", "trans_err",
    ).alias("value"))
