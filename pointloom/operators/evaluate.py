"""Benchmark statistics of registration results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import mat_mul, mat_t, mat_vec, norm, rigid, rotation_angle_deg, sub
from .fitting import residual2

TIMES = ("feature_time", "tf_solver_time", "clique_time", "graph_time", "verify_time", "total_time")
INLIERS = ("plane_inliers", "line_inliers", "cluster_inliers")


def pose_errors(est: Column | str, truth: Column | str) -> tuple[Column, Column]:
    """Rotation error in degrees and translation error, in the frame of the truth."""
    re, te = rigid(est)
    rt, tt = rigid(truth)
    back = mat_t(rt)
    return rotation_angle_deg(mat_mul(back, re)), norm(mat_vec(back, sub(te, tt)))


def with_success(results: DataFrame, rot_thresh: float = 5.0, trans_thresh: float = 2.0) -> DataFrame:
    """Errors and success of ``tf`` against ``truth``, and of the best of ``candidates``."""
    rot, trans = pose_errors("tf", "truth")
    df = results.withColumns({"rot_err": rot, "trans_err": trans})
    df = df.withColumn("success", (F.col("rot_err") < rot_thresh) & (F.col("trans_err") < trans_thresh))
    if "candidates" not in results.columns:
        return df

    def good(c: Column) -> Column:
        r, t = pose_errors(c, F.col("truth"))
        return (r < rot_thresh) & (t < trans_thresh)

    return df.withColumn("success_upper", F.exists("candidates", good))


def summarize(results: DataFrame, group: str = "seq") -> DataFrame:
    """Means, success rates and errors overall and per sequence in one pass.

    The overall row has a null ``seq`` and ``overall`` set.  Error statistics use
    successful pairs only; ``*_std`` is the spread about the mean that older reports call
    RMSE, ``*_rmse`` the root mean square itself.
    """
    good = F.col("success")

    def only(c: str) -> Column:
        return F.when(good, F.col(c))

    aggs = [F.count(F.lit(1)).alias("pairs"), (100.0 * F.avg(good.cast("double"))).alias("success_rate")]
    if "success_upper" in results.columns:
        aggs.append((100.0 * F.avg(F.col("success_upper").cast("double"))).alias("success_rate_upper"))
    for c in (*TIMES, *INLIERS):
        if c in results.columns:
            aggs.append(F.avg(c).alias(c + "_avg"))
    for c in ("rot_err", "trans_err"):
        if c in results.columns:
            aggs += [
                F.avg(only(c)).alias(c + "_mae"), F.stddev_pop(only(c)).alias(c + "_std"),
                F.sqrt(F.avg(only(c) * only(c))).alias(c + "_rmse"),
            ]
    grouped = results.rollup(group).agg(F.grouping(group).alias("_g"), *aggs)
    return grouped.withColumn("overall", F.col("_g") == 1).drop("_g")


def match_precision(corr: DataFrame, truth: DataFrame, pair: list[str], radius: float = 0.5) -> DataFrame:
    """True positives and precision (%) of each pair's correspondences under the true pose."""
    rows = corr.join(truth, pair)
    hit = F.sqrt(residual2("truth")) < radius
    return rows.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(hit).alias("tp"), (100.0 * F.avg(hit.cast("double"))).alias("precision")
    )


def match_summary(metrics: DataFrame) -> DataFrame:
    """Mean precision and true positives, and the share of pairs with at least 1 and 3 hits."""
    return metrics.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("precision").alias("precision"), F.avg("tp").alias("tp"),
        (100.0 * F.avg((F.col("tp") >= 1).cast("double"))).alias("success_1"),
        (100.0 * F.avg((F.col("tp") >= 3).cast("double"))).alias("success_3"),
    )
