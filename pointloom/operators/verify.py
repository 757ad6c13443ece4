"""Scoring of candidate transforms against the target cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import rigid_apply
from ..functions.scalar import robust_kernel, voxel_residual
from .spatial import nearest


def drop_near_repeats(candidates: DataFrame, pair: list[str], tolerance: float = 0.1) -> DataFrame:
    """Skip a candidate within ``tolerance`` (Frobenius) of the last one kept, in level order."""
    rows = candidates.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("level", "tf"))).alias("_l"))

    def gap(p: Column, q: Column) -> Column:
        squares = F.zip_with(p, q, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))

    # at most one entry per pyramid level
    kept = F.aggregate(
        F.slice("_l", 2, F.size("_l")), F.slice("_l", 1, 1),
        lambda acc, x: F.when(gap(F.element_at(acc, -1).tf, x.tf) < tolerance, acc).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.select(*pair, F.explode(kept).alias("_c")).select(*pair, "_c.level", "_c.tf")


def score_candidates(samples: DataFrame, targets: DataFrame, candidates: DataFrame, pair: list[str], kernel: str,
                     scale: float, squared: bool = False) -> DataFrame:
    """Mean robust residual of every candidate.

    ``samples``: pair, ``sid``, x y z.  ``targets``: pair, ``tid``, x y z and, unless
    ``squared``, voxel ``kind`` and axis ``ax ay az``.  ``squared`` feeds the squared
    distance to the kernel, as the dense point verifier does.
    """
    moved = samples.join(candidates, pair)
    point = rigid_apply("tf", tuple(F.col(c) for c in "xyz"))
    queries = moved.select(*pair, F.struct("level", "sid").alias("qid"), *[p.alias(c) for p, c in zip(point, "xyz")])
    if squared:
        rows = nearest(queries, targets.select(*pair, "tid", "x", "y", "z"), pair)
        value = F.col("d2")
    else:
        centre = {"v" + c: F.col(c) for c in "xyz"}
        rows = nearest(queries, targets.withColumns(centre), pair, [*centre, "kind", "ax", "ay", "az"])
        value = voxel_residual(
            tuple(F.col(c) for c in "xyz"), tuple(F.col("v" + c) for c in "xyz"), F.col("kind"),
            tuple(F.col("a" + c) for c in "xyz"),
        )
    rows = rows.withColumn("_r", value)
    return rows.groupBy(*pair, F.col("qid.level").alias("level")).agg(
        F.avg(robust_kernel(F.col("_r"), scale, kernel)).alias("score"), F.count(F.lit(1)).alias("n")
    )


def best_candidate(scores: DataFrame, candidates: DataFrame, pair: list[str], digits: int = 12) -> DataFrame:
    """Candidate with the least score; pairs without any score keep their first candidate."""
    rows = candidates.join(scores, [*pair, "level"], "left")
    order = F.struct(F.col("score").isNull().alias("none"), F.round("score", digits).alias("s"), "level")
    return rows.groupBy(*pair).agg(F.min_by(F.struct("level", "tf", "score"), order).alias("_b")).select(
        *pair, "_b.level", "_b.tf", "_b.score"
    )


def inliers_by_class(inliers: DataFrame, pair: list[str]) -> DataFrame:
    """Plane, line and cluster inlier counts per pair."""
    return inliers.groupBy(*pair).agg(
        *[F.count_if(F.col("class") == name).alias(f"{name.lower()}_inliers") for name in ("Plane", "Line", "Cluster")]
    )
