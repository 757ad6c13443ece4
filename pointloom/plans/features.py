"""Ellipsoid features of clouds: voxels, classes, top-k lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import cols, norm
from ..functions.scalar import eigenvalue_feature, feature_score
from ..operators.voxels import KEY, cell_id, gaussians, top_k, with_shape, with_voxel


@dataclass(frozen=True)
class FeatureRule:
    """How voxels become features."""

    size: float = 1.0
    min_points: int = 10
    plane_ratio: float = 30.0
    line_ratio: float = 60.0
    min_range: float = 2.0
    max_range: float = 80.0
    per_class: int = 50


def classify(rule: FeatureRule):
    """Line, plane or cluster from the eigenvalue ratios."""
    l0 = F.greatest(F.col("l0"), F.lit(0.0))
    return (
        F.when((F.col("l1") >= rule.plane_ratio * l0), F.lit("Plane"))
        .when((F.col("l2") >= rule.line_ratio * l0), F.lit("Line"))
        .otherwise(F.lit("Cluster"))
    )


def voxel_features(points: DataFrame, rule: FeatureRule) -> DataFrame:
    """Gaussian feature per well-filled voxel, with class and score."""
    gs = gaussians(with_voxel(points, rule.size), ["cloud", *KEY]).filter(F.col("n") >= rule.min_points)
    shaped = with_shape(gs).withColumn("class", classify(rule))
    score = feature_score(F.col("class"), F.col("l0"), F.col("l1"), F.col("l2"))
    return shaped.withColumns(
        {
            # rounded so that equal scores tie the same way on every engine
            "score": F.round(score, 6),
            "id": cell_id("vx", "vy", "vz"),
            "dist": norm(cols("m")),
        }
    )


def in_range(features: DataFrame, rule: FeatureRule) -> DataFrame:
    """Features inside the range ring."""
    return features.filter(F.col("dist").between(rule.min_range, rule.max_range))


def top_features(features: DataFrame, rule: FeatureRule) -> DataFrame:
    """Features inside the range ring, best ``per_class`` by score in each class."""
    return top_k(in_range(features, rule), ["cloud", "class"], rule.per_class, [F.desc("score"), F.col("id")])


def spread_descriptor() -> Column:
    """Square roots of the eigenvalues, ascending."""
    return F.array(*[F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for c in ("l0", "l1", "l2")])


def eigen_descriptor() -> Column:
    return F.array(*eigenvalue_feature(F.col("l0"), F.col("l1"), F.col("l2")))


def pair_sides(features: DataFrame, pairs: DataFrame, desc) -> tuple[DataFrame, DataFrame]:
    """Features of the two clouds of each pair, keyed by the pair."""
    feats = features.select("cloud", "class", "id", desc.alias("desc"))
    sides = []
    for side in ("src", "tgt"):
        sides.append(
            pairs.select("src", "tgt", F.col(side).alias("cloud")).join(feats, "cloud").drop("cloud")
        )
    return sides[0], sides[1]
