"""Scalar functions: robust kernels, residuals, descriptors, codes and indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import cross, dot, norm, scale, sub

# Feature-type codes that stored results use.
FEATURE_TYPES = {"None": -1, "Cluster": 0, "Line": 1, "Plane": 2, "Free": 3, "Unknown": 4}


def feature_code(name: Column) -> Column:
    """Integer code of a feature-type name."""
    out = F.lit(None).cast("int")
    for label, code in FEATURE_TYPES.items():
        out = F.when(name == label, F.lit(code)).otherwise(out)
    return out


def feature_name(code: Column) -> Column:
    """Printable name of a feature-type code."""
    out = F.lit("Unknown")
    for label, value in FEATURE_TYPES.items():
        out = F.when(code == value, F.lit(label)).otherwise(out)
    return out


def robust_kernel(r: Column, c: float, kind: str) -> Column:
    """Robust loss of residual ``r`` at scale ``c``."""
    r2, c2 = r * r, F.lit(float(c) * float(c))
    c = F.lit(float(c))
    kind = kind.lower()
    if kind == "huber":
        return F.when(F.abs(r) <= c, r2 / 2.0).otherwise(c * (F.abs(r) - c / 2.0))
    if kind == "cauchy":
        return c2 * F.log(1.0 + r2 / c2)
    if kind == "tukey":
        rest = 1.0 - r2 / c2
        return F.when(F.abs(r) <= c, c2 / 6.0 * (1.0 - rest * rest * rest)).otherwise(c2 / 6.0)
    if kind == "geman_mcclure":
        return r2 / (2.0 * (c2 + r2))
    if kind == "tls":
        return F.least(r2, c2) / 2.0
    if kind == "dcs":
        return c2 * (1.0 - F.exp(-r2 / (2.0 * c2)))
    raise ValueError(f"unknown robust kernel: {kind}")


def voxel_residual(query, target, kind: Column, axis) -> Column:
    """Point to voxel residual: along the normal for planes, across the direction for lines."""
    d = sub(query, target)
    return (
        F.when(kind == "Plane", dot(d, axis))
        .when(kind == "Line", norm(cross(d, axis)))
        .otherwise(norm(d))
    )


def axis_distance(delta, axis, kind: Column) -> Column:
    """Distance along a normal, or from an axis for line features."""
    along = dot(delta, axis)
    across = sub(delta, scale(axis, along))
    return F.when(kind == "Line", norm(across)).otherwise(F.abs(along))


def eigenvalue_feature(l0: Column, l1: Column, l2: Column) -> list[Column]:
    """Linearity, planarity, sphericity, omnivariance, anisotropy, eigentropy, sum, curvature."""
    l0, l1, l2 = (F.greatest(v, F.lit(0.0)) for v in (l0, l1, l2))  # rounding may leave a flat one below 0
    total = l0 + l1 + l2
    e1, e2, e3 = (F.coalesce(F.try_divide(v, total), F.lit(0.0)) for v in (l2, l1, l0))

    def entropy(e: Column) -> Column:
        return F.when(e > 0, -e * F.log(e)).otherwise(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return [
        ratio(e1 - e2, e1),
        ratio(e2 - e3, e1),
        ratio(e3, e1),
        F.pow(e1 * e2 * e3, F.lit(1.0 / 3.0)),
        ratio(e1 - e3, e1),
        entropy(e1) + entropy(e2) + entropy(e3),
        e1 + e2 + e3,
        ratio(e3, e1 + e2 + e3),
    ]


def feature_score(kind: Column, l0: Column, l1: Column, l2: Column) -> Column:
    """Ranking score: normalised volume for clusters, raw spreads for planes and lines."""
    total = l0 + l1 + l2
    return (
        F.when((kind == "Cluster") & (total > 0), (l0 / total) * (l1 / total) * (l2 / total))
        .when(kind == "Plane", l1 * l2)
        .when(kind == "Line", l2)
        .otherwise(F.lit(0.0))
    )


def descriptor_distance(a: Column, b: Column, metric: str = "2-norm", legacy: bool = False) -> Column:
    """Dissimilarity of two array descriptors; smaller is more alike."""
    if metric == "2-norm":
        squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))
    if metric == "iou3d":
        overlap = F.lit(1.0)
        for i in range(3):
            # ``legacy`` multiplies the differences, as older result files did
            side = F.abs(a[i] - b[i]) if legacy else F.least(a[i], b[i])
            overlap = overlap * side
        union = a[0] * a[1] * a[2] + b[0] * b[1] * b[2] - overlap
        return 1.0 - F.coalesce(F.try_divide(overlap, union), F.lit(0.0))
    raise ValueError(f"unknown metric: {metric}")


def bin_overlap_distance(hits: Column, legacy: bool = False) -> Column:
    """1 / (1 + hits) for histogram overlap; ``legacy`` truncates it to an integer."""
    value = 1.0 / (1.0 + hits.cast("double"))
    return F.floor(value).cast("double") if legacy else value


def plane_consistent(center_a, normal_a, center_b, normal_b, max_offset: float, min_cos: float) -> Column:
    """Plane a accepts plane b: small offset along a's normal and parallel normals."""
    offset = F.abs(dot(sub(center_b, center_a), normal_a))
    return (offset <= max_offset) & (F.abs(dot(normal_b, normal_a)) >= min_cos)


def convex_neighbours(mean_a, normal_a, mean_b, normal_b, normal_rate: float = 0.03, dist_rate: float = 0.1) -> Column:
    """Two ground cells continue each other without a step or a crease."""
    d = sub(mean_b, mean_a)
    length = norm(d)
    flat = F.abs(dot(normal_a, d)) <= length * F.sin(F.lit(dist_rate))
    flat_back = F.abs(dot(normal_b, d)) <= length * F.sin(F.lit(dist_rate))
    return (dot(normal_a, normal_b) >= 1.0 - F.sin(length * normal_rate)) & flat & flat_back


def pair_to_index(i: Column, j: Column, n: Column) -> Column:
    """Linear index of the pair i < j among n items, in row order."""
    return (i * (2 * n - i - 1) / 2).cast("long") + j - i - 1


def index_to_pair(k: Column, n: Column) -> tuple[Column, Column]:
    """Inverse of :func:`pair_to_index`."""
    b = 2 * n - 1
    root = F.sqrt((b * b - 8 * k).cast("double"))
    i = F.floor((b - root) / 2).cast("long")
    # the square root may round up to the next row
    i = F.when((i * (2 * n - i - 1) / 2).cast("long") > k, i - 1).otherwise(i)
    return i, k - (i * (2 * n - i - 1) / 2).cast("long") + i + 1


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
