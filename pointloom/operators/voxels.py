"""Voxel keys, Gaussian statistics and downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import SYM, with_eigenvalues, with_eigenvector
from .running import with_row_number

MEAN = ("mx", "my", "mz")
SUMS = ("n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")
KEY = ("vx", "vy", "vz")


def voxel_key(size: float | tuple[float, float, float], xyz=("x", "y", "z")) -> dict[str, Column]:
    """Integer cell of a point: floor of each coordinate over the cell size."""
    sizes = size if isinstance(size, tuple) else (size,) * 3
    return {k: F.floor(F.col(c) / F.lit(float(s))).cast("int") for k, c, s in zip(KEY, xyz, sizes)}


def with_voxel(points: DataFrame, size) -> DataFrame:
    return points.withColumns(voxel_key(size))


def gaussian_sums(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Count and the nine first and second moment sums per group.

    Plain sums, so Spark combines them map-side and partial results merge by adding.
    """
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    terms = (x, y, z, x * x, x * y, x * z, y * y, y * z, z * z)
    if weight is not None:
        terms = tuple(F.when(weight, t) for t in terms)
        count = F.count_if(weight)
    else:
        count = F.count(F.lit(1))
    return points.groupBy(*keys).agg(
        count.alias("n"), *[F.sum(t).alias(name) for name, t in zip(SUMS[1:], terms)]
    )


def merge_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partial Gaussians to coarser groups."""
    return sums.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])


def to_gaussians(sums: DataFrame) -> DataFrame:
    """Mean and population covariance from moment sums."""
    n = F.col("n")
    df = sums.withColumns({m: F.col(s) / n for m, s in zip(MEAN, SUMS[1:4])})
    mean = {a: F.col(m) for a, m in zip("xyz", MEAN)}
    return df.withColumns({c: F.col("s" + c) / n - mean[c[0]] * mean[c[1]] for c in SYM}).drop(*SUMS[1:])


def gaussians(points: DataFrame, keys: list[str]) -> DataFrame:
    return to_gaussians(gaussian_sums(points, keys))


def merge_gaussians(gs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge (n, mean, covariance) rows exactly, as if their points were pooled."""
    n = F.col("n")
    mean = {a: F.col(m) for a, m in zip("xyz", MEAN)}
    first = {f"s{a}": mean[a] * n for a in "xyz"}
    second = {"s" + c: (F.col(c) + mean[c[0]] * mean[c[1]]) * n for c in SYM}
    return to_gaussians(merge_sums(gs.select(*keys, "n", *[e.alias(k) for k, e in {**first, **second}.items()]), keys))


def with_shape(gs: DataFrame, direction: bool = False) -> DataFrame:
    """Eigenvalues, normal and, if asked, main direction of each Gaussian."""
    gs = with_eigenvector(with_eigenvalues(gs), "l0")
    return with_eigenvector(gs, "l2", ("dx", "dy", "dz")) if direction else gs


def planarity(min_points: int, ratio: float) -> Column:
    """Enough points and a clearly smallest eigenvalue.

    Written without a division, so a zero eigenvalue counts as perfectly planar.
    """
    return (F.col("n") >= min_points) & (F.col("l1") >= F.lit(float(ratio)) * F.greatest(F.col("l0"), F.lit(0.0)))


def voxel_gaussians(points: DataFrame, keys: list[str], size, min_points: int = 10, ratio: float = 30.0) -> DataFrame:
    """One row per voxel with statistics, shape and the planar flag."""
    gs = with_shape(gaussians(with_voxel(points, size), [*keys, *KEY]))
    return gs.withColumn("planar", planarity(min_points, ratio))


def downsample(points: DataFrame, keys: list[str], size) -> DataFrame:
    """Voxel-grid filter: the centroid of each occupied cell."""
    return (
        with_voxel(points, size)
        .groupBy(*keys, *KEY)
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))
    )


def sample_per_voxel(points: DataFrame, keys: list[str], size, k: int, order: list[str]) -> DataFrame:
    """Evenly stepped sample of up to ``k`` points per voxel; the centroid when k is 1."""
    if k == 1:
        return downsample(points, keys, size).drop("n")
    cell = [*keys, *KEY]
    counted = with_voxel(points, size)
    counts = counted.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_row_number(counted, cell, order, "rn").join(counts, cell)
    step = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    at = F.col("rn") - 1
    keep = (F.col("n") <= k) | ((at % step == 0) & (at / step < k))
    return ranked.filter(keep).drop("rn", "n")


#: Cell numbers run from -HALF_SPAN to HALF_SPAN - 1 on every axis.
HALF_SPAN = 1 << 20


def cell_id(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """One number per cell: 21 bits an axis; a cell outside the span is an error."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("long") for c in (x, y, z)]
    inside = F.lit(True)
    for c in parts:
        inside = inside & c.between(-HALF_SPAN, HALF_SPAN - 1)
    a, b, c = (p + HALF_SPAN for p in parts)
    code = (a * (2 * HALF_SPAN) + b) * (2 * HALF_SPAN) + c
    return F.when(inside, code).otherwise(F.raise_error(F.lit("cell outside the span of cell ids")).cast("long"))


def cell_id_sql(x: str, y: str, z: str) -> str:
    n = 2 * HALF_SPAN
    return f"((CAST({x} AS BIGINT) + {HALF_SPAN}) * {n} + (CAST({y} AS BIGINT) + {HALF_SPAN})) * {n} + (CAST({z} AS BIGINT) + {HALF_SPAN})"


def first_per_cell(points: DataFrame, cell: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Keep the first point of every cell.

    A ``min`` over (order, value) structs combines map-side, so no cell is gathered.
    """
    first = F.min(F.struct(*order, *[v for v in value if v not in order])).alias("_f")
    return points.groupBy(*cell).agg(first).select(*cell, "_f.*")


def top_k(df: DataFrame, keys: list[str], k: int, order: list) -> DataFrame:
    """Top k rows per group; Spark prunes to k per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def box_filter(points: DataFrame, max_range: float) -> DataFrame:
    """Axis-aligned crop to +-max_range."""
    keep = F.lit(True)
    for c in "xyz":
        keep = keep & F.col(c).between(-max_range, max_range)
    return points.filter(keep)


def as_array(points: DataFrame) -> DataFrame:
    """Coordinates as one ``xyz`` array column."""
    return points.withColumn("xyz", F.array(*[F.col(c).cast("double") for c in "xyz"])).drop("x", "y", "z")


def from_array(points: DataFrame) -> DataFrame:
    """Inverse of :func:`as_array`, as float32 coordinates."""
    return points.withColumns({c: F.col("xyz")[i].cast("float") for i, c in enumerate("xyz")}).drop("xyz")


def with_intensity(points: DataFrame, value: Column | float = 0.0) -> DataFrame:
    """Add an intensity, for example a cluster label."""
    return points.withColumn("intensity", (value if isinstance(value, Column) else F.lit(value)).cast("float"))
