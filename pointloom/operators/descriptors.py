"""Local descriptors: sparse distance-angle histograms, FPFH and ISS keypoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import clamp, cols, cross, dot, fence, norm, with_eigenvalues, with_eigenvector
from ..functions.scalar import axis_distance
from ..session import cut_lineage
from .spatial import radius_pairs
from .voxels import gaussians

BINS = 11


def oriented_pairs(points: DataFrame, keys: list[str], radius: float, extra: list[str]) -> DataFrame:
    """Neighbour pairs with position ``x y z``, axis ``nx ny nz`` and ``extra`` columns of both ends.

    ``points`` are feature lists or voxel-filtered clouds, whose density is bounded.
    """
    return radius_pairs(points, points, keys, radius, ["x", "y", "z", "nx", "ny", "nz", *extra])


def hash_bins(features: DataFrame, keys: list[str], radius: float = 20.0) -> DataFrame:
    """Sparse histogram of (larger distance, smaller distance, angle) to all neighbours.

    Distances are measured along each end's axis (from the axis for lines).  The feature
    itself counts as a neighbour.
    """
    near = oriented_pairs(features, keys, radius, ["class"])
    delta = tuple(F.col("b" + c) - F.col("a" + c) for c in "xyz")
    na, nb = cols("an"), cols("bn")
    d1 = axis_distance(delta, na, F.col("aclass"))
    d2 = axis_distance(delta, nb, F.col("bclass"))
    angle = F.degrees(F.acos(clamp(dot(na, nb), -1.0, 1.0)))
    near = near.withColumns({"_hi": F.greatest(d1, d2), "_lo": F.least(d1, d2), "_an": angle})
    bins = {"bx": F.floor(F.col("_hi") / 0.5), "by": F.floor(F.col("_lo") / 0.5), "bz": F.floor(F.col("_an") / 1.0)}
    return near.groupBy(*keys, F.col("a").alias("id"), *[c.cast("int").alias(n) for n, c in bins.items()]).agg(F.count(F.lit(1)).alias("n"))


def pair_features(near: DataFrame) -> DataFrame:
    """Darboux-frame angles f1 f2 f3 of every oriented pair.

    The end whose axis is closer to the connecting line is the frame's origin.
    """
    d = tuple(F.col("b" + c) - F.col("a" + c) for c in "xyz")
    df = near.filter(F.col("d2") > 0).withColumns({**{"_d" + c: v for c, v in zip("xyz", d)}, "_len": norm(d)})
    unit = tuple(F.try_divide(F.col("_d" + c), F.col("_len")) for c in "xyz")
    c1, c2 = dot(cols("an"), unit), dot(cols("bn"), unit)
    swap = F.acos(F.least(F.abs(c1), F.lit(1.0))) > F.acos(F.least(F.abs(c2), F.lit(1.0)))
    df = df.withColumn("_swap", swap)
    pick = {
        **{"_u" + c: F.when(F.col("_swap"), F.col("bn" + c)).otherwise(F.col("an" + c)) for c in "xyz"},
        **{"_w" + c: F.when(F.col("_swap"), F.col("an" + c)).otherwise(F.col("bn" + c)) for c in "xyz"},
        **{"_e" + c: F.try_divide(F.when(F.col("_swap"), -F.col("_d" + c)).otherwise(F.col("_d" + c)), F.col("_len")) for c in "xyz"},
    }
    df = df.withColumns({n: fence(c) for n, c in pick.items()})
    u, w, e = cols("_u"), cols("_w"), cols("_e")
    df = df.withColumns({"f3": dot(u, e), **{"_v" + c: v for c, v in zip("xyz", cross(e, u))}})
    df = df.withColumn("_vn", fence(norm(cols("_v")))).filter(F.col("_vn") > 1e-12)
    v = tuple(F.try_divide(F.col("_v" + c), F.col("_vn")) for c in "xyz")
    df = df.withColumns({"_p" + c: fence(x) for c, x in zip("xyz", v)})
    v = cols("_p")
    return df.withColumns({"f2": dot(v, w), "f1": F.atan2(dot(cross(u, v), w), dot(u, w))})


def _bin(value: Column) -> Column:
    """Eleven equal bins over [0, 1)."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(value * BINS))).cast("int")


def fpfh(points: DataFrame, keys: list[str], radius: float, wanted: DataFrame | None = None) -> DataFrame:
    """33-bin fast point feature histogram ``desc`` of every point, or of ``wanted`` ids.

    Every point gets a row.  First the simple histogram of each point's pairs, then the sum of the neighbours'
    histograms weighted by inverse squared distance; each third is scaled to 100.
    """
    near = cut_lineage(pair_features(oriented_pairs(points, keys, radius, [])).select(*keys, "a", "b", "d2", "f1", "f2", "f3"))
    slots = F.array(
        _bin((F.col("f1") + math.pi) / (2.0 * math.pi)), _bin((F.col("f2") + 1.0) / 2.0) + BINS,
        _bin((F.col("f3") + 1.0) / 2.0) + 2 * BINS,
    )
    total = near.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("_n"))
    simple = near.select(*keys, "a", F.explode(slots).alias("slot")).groupBy(*keys, "a", "slot").agg(F.count(F.lit(1)).alias("_c"))
    simple = simple.join(total, [*keys, "a"]).select(*keys, F.col("a").alias("b"), "slot", (100.0 * F.col("_c") / F.col("_n")).alias("h"))
    used = near if wanted is None else near.join(wanted.select(*keys, F.col("id").alias("a")), [*keys, "a"], "left_semi")
    mixed = used.join(simple, [*keys, "b"]).groupBy(*keys, "a", "slot").agg(F.sum(F.try_divide(F.col("h"), F.col("d2"))).alias("v"))
    third = F.floor(F.col("slot") / BINS)
    sums = mixed.groupBy(*keys, "a", third.alias("third")).agg(F.sum("v").alias("_t"))
    scaled = mixed.withColumn("third", third).join(sums, [*keys, "a", "third"])
    scaled = scaled.withColumn("v", F.when(F.col("_t") > 0, 100.0 * F.col("v") / F.col("_t")).otherwise(0.0))
    every = (points if wanted is None else points.join(wanted.select(*keys, "id"), [*keys, "id"], "left_semi")).select(*keys, "id")
    filled = scaled.groupBy(*keys, F.col("a").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("_m"))
    desc = F.transform(F.sequence(F.lit(0), F.lit(3 * BINS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("int")), F.lit(0.0)))
    filled = every.join(filled, [*keys, "id"], "left")  # zeros where nothing was counted
    return filled.select(*keys, "id", desc.alias("desc"))


def normals(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Normal of every point from the covariance of its neighbours, facing the sensor."""
    near = radius_pairs(points, points, keys, radius, ["x", "y", "z"])
    g = gaussians(near.select(*keys, F.col("a").alias("id"), *[F.col("b" + a).alias(a) for a in "xyz"]), [*keys, "id"])
    g = with_eigenvector(with_eigenvalues(g), "l0").select(*keys, "id", "nx", "ny", "nz")
    out = points.select(*keys, "id", "x", "y", "z").join(g, [*keys, "id"])
    away = dot(cols("n"), cols("")) > 0
    return out.withColumns({"n" + a: F.when(away, -F.col("n" + a)).otherwise(F.col("n" + a)) for a in "xyz"})


def iss_keypoints(points: DataFrame, keys: list[str], resolution: float, gamma: float = 0.975, min_neighbours: int = 4) -> DataFrame:
    """Intrinsic shape signature keypoints of a voxel-filtered cloud.

    Saliency is the smallest eigenvalue of the scatter about a point, for points whose
    eigenvalues differ enough; only local maxima with enough neighbours stay.
    """
    both = radius_pairs(points, points, keys, 6.0 * resolution, ["x", "y", "z"]).filter(F.col("a") != F.col("b"))
    d = {c: F.col("b" + c) - F.col("a" + c) for c in "xyz"}
    scatter = both.groupBy(*keys, F.col("a").alias("id")).agg(
        F.count(F.lit(1)).alias("near"), *[F.avg(d[n[0]] * d[n[1]]).alias(n) for n in ("xx", "xy", "xz", "yy", "yz", "zz")]
    ).filter(F.col("near") >= min_neighbours)
    shaped = with_eigenvalues(scatter)
    ok = (F.col("l1") < gamma * F.col("l2")) & (F.col("l0") < gamma * F.col("l1"))
    salient = cut_lineage(shaped.select(*keys, "id", F.when(ok, F.col("l0")).otherwise(0.0).alias("saliency")))
    # only salient points can be kept; every neighbour with a saliency counts
    there = cut_lineage(points.select(*keys, "id", "x", "y", "z").join(salient, [*keys, "id"]))
    ring = radius_pairs(there.filter("saliency > 0").drop("saliency"), there, keys, 4.0 * resolution, ["saliency"]).filter(F.col("a") != F.col("b"))
    top = ring.groupBy(*keys, F.col("a").alias("id")).agg(F.max("bsaliency").alias("_m"), F.count(F.lit(1)).alias("_n"))
    out = salient.filter("saliency > 0").join(top, [*keys, "id"])
    out = out.filter((F.col("saliency") > F.col("_m")) & (F.col("_n") >= min_neighbours)).select(*keys, "id", "saliency")
    return points.join(out, [*keys, "id"])
