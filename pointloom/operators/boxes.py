"""Convex hulls, tight boxes and pole tests of features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import SYM, add, cols, cross, dot, mat_vec, norm, rigid, rotate_sym, sub, with_eigenvalues, with_eigenvector
from ..session import cut_lineage
from .pairs import beside, parts_for
from .running import with_row_number
from .voxels import gaussians

CHUNK = 4096


def hull_rows(p: np.ndarray) -> np.ndarray:
    """Indices of the convex hull of 2-D points, counter-clockwise."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    if len(order) < 3:
        return order

    def half(seq) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = p[out[-2]], p[out[-1]], p[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]))


def _steepest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Per point of ``p``: greatest and least slope to later points of ``q``, least and greatest from earlier ones.

    Points are in order of (u, v).  A point straight above is later and infinitely steep.
    """
    out = np.tile(np.array([-np.inf, np.inf, np.inf, -np.inf]), (len(p), 1))
    step = max(1, (1 << 20) // max(1, len(q)))
    for i in range(0, len(p), step):
        du, dv = (q[None, :, k] - p[i : i + step, None, k] for k in range(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(du == 0, np.inf, dv / du)
        later, before = (du > 0) | ((du == 0) & (dv > 0)), (du < 0) | ((du == 0) & (dv < 0))
        out[i : i + step, 0] = np.where(later, slope, -np.inf).max(axis=1, initial=-np.inf)
        out[i : i + step, 1] = np.where(later, slope, np.inf).min(axis=1, initial=np.inf)
        out[i : i + step, 2] = np.where(before, slope, np.inf).min(axis=1, initial=np.inf)
        out[i : i + step, 3] = np.where(before, slope, -np.inf).max(axis=1, initial=-np.inf)
    return out


def _hull_by_slabs(points: DataFrame, keys: list[str]) -> DataFrame:
    """Hull points of groups of any size, most of whose points may be corners.

    A group is cut by u into slabs of at most ``CHUNK`` points.  A point is a corner above
    if every later point lies less steeply than every earlier one, and below if more
    steeply.  So each slab meets each other one in a task of its own, which returns the
    steepest slopes of its points, and those merge by maximum and minimum.
    """
    placed = with_row_number(points.select(*keys, "u", "v"), keys, ["u", "v"], "_at")
    slab = F.floor((F.col("_at") - 1) / CHUNK).alias("_slab")
    slabs = cut_lineage(placed.groupBy(*keys, slab).agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("_p")))
    other = slabs.select(*keys, F.col("_slab").alias("_other"), F.col("_p").alias("_q"))

    def slopes(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                p, q = (batch.column(c)[r].values for c in ("_p", "_q"))
                p, q = (np.stack([x.field("u").to_numpy(), x.field("v").to_numpy()], axis=1) for x in (p, q))
                own = [pa.array([batch.column(k)[r].as_py()] * len(p), batch.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, p.T), *map(pa.array, _steepest(p, q).T)], [*keys, "u", "v", "a", "b", "c", "d"])

    names = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    met = slabs.drop("_slab").join(other, keys).mapInArrow(slopes, f"{names}, u double, v double, a double, b double, c double, d double")
    met = met.groupBy(*keys, "u", "v").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"))
    # the first point has no earlier one and the last no later one: both are corners
    corner = (F.col("a") < F.col("c")) | (F.col("b") > F.col("d"))
    return points.join(met.filter(corner).select(*keys, "u", "v"), [*keys, "u", "v"], "left_semi").select(points.columns)


def convex_hull(points: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Hull points of ``u, v`` per group; other columns are kept.

    Rows meet in ``parts`` partitions, by default as many as their number asks for.

    Large groups lose most points by the hulls of bounded random chunks, as the hull of
    hulls is the hull.  What then fits a chunk is finished in one; groups that stay larger,
    because most of their points are corners, are compared slab by slab.
    """
    schema = points.schema

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.drop(columns="_part").iloc[hull_rows(pdf[["u", "v"]].to_numpy())]

    parts = parts or parts_for(points)
    left, slabs = points.repartition(parts, *keys, "u", "v").dropDuplicates([*keys, "u", "v"]), None
    for last in (False, True):
        sizes = cut_lineage(left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts")))
        if (sizes.agg(F.max("_parts")).first()[0] or 0) <= 1:
            break
        split = left.join(sizes, keys)
        if last:
            slabs = _hull_by_slabs(split.filter(F.col("_parts") > 1).select(points.columns), keys)
            left = split.filter(F.col("_parts") == 1).select(points.columns)
            break
        split = split.withColumn("_part", F.pmod(F.xxhash64("u", "v"), F.col("_parts"))).drop("_parts")
        left = cut_lineage(split.groupBy(*keys, "_part").applyInPandas(hull, schema))
    done = left.withColumn("_part", F.lit(0)).repartition(parts, *keys).groupBy(*keys).applyInPandas(hull, schema)
    return done if slabs is None else done.unionByName(slabs)


def with_plane_basis(features: DataFrame) -> DataFrame:
    """Two unit vectors ``e*``, ``f*`` that span the plane of the unit normal ``n*``."""
    n = cols("n")
    raw = (n[1] - n[2], -n[0], n[0])
    length = norm(raw)
    # the rule gives no vector for the x axis normal to (0, 1, 1); use any orthogonal one
    safe = length > 1e-12
    e = tuple(F.when(safe, r / length).otherwise(F.lit(v)) for r, v in zip(raw, (1.0, 0.0, 0.0)))
    df = features.withColumns({"e" + a: c for a, c in zip("xyz", e)})
    f = cross(n, cols("e"))
    return df.withColumns({"f" + a: c for a, c in zip("xyz", f)})


#: Candidate box angles: the middles of so many equal parts of a right angle.
ANGLES = 128
#: Angles that are tried in one place.
_TOGETHER = 16


def best_angles(hull: DataFrame, keys: list[str], angles: int = ANGLES) -> DataFrame:
    """Best box of the hull points ``u, v`` of each group among ``angles`` candidates.

    Every point is turned by every candidate; the extremes per (group, angle) give the
    boxes, and a window adds up how far the points are from the border.  Points travel once
    per ``_TOGETHER`` angles, to a number of partitions that follows theirs.  The score is
    area plus that sum; of equal scores (to nine digits) the smaller angle wins.
    """
    parts = parts_for(hull, angles)
    blocks = -(-angles // _TOGETHER)
    dealt = hull.dropna(subset=keys).select(*keys, "u", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    dealt = dealt.repartition(parts, *keys, "_block")
    first = F.col("_block") * _TOGETHER
    degrees = (F.col("k") + 0.5) * F.lit(90.0 / angles)
    turned = dealt.select("*", F.explode(F.sequence(first, F.least(first + _TOGETHER, F.lit(angles)) - 1)).alias("k")).withColumn("angle", degrees)
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    turned = turned.select(*keys, "_block", "k", "angle", (c * F.col("u") + s * F.col("v")).alias("p"), (c * F.col("v") - s * F.col("u")).alias("q"))
    w = Window.partitionBy(*keys, "_block", "k")
    boxed = turned.withColumns({e + n: f(v).over(w) for n, v in (("_u", "p"), ("_v", "q")) for e, f in (("lo", F.min), ("hi", F.max))})
    gap = F.least(F.col("p") - F.col("lo_u"), F.col("hi_u") - F.col("p"), F.col("q") - F.col("lo_v"), F.col("hi_v") - F.col("q"))
    area = (F.col("hi_u") - F.col("lo_u")) * (F.col("hi_v") - F.col("lo_v"))
    corners = ["lo_u", "hi_u", "lo_v", "hi_v"]
    scored = boxed.groupBy(*keys, "_block", "k").agg(F.first("angle").alias("angle"), *[F.first(n).alias(n) for n in corners], F.sum(gap).alias("_gaps"))
    scored = scored.withColumn("score", area + F.col("_gaps"))
    names = ["angle", "lo_u", "hi_u", "lo_v", "hi_v", "score"]
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(F.round("score", 9), "k")).alias("_b"))
    return best.select(*keys, "_b.*")


def tight_boxes(points: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Tight rotated box of each feature: ``size``, ``angle``, ``area``, box centre and its basis.

    ``features`` give the normal ``nx ny nz``.  Points are projected on the plane of the
    normal, reduced to their hull and boxed at the best of the candidate angles.
    """
    based = cut_lineage(with_plane_basis(features.select(*keys, "nx", "ny", "nz")))
    rows = points.select(*keys, "x", "y", "z").join(beside(based, based.count(), 160), keys)  # nine doubles and the keys
    p = cols("")
    flat = rows.select(*keys, dot(p, cols("e")).alias("u"), dot(p, cols("f")).alias("v"))
    depth = rows.groupBy(*keys).agg(F.min(dot(p, cols("n"))).alias("w_low"), F.max(dot(p, cols("n"))).alias("w_high"))
    boxes = best_angles(cut_lineage(convex_hull(flat, keys, parts_for(points))), keys).join(depth, keys).join(based, keys)
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    turned = {**{"g" + a: c * F.col("e" + a) + s * F.col("f" + a) for a in "xyz"}, **{"h" + a: c * F.col("f" + a) - s * F.col("e" + a) for a in "xyz"}}
    boxes = boxes.withColumns(turned)
    mid = [(F.col("lo_u") + F.col("hi_u")) / 2.0, (F.col("lo_v") + F.col("hi_v")) / 2.0, (F.col("w_low") + F.col("w_high")) / 2.0]
    centre = {"c" + a: mid[0] * F.col("g" + a) + mid[1] * F.col("h" + a) + mid[2] * F.col("n" + a) for a in "xyz"}
    size = F.array(F.col("hi_u") - F.col("lo_u"), F.col("hi_v") - F.col("lo_v"), F.col("w_high") - F.col("w_low"))
    out = boxes.withColumns({**centre, "size": size})
    axes = [f"{v}{a}" for v in "ghn" for a in "xyz"]
    return out.select(*keys, "angle", "score", "size", (F.col("size")[0] * F.col("size")[1]).alias("area"), "cx", "cy", "cz", *axes)


def box_covariance(boxes: DataFrame, chi2: float = 7.815) -> DataFrame:
    """Covariance whose chi-square ellipsoid touches the box faces, with its largest eigenvalue."""
    ev = [F.col("size")[i] * F.col("size")[i] / 4.0 / chi2 for i in range(3)]
    axes = [cols(v) for v in "ghn"]
    at = {"x": 0, "y": 1, "z": 2}
    cov = {c: sum((ev[k] * axes[k][at[c[0]]] * axes[k][at[c[1]]] for k in range(3)), F.lit(0.0)) for c in SYM}
    return boxes.withColumns({**cov, "prior": F.greatest(*ev)})


def poles(points: DataFrame, keys: list[str], ratio: float = 30.0, reach: float = 0.5, share: float = 0.5,
          min_points: int = 5, trials: int = 10, seed: int = 7) -> DataFrame:
    """Clusters that are upright lines, with the Gaussian of their line points.

    A cluster must be elongated and upright; then seeded two-point lines are tried and the
    one with most points within ``reach`` wins.  It needs a ``share`` of the points, at
    least ``min_points``, and elongated line points.  Draws are taken as the rows with the
    smallest hashes, so nothing is gathered.
    """
    g = with_eigenvector(with_eigenvalues(gaussians(points, keys)), "l2", ("dx", "dy", "dz"))
    thin = F.col("l2") >= ratio / 2.0 * F.greatest(F.col("l0"), F.lit(0.0))
    long = g.filter(thin & (F.abs(F.col("dz")) >= 0.707)).select(*keys, F.col("n").alias("size"))
    rows = points.select(*keys, "x", "y", "z").join(long, keys)
    w = Window.partitionBy(*keys).orderBy(F.xxhash64("x", "y", "z", F.lit(seed)), "x", "y", "z")
    drawn = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * trials)
    point = F.struct("x", "y", "z")
    lines = drawn.groupBy(*keys, F.floor((F.col("_r") - 1) / 2).alias("draw")).agg(
        F.max(F.when(F.col("_r") % 2 == 1, point)).alias("p"), F.max(F.when(F.col("_r") % 2 == 0, point)).alias("q")
    ).filter(F.col("p").isNotNull() & F.col("q").isNotNull())
    dist = _line_distance()
    tried = rows.join(lines, keys).filter(dist < reach).groupBy(*keys, "draw", "p", "q", "size").agg(F.count(F.lit(1)).alias("hits"))
    best = tried.groupBy(*keys).agg(F.max(F.struct("hits", -F.col("draw"), "p", "q", "size")).alias("_b"))
    ok = (F.col("_b.hits") >= share * F.col("_b.size")) & (F.col("_b.hits") >= min_points)
    best = best.filter(ok).select(*keys, F.col("_b.p").alias("p"), F.col("_b.q").alias("q"))
    inside = rows.join(best, keys).filter(_line_distance() < reach)
    line = with_eigenvector(with_eigenvalues(gaussians(inside, keys)), "l2", ("dx", "dy", "dz"))
    line = line.filter(F.col("l2") >= ratio * F.greatest(F.col("l0"), F.lit(0.0)))
    reach2 = 2.0 * F.sqrt(F.col("l2"))
    ends = {**{"p" + a: F.col("m" + a) - reach2 * F.col("d" + a) for a in "xyz"}, **{"q" + a: F.col("m" + a) + reach2 * F.col("d" + a) for a in "xyz"}}
    return line.withColumns({**ends, **{"n" + a: F.col("d" + a) for a in "xyz"}})


def _line_distance() -> Column:
    p, q = tuple(F.col("p." + a) for a in "xyz"), tuple(F.col("q." + a) for a in "xyz")
    d = sub(q, p)
    return F.try_divide(norm(cross(sub(cols(""), p), d)), norm(d))


def regularized(df: DataFrame, method: str) -> DataFrame:
    """Replace a covariance by a regularised one with the same axes.

    ``PLANE`` and ``LINE`` fix the eigenvalues, ``MIN_EIG`` and ``NORMALIZED_MIN_EIG`` floor
    them, ``FROBENIUS`` rescales, ``NONE`` keeps the matrix.
    """
    if method == "NONE":
        return df
    if method == "FROBENIUS":
        s = {c: F.col(c) + (1e-3 if c[0] == c[1] else 0.0) for c in SYM}
        names = ("xx", "xy", "xz", "yy", "yz", "zz")
        m = [s[n] for n in names]
        adj = (m[3] * m[5] - m[4] * m[4], m[2] * m[4] - m[1] * m[5], m[1] * m[4] - m[2] * m[3],
               m[0] * m[5] - m[2] * m[2], m[1] * m[2] - m[0] * m[4], m[0] * m[3] - m[1] * m[1])
        det = m[0] * adj[0] + m[1] * adj[1] + m[2] * adj[2]
        size = F.sqrt(adj[0] * adj[0] + adj[3] * adj[3] + adj[5] * adj[5] + 2.0 * (adj[1] * adj[1] + adj[2] * adj[2] + adj[4] * adj[4])) / F.abs(det)
        return df.withColumns({n: m[i] * size for i, n in enumerate(names)})
    df = with_eigenvalues(df)
    df = with_eigenvector(with_eigenvector(df, "l2", ("_ax", "_ay", "_az")), "l0", ("_cx", "_cy", "_cz"))
    a, c = cols("_a"), cols("_c")
    top = F.greatest(F.col("l2"), F.lit(1e-300))
    values = {
        "PLANE": [F.lit(1.0), F.lit(1.0), F.lit(1e-3)], "LINE": [F.lit(1.0), F.lit(1e-3), F.lit(1e-3)],
        "MIN_EIG": [F.greatest(F.col(v), F.lit(1e-3)) for v in ("l2", "l1", "l0")],
        "NORMALIZED_MIN_EIG": [F.greatest(F.col(v) / top, F.lit(1e-3)) for v in ("l2", "l1", "l0")],
    }
    if method not in values:
        raise ValueError(f"unknown regularisation: {method}")
    v = values[method]
    b = cross(c, a)
    at = {"x": 0, "y": 1, "z": 2}
    cov = {n: v[0] * a[at[n[0]]] * a[at[n[1]]] + v[1] * b[at[n[0]]] * b[at[n[1]]] + v[2] * c[at[n[0]]] * c[at[n[1]]] for n in SYM}
    return df.withColumns(cov).drop("_ax", "_ay", "_az", "_cx", "_cy", "_cz", "l0", "l1", "l2")


def vertex_features(vertices: DataFrame, chi2: float = 7.815) -> DataFrame:
    """Features of graph vertices (centre and covariance): eigenvalues, axes and box size."""
    df = with_eigenvector(with_eigenvector(with_eigenvalues(vertices), "l0"), "l2", ("dx", "dy", "dz"))
    return df.withColumn("size", F.array(*[2.0 * chi2 * F.sqrt(F.greatest(F.col(v), F.lit(0.0))) for v in ("l0", "l1", "l2")]))


def transform_features(features: DataFrame, tf: str = "tf") -> DataFrame:
    """Move features by a rigid transform: centre, covariance and normal."""
    rot, trans = rigid(tf)
    centre = add(mat_vec(rot, cols("m")), trans)
    cov = rotate_sym(rot, tuple(F.col(c) for c in SYM))
    turned = mat_vec(rot, cols("n"))
    return features.withColumns({
        **{"m" + a: c for a, c in zip("xyz", centre)}, **dict(zip(SYM, cov)), **{"n" + a: c for a, c in zip("xyz", turned)},
    })
