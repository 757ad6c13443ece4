"""Compatibility graph over the correspondences of a cloud pair.

A correspondence row has the pair keys, ``corr_id``, the source point ``sx sy sz`` and
the target point ``tx ty tz``.  The ellipse and Gaussian rules also read the feature
covariances (``sxx .. szz``, ``txx .. tzz``) and largest eigenvalues ``sl2``, ``tl2``.
Two correspondences agree when the source and the target distance agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import SYM, add, clamp, fence, norm, sub, sym_det
from .pairs import TILE_ROWS, tiled_pairs

MIN_LENGTH = 1e-6


def _side(prefix: str, side: str, names=("x", "y", "z")):
    return tuple(F.col(f"{prefix}{side}{n}") for n in names)


def spectral_bound(s, prior: Column) -> Column:
    """Cheap upper bound on the largest eigenvalue: row sums, trace bound, prior."""
    rows = F.greatest(
        F.abs(s[0]) + F.abs(s[1]) + F.abs(s[2]),
        F.abs(s[1]) + F.abs(s[3]) + F.abs(s[4]),
        F.abs(s[2]) + F.abs(s[4]) + F.abs(s[5]),
    )
    m = (s[0] + s[3] + s[5]) / 3.0
    squares = s[0] * s[0] + s[3] * s[3] + s[5] * s[5] + 2.0 * (s[1] * s[1] + s[2] * s[2] + s[4] * s[4])
    spread = m + F.sqrt(2.0 * F.greatest(squares / 3.0 - m * m, F.lit(0.0)))
    return F.least(rows, spread, prior)


def _product(a, b):
    full_a = (a[0], a[1], a[2], a[1], a[3], a[4], a[2], a[4], a[5])
    full_b = (b[0], b[1], b[2], b[1], b[3], b[4], b[2], b[4], b[5])
    return [
        full_a[3 * i] * full_b[j] + full_a[3 * i + 1] * full_b[3 + j] + full_a[3 * i + 2] * full_b[6 + j]
        for i in range(3) for j in range(3)
    ]


def with_shape_gap(df: DataFrame, a, b, name: str = "gap") -> DataFrame:
    """Squared Wasserstein distance of two covariances, without the mean term.

    tr((A^1/2 B A^1/2)^1/2) is the sum of the roots of the eigenvalues of AB, which come
    from the trigonometric solution of its characteristic cubic.
    """
    m = _product(a, b)
    e1 = m[0] + m[4] + m[8]
    tr2 = sum((m[3 * i + j] * m[3 * j + i] for i in range(3) for j in range(3)), F.lit(0.0))
    df = df.withColumns({"_e1": fence(e1), "_e2": fence((e1 * e1 - tr2) / 2.0), "_e3": fence(sym_det(a) * sym_det(b)),
                         "_tr": a[0] + a[3] + a[5] + b[0] + b[3] + b[5]})
    q = F.col("_e1") / 3.0
    df = df.withColumn("_p", fence(F.sqrt(F.greatest(q * q - F.col("_e2") / 3.0, F.lit(0.0)))))
    p = F.col("_p")
    r = (2.0 * q * q * q - F.col("_e2") * q + F.col("_e3")) / (2.0 * p * p * p)
    df = df.withColumn("_phi", fence(F.when(p > 1e-100, F.acos(clamp(r, -1.0, 1.0)) / 3.0).otherwise(F.lit(0.0))))
    roots = F.lit(0.0)
    for k in range(3):
        value = q + 2.0 * p * F.cos(F.col("_phi") + F.lit(2.0 * math.pi * k / 3.0))
        roots = roots + F.sqrt(F.greatest(value, F.lit(0.0)))
    return df.withColumn(name, fence(F.col("_tr") - 2.0 * roots)).drop("_e1", "_e2", "_e3", "_tr", "_p", "_phi")


def _level(tests: list[Column]) -> Column:
    """First level whose test passes; later levels pass as well, so this is enough."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(tests))):
        out = F.when(tests[i], F.lit(i)).otherwise(out)
    return out


def compatible_pairs(corr: DataFrame, pair: list[str], levels: list[float], kind: str = "point",
                     tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Edges ``u < v`` with the first level ``min_level`` at which they are compatible.

    ``levels`` are ascending noise bounds (chi-square quantiles for ``ellipse``).
    """
    extra = kind in ("ellipse", "gaussian")
    names = ["corr_id", *[s + a for s in "st" for a in "xyz"]]
    if extra:
        names += [s + c for s in "st" for c in SYM]
    if kind == "ellipse":
        names += ["sl2", "tl2"]
    left = corr.select(*pair, *[F.col(n).alias("a_" + n) for n in names])
    right = corr.select(*pair, *[F.col(n).alias("b_" + n) for n in names])
    src = norm(sub(_side("b_", "s"), _side("a_", "s")))
    tgt = norm(sub(_side("b_", "t"), _side("a_", "t")))
    apart = (src >= MIN_LENGTH) & (tgt >= MIN_LENGTH)
    cov_s = add(_side("a_", "s", SYM), _side("b_", "s", SYM))
    cov_t = add(_side("a_", "t", SYM), _side("b_", "t", SYM))
    bounds = [F.lit(float(b)) for b in levels]
    diff = F.abs(src - tgt)
    if kind in ("point", "gaussian"):
        tests = [diff < 2.0 * b for b in bounds]
    elif kind == "point_ratio":
        tests = [(F.abs(F.try_divide(src, tgt) - 1.0) < 2.0 * b) & (F.abs(F.try_divide(tgt, src) - 1.0) < 2.0 * b) for b in bounds]
    elif kind == "ellipse":
        rho_s = spectral_bound(cov_s, F.col("a_sl2") + F.col("b_sl2"))
        rho_t = spectral_bound(cov_t, F.col("a_tl2") + F.col("b_tl2"))
        tests = [diff < F.sqrt(rho_s * b) + F.sqrt(rho_t * b) for b in bounds]
    else:
        raise ValueError(f"unknown vertex type: {kind}")
    # the loosest level decides which pairs leave the join
    where = (F.col("a_corr_id") < F.col("b_corr_id")) & apart & tests[-1]
    found = tiled_pairs(left, right, pair, ["a_corr_id"], ["b_corr_id"], where, tile_rows)
    if kind == "gaussian":
        found = with_shape_gap(found, cov_s, cov_t).filter(F.col("gap") < 5.0)
    return found.select(
        *pair, F.col("a_corr_id").alias("u"), F.col("b_corr_id").alias("v"), _level(tests).alias("min_level"),
        src.alias("src_len"), tgt.alias("tgt_len"),
    )


def expand_levels(edges: DataFrame, levels: int) -> DataFrame:
    """One row per level an edge belongs to."""
    return edges.withColumn("level", F.explode(F.sequence("min_level", F.lit(levels - 1)))).drop("min_level")


def weighted_pairs(corr: DataFrame, pair: list[str], cut: float = 0.9, scale: float = 0.6,
                   tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Edges with first-order weight 1 - d^2 / scale^2, where it is at least ``cut``."""
    names = ["corr_id", *[s + a for s in "st" for a in "xyz"]]
    left = corr.select(*pair, *[F.col(n).alias("a_" + n) for n in names])
    right = corr.select(*pair, *[F.col(n).alias("b_" + n) for n in names])
    d = norm(sub(_side("b_", "s"), _side("a_", "s"))) - norm(sub(_side("b_", "t"), _side("a_", "t")))
    w = 1.0 - (d * d) / F.lit(scale * scale)
    where = (F.col("a_corr_id") < F.col("b_corr_id")) & (w >= cut)
    return tiled_pairs(left, right, pair, ["a_corr_id"], ["b_corr_id"], where, tile_rows).select(
        *pair, F.col("a_corr_id").alias("u"), F.col("b_corr_id").alias("v"), w.alias("w")
    )


def degrees(edges: DataFrame, pair: list[str]) -> DataFrame:
    ends = edges.select(*pair, F.explode(F.array("u", "v")).alias("id"))
    return ends.groupBy(*pair, "id").agg(F.count(F.lit(1)).alias("degree"))


def oriented(edges: DataFrame, pair: list[str]) -> DataFrame:
    """Point every edge from the lower (degree, id) to the higher end.

    No vertex then has more than sqrt(2m) outgoing edges, which bounds wedge joins
    even when one vertex touches a large part of all edges.
    """
    deg = degrees(edges, pair)
    e = edges.join(deg.select(*pair, F.col("id").alias("u"), F.col("degree").alias("_du")), [*pair, "u"])
    e = e.join(deg.select(*pair, F.col("id").alias("v"), F.col("degree").alias("_dv")), [*pair, "v"])
    swap = F.struct("_du", "u") > F.struct("_dv", "v")
    low = F.when(swap, F.struct(F.col("_dv").alias("d"), F.col("v").alias("i"))).otherwise(
        F.struct(F.col("_du").alias("d"), F.col("u").alias("i")))
    high = F.when(swap, F.struct(F.col("_du").alias("d"), F.col("u").alias("i"))).otherwise(
        F.struct(F.col("_dv").alias("d"), F.col("v").alias("i")))
    return e.select(*pair, low.alias("lo"), high.alias("hi"), *[c for c in ("w",) if c in edges.columns])


def triangles(edges: DataFrame, pair: list[str]) -> DataFrame:
    """Each triangle once as ``a, b, c`` in orientation order, with its weights if any."""
    weighted = "w" in edges.columns
    o = oriented(edges, pair)
    w = [F.col("w")] if weighted else []
    first = o.select(*pair, F.col("lo").alias("_a"), F.col("hi").alias("_b"), *[c.alias("w_ab") for c in w])
    second = o.select(*pair, F.col("lo").alias("_a"), F.col("hi").alias("_c"), *[c.alias("w_ac") for c in w])
    third = o.select(*pair, F.col("lo").alias("_b"), F.col("hi").alias("_c"), *[c.alias("w_bc") for c in w])
    wedges = first.join(second, [*pair, "_a"]).filter(F.col("_b") < F.col("_c"))
    names = ["w_ab", "w_ac", "w_bc"] if weighted else []
    return wedges.join(third, [*pair, "_b", "_c"]).select(
        *pair, *[F.col(f"_{n}.i").alias(n) for n in "abc"], *names
    )


def second_order(edges: DataFrame, pair: list[str]) -> DataFrame:
    """Edge weight times the summed weight of two-step paths between its ends.

    Those paths are the triangles over the edge, so each triangle adds one product to
    each of its three edges.
    """
    t = triangles(edges, pair)

    def part(p, q, x, y):
        return F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), (F.col(x) * F.col(y)).alias("s"))

    sums = (
        t.select(*pair, F.explode(F.array(part("a", "b", "w_ac", "w_bc"), part("a", "c", "w_ab", "w_bc"),
                                          part("b", "c", "w_ab", "w_ac"))).alias("_p"))
        .select(*pair, "_p.*").groupBy(*pair, "u", "v").agg(F.sum("s").alias("s"))
    )
    return edges.join(sums, [*pair, "u", "v"]).select(*pair, "u", "v", (F.col("w") * F.col("s")).alias("w"))


def clustering(corr: DataFrame, edges: DataFrame, pair: list[str]) -> DataFrame:
    """Weighted clustering factor of every correspondence."""
    t = triangles(edges, pair)
    cube = F.pow(F.col("w_ab") * F.col("w_ac") * F.col("w_bc"), F.lit(1.0 / 3.0))
    per = (
        t.select(*pair, F.explode(F.array("a", "b", "c")).alias("corr_id"), cube.alias("c"))
        .groupBy(*pair, "corr_id").agg(F.sum("c").alias("tri"))
    )
    deg = degrees(edges, pair).withColumnRenamed("id", "corr_id")
    out = corr.select(*pair, "corr_id").join(deg, [*pair, "corr_id"], "left").join(per, [*pair, "corr_id"], "left")
    out = out.na.fill(0, ["degree"]).na.fill(0.0, ["tri"])
    wedges = F.when(F.col("degree") > 1, F.col("degree") * (F.col("degree") - 1) * 0.5)
    return out.withColumns({"wedges": F.coalesce(wedges, F.lit(0.0)),
                            "factor": F.coalesce(F.col("tri") / wedges, F.lit(0.0))})


def clustering_summary(factors: DataFrame, pair: list[str]) -> DataFrame:
    """Mean factor and ratio of sums per pair."""
    used = F.col("degree") > 1
    total = F.sum(F.when(used, F.col("wedges")))
    return factors.groupBy(*pair).agg(
        F.avg("factor").alias("mean_factor"),
        F.try_divide(F.sum(F.when(used, F.col("tri"))), total).alias("total_factor"),
        F.max("degree").alias("max_degree"),
    )


def chain(members: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of consecutive clique members, the last one closing on the first."""
    w = Window.partitionBy(*keys).orderBy("corr_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for side in "st":
        for a in "xyz":
            c = side + a
            out["d" + c] = F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) - F.col(c)
    return members.withColumns(out)
