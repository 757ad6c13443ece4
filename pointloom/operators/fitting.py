"""Transform estimation from moment sums.

Every fit reduces its rows to sixteen weighted sums per group; only a 3x3 singular
value decomposition of each group's sums runs in numpy, batched over groups.  Robust
fits repeat that with weights recomputed from the group's current state, so the rows
themselves are read in place and never rewritten.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import add, dot, mat_vec, norm, rigid_apply, rigid_array, sub
from ..session import cut_lineage
from .pairs import beside, tiled_pairs

MOMENTS = ["w", *["s" + a for a in "xyz"], *["t" + a for a in "xyz"], *[f"h{i}{j}" for i in range(3) for j in range(3)]]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def closest_rotations(m: np.ndarray) -> np.ndarray:
    """Closest rotation V diag(1, 1, +-1) U' of each 3x3 cross covariance."""
    u, _, vt = np.linalg.svd(m)
    v = np.swapaxes(vt, 1, 2)
    flip = np.where(np.linalg.det(v) * np.linalg.det(u) < 0, -1.0, 1.0)
    v[:, :, 2] *= flip[:, None]
    return v @ np.swapaxes(u, 1, 2)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_of(h: pd.Series) -> pd.Series:
    """Closest rotation of each row-major 3x3 cross covariance."""
    return pd.Series(list(closest_rotations(np.stack(h.to_numpy()).reshape(-1, 3, 3)).reshape(-1, 9)))


def source() -> tuple[Column, ...]:
    return tuple(F.col("s" + a) for a in "xyz")


def target() -> tuple[Column, ...]:
    return tuple(F.col("t" + a) for a in "xyz")


def moment_aggs(weight: Column | None = None) -> list[Column]:
    """Aggregates named after :data:`MOMENTS` of ``sx .. tz`` rows."""
    w = F.lit(1.0) if weight is None else weight
    s, t = source(), target()
    terms = [F.lit(1.0), *s, *t, *[s[i] * t[j] for i in range(3) for j in range(3)]]
    return [F.sum(w * v).alias("m_" + n) for n, v in zip(MOMENTS, terms)]


def _cross_covariance(centred: bool) -> Column:
    w = F.col("m_w")
    cells = []
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            h = F.col(f"m_h{i}{j}")
            cells.append(h - F.col("m_s" + a) * F.col("m_t" + b) / w if centred else h)
    return F.array(*cells)


def with_pose(moments: DataFrame, model: str = "rigid", name: str = "tf") -> DataFrame:
    """Add the best transform of each group of moment sums as a row-major 4x4 array.

    ``rigid`` fits rotation and translation, ``rotation`` only a rotation, ``yaw`` only a
    rotation about z in closed form.
    """
    ok = F.col("m_w") > 0
    zero = (F.lit(0.0),) * 3
    if model == "yaw":
        c = F.col("m_h00") + F.col("m_h11")
        s = F.col("m_h01") - F.col("m_h10")
        angle = F.atan2(s, c)
        rot = (F.cos(angle), -F.sin(angle), F.lit(0.0), F.sin(angle), F.cos(angle), F.lit(0.0), *zero[:2], F.lit(1.0))
        tf = rigid_array(rot, zero)
    else:
        centred = model == "rigid"
        safe = F.when(ok, _cross_covariance(centred)).otherwise(F.array(*[F.lit(0.0)] * 9))
        moments = moments.withColumn("_r", rotation_of(safe))
        rot = tuple(F.col("_r")[k] for k in range(9))
        trans = zero
        if centred:
            mean_s = tuple(F.col("m_s" + a) / F.col("m_w") for a in "xyz")
            mean_t = tuple(F.col("m_t" + a) / F.col("m_w") for a in "xyz")
            trans = sub(mean_t, mat_vec(rot, mean_s))
        tf = rigid_array(rot, trans)
    return moments.withColumn(name, F.when(ok, tf).otherwise(F.array(*[F.lit(v) for v in IDENTITY]))).drop("_r")


def fit_pose(rows: DataFrame, keys: list[str], model: str = "rigid", weight: Column | None = None) -> DataFrame:
    """Least-squares transform per group of rows ``sx sy sz tx ty tz``."""
    moments = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *moment_aggs(weight))
    return with_pose(moments, model).select(*keys, "n", "tf")


def _centroid_sums(rows: DataFrame, keys: list[str], weight: Column, used: Column, *more: Column) -> DataFrame:
    s, t = source(), target()
    names = ("sx", "sy", "sz", "tx", "ty", "tz")
    return rows.groupBy(*keys).agg(
        F.sum(used.cast("double")).alias("n"), F.sum(weight).alias("w"),
        *[F.sum(F.when(used, c).otherwise(0.0)).alias("a" + n) for c, n in zip((*s, *t), names)],
        *[F.sum(weight * c).alias("w" + n) for c, n in zip((*s, *t), names)],
        *[F.sum(weight * s[i] * t[j]).alias(f"h{i}{j}") for i in range(3) for j in range(3)], *more,
    )


def _centroid_pose(sums: DataFrame, name: str) -> DataFrame:
    n = F.greatest("n", F.lit(1.0))
    ms = [F.col("as" + a) / n for a in "xyz"]
    mt = [F.col("at" + a) / n for a in "xyz"]
    h = F.array(*[
        F.col(f"h{i}{j}") - ms[i] * F.col("wt" + b) - F.col("ws" + a) * mt[j] + F.col("w") * ms[i] * mt[j]
        for i, a in enumerate("xyz") for j, b in enumerate("xyz")
    ])
    out = sums.withColumn("_r", rotation_of(h))
    rot = tuple(F.col("_r")[k] for k in range(9))
    return out.withColumn(name, rigid_array(rot, sub(tuple(mt), mat_vec(rot, tuple(ms))))).drop("_r")


def fit_pose_plain_centroids(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Weighted rotation about unweighted centroids, then the matching translation."""
    return _centroid_pose(_centroid_sums(rows, keys, weight, F.lit(True)), "tf").select(*keys, "tf")


def residual2(tf: str) -> Column:
    """Squared distance of the moved source point from its target."""
    d = sub(target(), rigid_apply(tf, source()))
    return dot(d, d)


def gnc_weight(r2: Column, mu: Column, bound2: float) -> Column:
    """Closed-form truncated-least-squares weight at graduation ``mu``."""
    hi = (mu + 1.0) / mu * bound2
    lo = mu / (mu + 1.0) * bound2
    return F.when(r2 >= hi, 0.0).when(r2 <= lo, 1.0).otherwise(F.sqrt(bound2 * mu * (mu + 1.0) / r2) - mu)


def gnc_fit(rows: DataFrame, keys: list[str], bound: float, model: str = "rotation", factor: float = 1.4,
            max_rounds: int = 100, tolerance: float = 1e-6, inlier_weight: float = 0.5,
            per_stage: int = 4) -> tuple[DataFrame, DataFrame]:
    """Graduated non-convexity fit with truncated least squares.

    Returns (one pose per group and whether its cost settled, rows with their final weight and
    inlier flag).  Rows are never shuffled while the state is small enough to be broadcast.  The
    loop state is one row per group: current pose and graduation, the previous ones
    (the weights of a round are a function of them), the last cost and a done flag.
    Rounds are chained ``per_stage`` at a time and the state is written out in between.
    """
    bound2 = bound * bound if bound * bound >= 1e-16 else 1e-2
    rows = cut_lineage(rows)
    start = rows.groupBy(*keys).agg(*moment_aggs())
    start = with_pose(start, model).select(*keys, "tf")
    worst = rows.join(start, keys).groupBy(*keys).agg(F.max(residual2("tf")).alias("_m"))
    mu0 = F.try_divide(F.lit(1.0), 2.0 * F.col("_m") / bound2 - 1.0)
    state = start.join(worst, keys).select(
        *keys, "tf", F.col("tf").alias("tf_w"), mu0.alias("mu"), F.lit(None).cast("double").alias("mu_w"),
        F.lit(None).cast("double").alias("cost"), (F.coalesce(mu0, F.lit(0.0)) <= 0).alias("done"),
    )
    state, settled = cut_lineage(state), None
    groups = state.count()
    for first in range(0, max_rounds, per_stage):
        live = state.filter(~F.col("done"))
        if live.isEmpty():
            break
        finished = state.filter("done")
        settled = finished if settled is None else settled.unionByName(finished)
        for _ in range(min(per_stage, max_rounds - first)):
            live = _gnc_round(rows, beside(live, groups), keys, bound2, model, factor, tolerance)
        state = cut_lineage(live)
    state = state if settled is None else state.unionByName(settled)
    weights = F.when(F.col("mu_w").isNull(), 1.0).otherwise(gnc_weight(residual2("tf_w"), F.col("mu_w"), bound2))
    final = rows.join(beside(state.select(*keys, "tf", "tf_w", "mu_w"), groups), keys).withColumn("weight", weights)
    final = final.withColumn("inlier", F.col("weight") >= inlier_weight).drop("tf", "tf_w", "mu_w")
    return state.select(*keys, "tf", F.col("done").alias("converged")), final


STATE = ("tf", "tf_w", "mu", "mu_w", "cost", "done")


def _gnc_round(rows, state, keys, bound2, model, factor, tolerance):
    """Cost at the current pose with the old weights, new weights, and the pose they give.

    Groups that settle within a stage pass through unchanged, so that each round reads
    its state once and the plan of a stage stays linear.
    """
    live = rows.join(state, keys).withColumns({"_r2": residual2("tf"), "_rw": residual2("tf_w")})
    old = F.when(F.col("mu_w").isNull(), 1.0).otherwise(gnc_weight(F.col("_rw"), F.col("mu_w"), bound2))
    live = live.withColumn("_new", gnc_weight(F.col("_r2"), F.col("mu"), bound2))
    sums = live.groupBy(*keys).agg(
        F.sum(old * F.col("_r2")).alias("_cost"), *moment_aggs(F.col("_new")), *[F.first(c).alias("p_" + c) for c in STATE]
    )
    new = with_pose(sums, model, "_tf")
    same = F.coalesce(F.abs(F.col("_cost") - F.col("p_cost")) < tolerance, F.lit(False))
    # a pose whose cost settled stays
    values = {
        "tf": F.when(same, F.col("p_tf")).otherwise(F.col("_tf")), "tf_w": F.col("p_tf"),
        "mu": F.col("p_mu") * factor, "mu_w": F.col("p_mu"), "cost": F.col("_cost"), "done": same,
    }
    return new.select(*keys, *[F.when(F.col("p_done"), F.col("p_" + c)).otherwise(values[c]).alias(c) for c in STATE])


def graduated_fit(rows: DataFrame, keys: list[str], bound: float, diameter: DataFrame, factor: float = 1.4,
                  max_rounds: int = 100, tolerance: float = 1e-6, per_stage: int = 4) -> DataFrame:
    """Rotation by graduated Geman-McClure line processes.

    ``diameter`` has, per group, the larger extent of both sides in ``extent``.  Returns the
    pose of every group and whether it ``converged``.
    """
    bound2 = bound * bound
    rows = cut_lineage(rows)
    scale = F.col("extent") / bound2
    state = diameter.select(
        *keys, F.array(*[F.lit(v) for v in IDENTITY]).alias("tf"), (scale * scale / bound2).alias("mu"), F.lit(False).alias("done")
    )
    state, settled = cut_lineage(state), None
    groups = state.count()
    for first in range(0, max_rounds, per_stage):
        live = state.filter(~F.col("done"))
        if live.isEmpty():
            break
        finished = state.filter("done")
        settled = finished if settled is None else settled.unionByName(finished)
        for _ in range(min(per_stage, max_rounds - first)):
            live = _graduated_round(rows, live, keys, bound2, factor, tolerance, groups)
        state = cut_lineage(live)
    state = state if settled is None else state.unionByName(settled)
    return state.select(*keys, "tf", F.col("done").alias("converged"))


def _graduated_round(rows, state, keys, bound2, factor, tolerance, groups):
    m = F.col("mu") * bound2
    ratio = m / (m + residual2("tf"))
    sums = rows.join(beside(state, groups), keys).groupBy(*keys).agg(
        *moment_aggs(ratio * ratio), *[F.first(c).alias("p_" + c) for c in ("tf", "mu", "done")]
    )
    new = with_pose(sums, "rotation").select(*keys, "tf", F.col("p_mu").alias("mu"), "p_tf", "p_done")
    r2 = residual2("tf")
    carried = [F.first(c).alias(c) for c in ("tf", "mu", "p_tf", "p_done")]
    new = rows.join(beside(new, groups), keys).groupBy(*keys).agg(F.sum(m * r2 / (m + r2)).alias("_cost"), *carried)
    stop = (F.col("_cost") < tolerance) | (F.col("mu") < 1.0)
    done = F.col("p_done")
    return new.select(
        *keys, F.when(done, F.col("p_tf")).otherwise(F.col("tf")).alias("tf"),
        F.when(done, F.col("mu")).otherwise(F.col("mu") / factor).alias("mu"), (done | stop).alias("done"),
    )


#: Directions whose extreme points give a first lower bound of a diameter.
_WAYS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]
#: Parts of a group's box per axis.
_GRID = 8


def set_diameter(points: DataFrame, keys: list[str]) -> DataFrame:
    """Exact largest distance between two points ``x y z`` of each group: ``diameter``.

    The extreme points in some directions give a lower bound.  Points whose farthest box
    corner is nearer than that are out; the rest meet cell against cell, in tiles, and only
    where the far corners of both cells are at least the bound apart.
    """
    rows = cut_lineage(points.select(*keys, *[F.col(a).cast("double").alias(a) for a in "xyz"]).distinct())
    here = F.struct("x", "y", "z")
    along = [sum((F.col(a) * w for a, w in zip("xyz", way)), F.lit(0.0)) for way in _WAYS]
    ends = F.array(*[f(here, d) for d in along for f in (F.max_by, F.min_by)])
    box = rows.groupBy(*keys).agg(ends.alias("_e"), *[f(a).alias(e + a) for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))])

    def gap2(p, q):
        return sum(((p[a] - q[a]) * (p[a] - q[a]) for a in "xyz"), F.lit(0.0))

    low = F.array_max(F.transform("_e", lambda p: F.array_max(F.transform("_e", lambda q: gap2(p, q)))))
    box = cut_lineage(box.withColumn("_low", low).drop("_e"))
    far = [F.greatest(F.col(a) - F.col("lo" + a), F.col("hi" + a) - F.col(a)) for a in "xyz"]
    left = rows.join(box, keys).filter(far[0] * far[0] + far[1] * far[1] + far[2] * far[2] >= F.col("_low"))
    part = [F.least(F.floor(F.coalesce(F.try_divide(F.col(a) - F.col("lo" + a), F.col("hi" + a) - F.col("lo" + a)), F.lit(0.0)) * _GRID), F.lit(_GRID - 1)) for a in "xyz"]
    left = cut_lineage(left.select(*keys, "x", "y", "z", ((part[0] * _GRID + part[1]) * _GRID + part[2]).alias("cell")))
    cells = cut_lineage(left.groupBy(*keys, "cell").agg(*[f(a).alias(e + a) for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]))
    u, v = (cells.select(*keys, F.col("cell").alias(s), *[F.col(e + a).alias(f"{s}{e}{a}") for e in ("lo", "hi") for a in "xyz"]) for s in "uv")
    span = [F.greatest(F.col(f"uhi{a}") - F.col(f"vlo{a}"), F.col(f"vhi{a}") - F.col(f"ulo{a}")) for a in "xyz"]
    pairs = u.join(v, keys).filter(F.col("u") <= F.col("v")).join(box.select(*keys, "_low"), keys)  # at most 512 cells a group
    pairs = cut_lineage(pairs.filter(span[0] * span[0] + span[1] * span[1] + span[2] * span[2] >= F.col("_low")).select(*keys, "u", "v"))
    p = left.withColumnRenamed("cell", "u").join(pairs, [*keys, "u"]).withColumnsRenamed({a: "p" + a for a in "xyz"})
    q = left.withColumnRenamed("cell", "v").join(pairs, [*keys, "v"]).withColumnsRenamed({a: "q" + a for a in "xyz"})
    d2 = sum(((F.col("q" + a) - F.col("p" + a)) * (F.col("q" + a) - F.col("p" + a)) for a in "xyz"), F.lit(0.0))
    met = tiled_pairs(p, q, [*keys, "u", "v"], ["px", "py", "pz"], ["qx", "qy", "qz"])
    best = met.groupBy(*keys).agg(F.max(d2).alias("_d2"))
    return box.select(*keys, "_low").join(best, keys, "left").select(*keys, F.sqrt(F.greatest("_low", F.coalesce("_d2", "_low"))).alias("diameter"))


def larger_diameter(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Larger diameter of the source and the target points of each group: ``extent``."""
    sides = [set_diameter(rows.select(*keys, *[F.col(s + a).alias(a) for a in "xyz"]), keys) for s in "st"]
    return sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.max("diameter").alias("extent"))


def with_distance(rows: DataFrame, tf: str = "tf") -> DataFrame:
    return rows.withColumn("dist", F.sqrt(residual2(tf)))


#: Pairs with at most so many correspondences are drawn from as one row.
_PACKED = 512
#: Draws of one row.
_DRAWS = 2048
_POINT = ["src_id", "tgt_id", "sx", "sy", "sz", "tx", "ty", "tz"]


def _pick(k: int, seed: int, pair: list[str], draw: Column) -> Column:
    """Row number ``k`` of a draw."""
    return F.pmod(F.xxhash64(draw, F.lit(k), F.lit(seed), *pair), F.col("_n"))


def _drawn(corr: DataFrame, live: DataFrame, pair: list[str], size: int, threshold: float, scale: float, min_inliers: int, seed: int) -> DataFrame:
    """Best model of each pair among ``size`` more draws: inliers, draw, tf.

    Draws, their points and their fits meet by joins, so a pair may be of any size.
    """
    draws = live.withColumn("draw", F.explode(F.sequence(F.col("drawn"), F.col("drawn") + (size - 1))))
    picks = draws.select(
        *pair, "draw", F.posexplode(F.array(*[
            _pick(k, seed, pair, F.col("draw")) for k in range(3)
        ])).alias("_k", "corr_id"),
    )
    point = F.struct(*_POINT)
    got = picks.join(corr, [*pair, "corr_id"]).groupBy(*pair, "draw").agg(
        *[F.max(F.when(F.col("_k") == k, point)).alias(f"p{k}") for k in range(3)]
    )

    def length(i: int, j: int, side: str) -> Column:
        return norm(tuple(F.col(f"p{i}.{side}{a}") - F.col(f"p{j}.{side}{a}") for a in "xyz"))

    ok = F.lit(True)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        s, t = length(i, j, "s"), length(i, j, "t")
        ok = ok & (F.col(f"p{i}.src_id") != F.col(f"p{j}.src_id")) & (F.col(f"p{i}.tgt_id") != F.col(f"p{j}.tgt_id"))
        ok = ok & (s >= t * scale) & (t >= s * scale)
    triples = got.filter(ok).select(*pair, "draw", F.explode(F.array("p0", "p1", "p2")).alias("_p")).select(*pair, "draw", "_p.*")
    poses = fit_pose(triples, [*pair, "draw"]).drop("n")
    scored = tiled_pairs(poses, corr, pair, ["draw"], ["corr_id"]).groupBy(*pair, "draw").agg(
        F.count_if(F.sqrt(residual2("tf")) < threshold).alias("inliers"), F.first("tf").alias("tf")
    )
    good = scored.filter(F.col("inliers") >= min_inliers)
    order = F.struct((-F.col("inliers")).alias("neg"), "draw")
    return good.groupBy(*pair).agg(F.min_by(F.struct("inliers", "draw", "tf"), order).alias("_b"))


def _best_draw(rows: pa.StructArray, picks: np.ndarray, threshold: float, scale: float, min_inliers: int):
    """First draw with most inliers: inliers, place among the draws, tf; None if all have too few.

    ``rows`` are one pair's correspondences in order of ``corr_id``; ``picks`` three of those ids per draw.
    """
    number = pc.fill_null(rows.field("corr_id"), -1).to_numpy(zero_copy_only=False)
    ends = [pc.fill_null(rows.field(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in ("src_id", "tgt_id")]
    s, t = (np.stack([rows.field(side + a).to_numpy(zero_copy_only=False) for a in "xyz"]) for side in "st")
    n = len(number)
    if number[0] == 0 and number[-1] == n - 1 and (np.diff(number) == 1).all():
        at, places = picks, np.arange(picks.shape[1])
    else:
        at = np.searchsorted(number, picks, "right") - 1
        places = np.flatnonzero(((at >= 0) & (number[at] == picks)).all(axis=0))

    def fit_together(i, j):
        """Whether rows differ in both ends and have about the same distance on both sides."""
        u, v = (np.sqrt(sum((x - y) * (x - y) for x, y in zip(p[:, i], p[:, j]))) for p in (s, t))
        ok = (u >= v * scale) & (v >= u * scale)
        for e in ends:
            ok &= (e[i] != e[j]) & (e[i] >= 0) & (e[j] >= 0)
        return ok

    # few rows: every two of them once, and the draws look it up
    known = fit_together(*np.divmod(np.arange(n * n), n)) if n * n <= 4 * picks.shape[1] else None
    for i, j in ((0, 1), (0, 2), (1, 2)):
        p, q = at[i][places], at[j][places]
        places = places[fit_together(p, q) if known is None else known[p * n + q]]
    if not len(places):
        return None
    ps, pt = s[:, at[:, places]], t[:, at[:, places]]  # axis, point, draw
    ms, mt = ps.sum(axis=1), pt.sum(axis=1)
    h = np.stack([(ps[i] * pt[j]).sum(axis=0) - ms[i] * mt[j] / 3.0 for i in range(3) for j in range(3)], axis=1)
    rot = closest_rotations(h.reshape(-1, 3, 3)).reshape(-1, 9).T
    ms, mt = ms / 3.0, mt / 3.0
    move = [mt[i] - (rot[3 * i] * ms[0] + rot[3 * i + 1] * ms[1] + rot[3 * i + 2] * ms[2]) for i in range(3)]
    hits = np.zeros(len(places), np.int64)
    step = max(1, (1 << 17) // s.shape[1])
    for a in range(0, len(places), step):
        r, m = rot[:, a : a + step, None], [x[a : a + step, None] for x in move]
        d = [t[i] - (r[3 * i] * s[0] + r[3 * i + 1] * s[1] + r[3 * i + 2] * s[2] + m[i]) for i in range(3)]
        hits[a : a + step] = (np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < threshold).sum(axis=1)
    b = int(hits.argmax())
    if hits[b] < min_inliers:
        return None
    tf = [float(c) for i in range(3) for c in (*rot[3 * i : 3 * i + 3, b], move[i][b])]
    return int(hits[b]), int(places[b]), [*tf, 0.0, 0.0, 0.0, 1.0]


def _drawn_packed(packs: DataFrame, live: DataFrame, pair: list[str], size: int, threshold: float, scale: float, min_inliers: int, seed: int) -> DataFrame:
    """As :func:`_drawn` for pairs whose correspondences travel as one row ``_rows``.

    Draws are dealt out in bounded stretches: each meets the pair's row once and leaves its best model.
    """
    step = min(size, _DRAWS)
    parts = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("drawn") + F.col("_part") * step
    dealt = live.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((size - 1) // step)))).withColumn("_first", first)
    dealt = dealt.withColumn("_last", F.least(F.col("_first") + step, F.col("drawn") + size) - 1)
    met = dealt.join(packs, pair).repartition(parts, *pair, "_part")
    draws = F.sequence("_first", "_last")

    def picked(k):
        return lambda d: _pick(k, seed, pair, d).cast("int")

    met = met.select(*pair, "_first", "_rows", *[F.transform(draws, picked(k)).alias(f"_p{k}") for k in range(3)])

    def best(batches):
        for batch in batches:
            kept, found = [], []
            for r in range(batch.num_rows):
                picks = np.stack([batch.column(f"_p{k}")[r].values.to_numpy() for k in range(3)])
                b = _best_draw(batch.column("_rows")[r].values, picks, threshold, scale, min_inliers)
                if b is not None:
                    kept.append(r)
                    found.append((b[0], batch.column("_first")[r].as_py() + b[1], b[2]))
            taken = batch.take(pa.array(kept, pa.int64()))
            new = [pa.array([f[i] for f in found], ty) for i, ty in enumerate((pa.int64(), pa.int32(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*[taken.column(k) for k in pair], *new], [*pair, "inliers", "draw", "tf"])

    names = ", ".join(f"{k} {live.schema[k].dataType.simpleString()}" for k in pair)
    scored = met.mapInArrow(best, f"{names}, inliers bigint, draw int, tf array<double>")
    order = F.struct((-F.col("inliers")).alias("neg"), "draw")
    return scored.groupBy(*pair).agg(F.min_by(F.struct("inliers", "draw", "tf"), order).alias("_b"))


def ransac_fit(corr: DataFrame, pair: list[str], threshold: float = 0.5, scale: float = 0.95, confidence: float = 0.999,
               most: int = 100_000, block: int = 128, min_inliers: int = 3, seed: int = 7) -> DataFrame:
    """Best of seeded three-point fits per pair, by inlier count.

    A draw picks three row numbers by hash; draws that share a point or whose edge
    lengths differ too much are dropped before any fit.  Equal counts go to the first draw.
    The few correspondences of most pairs travel as one row to their draws; only pairs
    with more than ``_PACKED`` of them draw by joins.

    Draws come in blocks that double.  After each, a pair is done once so many draws would
    have hit three inliers with the wanted ``confidence``, given the share of inliers found
    so far, or once there are ``most``; ``converged`` tells the first from the second.
    Adds ``drawn``.
    """
    corr = cut_lineage(corr)
    state = corr.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"drawn": F.lit(0), "_b": F.lit(None).cast("struct<inliers:bigint,draw:int,tf:array<double>>"), "converged": F.lit(False)})
    state, size = cut_lineage(state), block
    small = F.col("_n") <= _PACKED
    large = not state.filter(~small).isEmpty()
    few = corr.join(state.filter(small).select(*pair), pair, "left_semi") if large else corr
    packs = cut_lineage(few.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct("corr_id", *_POINT))).alias("_rows")))
    while True:
        live = state.filter(~F.col("converged") & (F.col("drawn") < most))
        if live.isEmpty():
            break
        todo = live.select(*pair, "_n", "drawn")
        found = _drawn_packed(packs, todo.filter(small), pair, size, threshold, scale, min_inliers, seed)
        if large:
            found = found.unionByName(_drawn(corr, todo.filter(~small), pair, size, threshold, scale, min_inliers, seed))
        new = live.join(found.withColumnRenamed("_b", "_f"), pair, "left").withColumn("drawn", F.col("drawn") + size)
        better = F.col("_f").isNotNull() & (F.col("_b").isNull() | (F.col("_f.inliers") > F.col("_b.inliers")))
        new = new.withColumn("_b", F.when(better, F.col("_f")).otherwise(F.col("_b"))).drop("_f")
        share = F.coalesce(F.col("_b.inliers"), F.lit(0)) / F.col("_n")
        missed = F.log1p(-share * share * share)  # of one draw; log of 0 where all rows are inliers
        needed = F.when(share >= 1.0, F.lit(1.0)).when(share > 0, F.lit(math.log(1.0 - confidence)) / missed)
        new = new.withColumn("converged", F.coalesce(F.col("drawn") >= needed, F.lit(False)))
        state = cut_lineage(new.unionByName(state.filter(F.col("converged") | (F.col("drawn") >= most))))
        size *= 2
    identity = F.array(*[F.lit(v) for v in IDENTITY])
    return state.select(
        *pair, F.coalesce("_b.inliers", F.lit(0)).alias("inliers"), F.coalesce(F.col("_b.tf"), identity).alias("tf"), "drawn", "converged",
    )


def clique_hypotheses(corr: DataFrame, cliques: DataFrame, pair: list[str], reach: float = 0.6) -> DataFrame:
    """Pose of every clique, scored over all correspondences of the pair; best per pair.

    The score adds (reach - d) / reach over correspondences closer than ``reach``.
    """
    rows = cliques.select(*pair, "members", F.explode("members").alias("corr_id")).join(corr, [*pair, "corr_id"])
    poses = fit_pose(rows, [*pair, "members"]).filter("n >= 3").drop("n")
    scored = tiled_pairs(poses, corr, pair, ["members"], ["corr_id"])
    d = F.sqrt(residual2("tf"))
    scored = scored.groupBy(*pair, "members").agg(
        F.sum(F.when(d < reach, (reach - d) / reach).otherwise(0.0)).alias("score"), F.first("tf").alias("tf")
    )
    best = scored.groupBy(*pair).agg(F.min(F.struct((-F.round("score", 9)).alias("neg"), "members", "tf")).alias("_b"))
    return best.select(*pair, F.col("_b.members").alias("members"), (-F.col("_b.neg")).alias("score"), F.col("_b.tf").alias("tf"))


def refine(corr: DataFrame, poses: DataFrame, pair: list[str], reach: float = 0.6, rounds: int = 20,
           per_stage: int = 4) -> DataFrame:
    """Reweighted refits while the inlier score does not fall; ``converged`` where it did within ``rounds``."""
    corr = cut_lineage(corr)
    state = cut_lineage(poses.select(*pair, "tf", F.lit(0.0).alias("score"), F.lit(False).alias("done")))
    groups = state.count()
    for first in range(0, rounds, per_stage):
        if state.filter(~F.col("done")).isEmpty():
            break
        for _ in range(min(per_stage, rounds - first)):
            state = _refine_round(corr, beside(state, groups), pair, reach)
        state = cut_lineage(state)
    return state.select(*pair, "tf", "score", F.col("done").alias("converged"))


def _refine_round(corr, state, pair, reach):
    live = with_distance(corr.join(state, pair))
    near = F.col("dist") < reach
    ratio = F.col("dist") / reach
    sums = _centroid_sums(live, pair, F.when(near, 1.0 / (1.0 + ratio * ratio)).otherwise(0.0), near,
                          F.sum(F.when(near, (reach - F.col("dist")) / reach).otherwise(0.0)).alias("_s"),
                          *[F.first(c).alias("p_" + c) for c in ("tf", "score", "done")])
    new = _centroid_pose(sums, "_tf")
    worse = (F.col("_s") < F.col("p_score")) | (F.col("n") < 1)
    stop = F.col("p_done") | worse
    return new.select(
        *pair, F.when(stop, F.col("p_tf")).otherwise(F.col("_tf")).alias("tf"),
        F.greatest("_s", "p_score").alias("score"), stop.alias("done"),
    )


def translation_invariant(rows: DataFrame, keys: list[str], id_col: str = "corr_id") -> DataFrame:
    """Differences of all pairs i < j of a bounded set, such as the members of a clique."""
    names = ["sx", "sy", "sz", "tx", "ty", "tz"]
    a = rows.select(*keys, F.col(id_col).alias("i"), *[F.col(n).alias("a_" + n) for n in names])
    b = rows.select(*keys, F.col(id_col).alias("j"), *[F.col(n).alias("b_" + n) for n in names])
    return tiled_pairs(a, b, keys, ["i"], ["j"], F.col("i") < F.col("j")).select(
        *keys, "i", "j", *[(F.col("b_" + n) - F.col("a_" + n)).alias(n) for n in names]
    )
