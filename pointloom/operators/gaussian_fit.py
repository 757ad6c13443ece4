"""Robust pose refinement on features with covariances.

One round sums the weighted normal equations of every row per group and solves a 6x6
system per group; only the row terms and the small solves run in numpy, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import SYM
from ..session import cut_lineage
from .pairs import beside

DOUBLES = T.ArrayType(T.DoubleType())
KINDS = ("point", "plane", "line", "point_gaussian", "gaussian")
UPPER = np.triu_indices(6)
# 99 % quantile of chi-square with three degrees of freedom
BOUND2 = 11.345


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - np.swapaxes(out, 1, 2)


def _sym(parts: np.ndarray) -> np.ndarray:
    xx, xy, xz, yy, yz, zz = parts.T
    return np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)


def information(kind: str, rot: np.ndarray, src_cov: np.ndarray, tgt_cov: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Weight matrix of the point difference for each residual kind."""
    eye = np.broadcast_to(np.eye(3), rot.shape)
    if kind == "point":
        return eye
    if kind in ("plane", "line"):
        along = axis[:, :, None] * axis[:, None, :]
        return along if kind == "plane" else eye - along
    spread = tgt_cov + (rot @ src_cov @ np.swapaxes(rot, 1, 2) if kind == "gaussian" else 0.0)
    return np.linalg.inv(spread + 1e-9 * np.eye(3))


def normal_terms(kind: str, tf, src, tgt, src_cov, tgt_cov, axis) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared residual, J'WJ and J'We of every row for a left rotation and a shift."""
    rot, trans = tf[:, :3, :3], tf[:, :3, 3]
    moved = np.einsum("nij,nj->ni", rot, src)
    e = tgt - moved - trans
    w = information(kind, rot, src_cov, tgt_cov, axis)
    j = np.concatenate([skew(moved), -np.broadcast_to(np.eye(3), rot.shape)], axis=2)
    jw = np.swapaxes(j, 1, 2) @ w
    return np.einsum("ni,nij,nj->n", e, w, e), jw @ j, np.einsum("nij,nj->ni", jw, e)


def rotation_exp(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    angle = np.linalg.norm(w, axis=1)
    k = skew(w / np.maximum(angle, 1e-300)[:, None])
    s, c = np.sin(angle)[:, None, None], np.cos(angle)[:, None, None]
    return np.eye(3) + s * k + (1 - c) * (k @ k)


def _terms_udf(kind: str):
    @F.pandas_udf(DOUBLES)
    def terms(tf: pd.Series, points: pd.Series, covs: pd.Series, axis: pd.Series) -> pd.Series:
        t = np.stack(tf.to_numpy()).reshape(-1, 4, 4)
        p, c, a = (np.stack(s.to_numpy()) for s in (points, covs, axis))
        r2, h, g = normal_terms(kind, t, p[:, :3], p[:, 3:], _sym(c[:, :6]), _sym(c[:, 6:]), a)
        return pd.Series(list(np.concatenate([r2[:, None], h[:, UPPER[0], UPPER[1]], g], axis=1)))

    return terms


@F.pandas_udf(DOUBLES)
def stepped(tf: pd.Series, sums: pd.Series) -> pd.Series:
    """Poses after one damped Gauss-Newton step from summed normal equations."""
    t = np.stack(tf.to_numpy()).reshape(-1, 4, 4).copy()
    s = np.stack(sums.to_numpy())
    h = np.zeros((len(s), 6, 6))
    h[:, UPPER[0], UPPER[1]] = s[:, :21]
    h = h + np.swapaxes(np.triu(h, 1), 1, 2)
    trace = np.trace(h, axis1=1, axis2=2)[:, None, None]
    step = np.linalg.solve(h + (1e-9 * trace + 1e-12) * np.eye(6), -s[:, 21:, None])[:, :, 0]
    turn = rotation_exp(step[:, :3])
    t[:, :3, :3] = turn @ t[:, :3, :3]
    t[:, :3, 3] += step[:, 3:]
    return pd.Series(list(t.reshape(-1, 16)))


def refine_pose(rows: DataFrame, start: DataFrame, keys: list[str], kind: str = "gaussian", factor: float = 1.4,
                rounds: int = 100, per_stage: int = 5, bound2: float = BOUND2, tolerance: float = 1e-6) -> DataFrame:
    """Graduated truncated-least-squares refinement from the poses ``start`` (``tf``).

    ``rows`` have ``sx .. tz``; ``gaussian`` reads the covariances of both ends,
    ``point_gaussian`` the target's, ``plane`` and ``line`` the axis ``ax ay az``.  A group is
    done once its weighted cost changes by no more than ``tolerance`` (relative above 1);
    ``converged`` tells which were within ``rounds``.  Done groups take no part in later stages,
    and rows are not shuffled while the state is small enough to be broadcast.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown residual kind: {kind}")
    zero = [F.lit(0.0)] * 6
    names = set(rows.columns)
    cov = [[F.col(s + c) for c in SYM] if s + "xx" in names else zero for s in "st"]
    axis = [F.col("a" + a) for a in "xyz"] if "ax" in names else zero[:3]
    data = cut_lineage(rows.select(
        *keys, F.array(*[F.col(s + a) for s in "st" for a in "xyz"]).alias("_p"), F.array(*cov[0], *cov[1]).alias("_c"), F.array(*axis).alias("_x")
    ))
    terms = _terms_udf(kind)
    first = data.join(start.select(*keys, "tf"), keys).withColumn("_t", terms("tf", "_p", "_c", "_x"))
    worst = first.groupBy(*keys).agg(F.max(F.col("_t")[0]).alias("_m"), F.first("tf").alias("tf"))
    # no outlier at the start means plain least squares: a graduation that keeps all rows
    mu = F.when(2.0 * F.col("_m") > bound2, F.try_divide(F.lit(bound2), 2.0 * F.col("_m") - bound2)).otherwise(1e-9)
    state = worst.select(*keys, "tf", mu.alias("mu"), F.lit(None).cast("double").alias("cost"), F.lit(False).alias("done"))
    state, settled = cut_lineage(state), None
    groups = state.count()
    for begin in range(0, rounds, per_stage):
        live = state.filter(~F.col("done"))
        if live.isEmpty():
            break
        finished = state.filter("done")
        settled = finished if settled is None else settled.unionByName(finished)
        for _ in range(min(per_stage, rounds - begin)):
            live = _round(data, beside(live, groups), keys, terms, factor, bound2, tolerance)
        state = cut_lineage(live)
    state = state if settled is None else state.unionByName(settled)
    return state.select(*keys, "tf", F.col("done").alias("converged"))


def _round(data: DataFrame, state: DataFrame, keys: list[str], terms, factor: float, bound2: float, tolerance: float) -> DataFrame:
    """One step; groups that settle within a stage keep their pose."""
    live = data.join(state, keys).withColumn("_t", terms("tf", "_p", "_c", "_x"))
    r2, m = F.col("_t")[0], F.col("mu")
    w = (F.when(r2 >= (m + 1.0) / m * bound2, 0.0).when(r2 <= m / (m + 1.0) * bound2, 1.0)
         .otherwise(F.sqrt(bound2 * m * (m + 1.0) / r2) - m))
    live = live.withColumn("_w", w)
    sums = live.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("tf", "mu", "cost", "done")], F.sum(F.col("_w") * r2).alias("_cost"),
        F.array(*[F.sum(F.col("_w") * F.col("_t")[i]) for i in range(1, 28)]).alias("_s"))
    same = F.coalesce(F.abs(F.col("_cost") - F.col("cost")) <= tolerance * F.greatest(F.lit(1.0), F.col("cost")), F.lit(False))
    stop = F.col("done") | same
    moved = sums.select(*keys, "tf", stepped("tf", "_s").alias("_new"), "mu", "cost", "_cost", stop.alias("_stop"))
    return moved.select(
        *keys, F.when(F.col("_stop"), F.col("tf")).otherwise(F.col("_new")).alias("tf"), F.least(F.col("mu") * factor, F.lit(1e9)).alias("mu"),
        F.when(F.col("_stop"), F.col("cost")).otherwise(F.col("_cost")).alias("cost"), F.col("_stop").alias("done"),
    )
