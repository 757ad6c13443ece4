"""Queries for the remaining scalar functions and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..functions.linalg import SYM, cols, mahalanobis, rigid_array
from ..operators import boxes, components, fitting, gaussian_fit
from ..operators import compatibility as cg
from ..session import cut_lineage
from ..sources import clouds
from ..sources.datasets import DATASETS
from . import registration as reg
from . import tables
from .correspondences import PAIR
from .graph_queries import CORR_SQL, LEVELS, POINT_SQL, corr_table, edge_table, level_sql
from .registry import query
from .segment_queries import centred, centred_sql
from .voxel_queries import FEATURE_SQL, features, rounded, ring_features
from .tables import normal_sql


@query("pair_index", """SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS i, CAST(p_size + 1 + p_partkey % 40 AS BIGINT) AS j,
  CAST(p_size * (2 * 100 - p_size - 1) / 2 AS BIGINT) + (p_size + 1 + p_partkey % 40) - p_size - 1 AS idx, CAST(p_size AS BIGINT) AS i2, CAST(p_size + 1 + p_partkey % 40 AS BIGINT) AS j2 FROM part""")
def pair_index(spark, sf):
    p = tables.read(spark, sf, "part")
    n = F.lit(100).cast("long")
    df = p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("i"), (F.col("p_size") + 1 + F.col("p_partkey") % 40).cast("long").alias("j"))
    df = df.withColumn("idx", scalar.pair_to_index(F.col("i"), F.col("j"), n))
    i, j = scalar.index_to_pair(F.col("idx"), n)
    return df.withColumns({"i2": i, "j2": j})


@query("frame_paths", """SELECT l_suppkey AS seq, l_partkey AS frame, printf('%02d/pcd/%d.pcd', l_suppkey, l_partkey) AS hit,
  printf('data_3d_raw/2013_05_28_drive_%04d_sync/velodyne_points/data/%010d.bin', l_suppkey, l_partkey) AS kitti360, CAST(l_partkey AS VARCHAR) AS stem
FROM lineitem GROUP BY ALL""")
def frame_paths(spark, sf):
    li = tables.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seq"), F.col("l_partkey").alias("frame")).distinct()
    hit = DATASETS["hit_ms"].cloud_file(F.col("seq"), F.col("frame"))
    return li.select("seq", "frame", hit.alias("hit"), DATASETS["kitti360"].cloud_file(F.col("seq"), F.col("frame")).alias("kitti360"), scalar.file_stem(hit).alias("stem"))


@query("deskew", f"""WITH {centred_sql()},
s AS (SELECT *, CAST(0.5 AS DOUBLE) * atan2(y, x) / pi() AS s FROM cp),
q AS (SELECT *, abs(s * CAST(0.5 AS DOUBLE)) AS a, sign(s) AS g FROM s)
SELECT cloud, pid, round(x, 4) AS x0, round(y, 4) AS y0, round(z, 4) AS z0,
  round(x * cos(a) - g * y * sin(a) + s * 2.0, 3) AS x, round(y * cos(a) + g * x * sin(a) - s * 1.0, 3) AS y, round(z + s * CAST(0.25 AS DOUBLE), 3) AS z FROM q""")
def deskew(spark, sf):
    p = centred(spark, sf)
    p = p.select("cloud", "pid", *[F.round(c, 4).alias(c + "0") for c in "xyz"], "x", "y", "z", F.col("cloud").cast("int").alias("seq"), F.lit(1).alias("frame"))
    a = F.lit(0.5)
    tf = rigid_array((F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), (F.lit(2.0), F.lit(-1.0), F.lit(0.25)))
    motion = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("seq"), F.lit(1).alias("frame"), tf.alias("motion"))
    # coordinates stay double here, so that rounding agrees across engines
    out = clouds.deskew(p, motion, keep_type=True)
    return rounded(out.drop("seq", "frame"), list("xyz"), 3)


@query("feature_transform", f"""WITH {FEATURE_SQL}, {normal_sql('tf', 'ringf')}
SELECT cloud, class, id, round(-my + 3.0, 5) AS mx, round(mx - 2.0, 5) AS my, round(mz + 1.0, 5) AS mz, round(yy, 5) AS xx, round(-xy, 5) AS xy, round(-yz, 5) AS xz,
  round(xx, 5) AS yy, round(xz, 5) AS yz, round(zz, 5) AS zz FROM tf""")
def feature_transform(spark, sf):
    quarter = rigid_array(tuple(F.lit(v) for v in (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)), (F.lit(3.0), F.lit(-2.0), F.lit(1.0)))
    out = boxes.transform_features(cut_lineage(ring_features(spark, sf)).withColumn("tf", quarter))
    names = ["mx", "my", "mz", *SYM]
    return rounded(out.select("cloud", "class", "id", *names), names, 5)


@query("mahalanobis", f"""WITH {FEATURE_SQL},
ad AS (SELECT *, yy * zz - yz * yz AS a0, xz * yz - xy * zz AS a1, xy * yz - xz * yy AS a2, xx * zz - xz * xz AS a3, xy * xz - yz * xx AS a4, xx * yy - xy * xy AS a5,
   xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM feat)
SELECT cloud, id, round(sqrt((mx * (a0 * mx + a1 * my + a2 * mz) + my * (a1 * mx + a3 * my + a4 * mz) + mz * (a2 * mx + a4 * my + a5 * mz)) / det), 4) AS m FROM ad WHERE det > 1""")
def mahalanobis_norms(spark, sf):
    f = features(spark, sf)
    s = tuple(F.col(c) for c in SYM)
    det = s[0] * (s[3] * s[5] - s[4] * s[4]) - s[1] * (s[1] * s[5] - s[4] * s[2]) + s[2] * (s[1] * s[4] - s[3] * s[2])
    return f.filter(det > 1.0).select("cloud", "id", F.round(mahalanobis(s, cols("m")), 4).alias("m"))


def _gap_sql() -> str:
    """CTEs gm .. gg: squared Wasserstein gap of the summed covariances of every edge in ``ge``."""
    def cell(p: str, i: int, j: int) -> str:
        return p + "xyz"[min(i, j)] + "xyz"[max(i, j)]

    def det(p: str) -> str:
        a, b, c, d, e, f = (p + n for n in SYM)
        return f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c}))"

    prod = ", ".join(
        " + ".join(f"{cell('s', i, k)} * {cell('t', k, j)}" for k in range(3)) + f" AS m{i}{j}" for i in range(3) for j in range(3))
    square = " + ".join(f"m{i}{j} * m{j}{i}" for i in range(3) for j in range(3))
    roots = " + ".join(f"sqrt(greatest(e1 / 3.0 + 2.0 * p * cos(phi + 2.0 * pi() * {k} / 3.0), 0.0))" for k in range(3))
    return f"""gm AS (SELECT *, {prod} FROM ge),
gn AS (SELECT *, m00 + m11 + m22 AS e1, {det('s')} * {det('t')} AS e3, sxx + syy + szz + txx + tyy + tzz AS tr FROM gm),
gs AS (SELECT *, (e1 * e1 - ({square})) / 2.0 AS e2 FROM gn),
gp AS (SELECT *, sqrt(greatest(e1 / 3.0 * (e1 / 3.0) - e2 / 3.0, 0.0)) AS p FROM gs),
gf AS (SELECT *, CASE WHEN p > 1e-100 THEN acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE),
   (2.0 * (e1 / 3.0) * (e1 / 3.0) * (e1 / 3.0) - e2 * (e1 / 3.0) + e3) / (2.0 * p * p * p)))) / 3.0 ELSE 0.0 END AS phi FROM gp),
gg AS (SELECT *, tr - 2.0 * ({roots}) AS gap FROM gf)"""


@query("compat_graph_gaussian", f"""WITH {CORR_SQL},
ge AS (SELECT *, {level_sql('abs(sl - tl) < 2.0 * {b}', LEVELS)} AS min_level FROM prs2 WHERE sl >= 1e-6 AND tl >= 1e-6 AND abs(sl - tl) < CAST(1.6 AS DOUBLE)),
{_gap_sql()}
SELECT src, tgt, u, v, min_level FROM gg WHERE gap < 5.0""")
def compat_graph_gaussian(spark, sf):
    return edge_table(spark, sf, "gaussian").select(*PAIR, "u", "v", "min_level")


CORE_ROUNDS = 30
CORE_SQL = ",\n".join(
    f"""d{i} AS (SELECT src, tgt, x, count(*) AS d FROM (SELECT src, tgt, u AS x FROM k{i} UNION ALL SELECT src, tgt, v FROM k{i}) GROUP BY src, tgt, x HAVING count(*) >= 3),
k{i + 1} AS MATERIALIZED (SELECT k{i}.* FROM k{i} JOIN d{i} a ON a.src = k{i}.src AND a.tgt = k{i}.tgt AND a.x = u JOIN d{i} b ON b.src = k{i}.src AND b.tgt = k{i}.tgt AND b.x = v)"""
    for i in range(CORE_ROUNDS))  # rounds that drop nothing change nothing


@query("k_core", f"WITH {POINT_SQL}, k0 AS MATERIALIZED (SELECT src, tgt, u, v FROM ed),\n{CORE_SQL}\nSELECT src, tgt, u, v FROM k{CORE_ROUNDS}")
def k_core(spark, sf):
    edges = cg.compatible_pairs(corr_table(spark, sf), PAIR, LEVELS, "point")
    return components.k_core(edges.select(*PAIR, "u", "v"), PAIR, 3)


@query("vertex_differences", f"WITH {CORR_SQL} SELECT src, tgt, u, v, round(sl, 5) AS src_len, round(tl, 5) AS tgt_len FROM prs2")
def vertex_differences(spark, sf):
    t = fitting.translation_invariant(corr_table(spark, sf), PAIR)

    def length(s):
        return F.sqrt(F.col(s + "x") * F.col(s + "x") + F.col(s + "y") * F.col(s + "y") + F.col(s + "z") * F.col(s + "z"))

    return t.select(*PAIR, F.col("i").alias("u"), F.col("j").alias("v"), F.round(length("s"), 5).alias("src_len"), F.round(length("t"), 5).alias("tgt_len"))


def _regular_sql() -> str:
    """The five regularised covariances of every feature, from its eigenvalues and outer eigenvectors."""
    values = {
        "PLANE": ("1.0", "1.0", "1e-3"), "LINE": ("1.0", "1e-3", "1e-3"),
        "MIN_EIG": tuple(f"greatest({v}, 1e-3)" for v in ("l2", "l1", "l0")),
        "NORMALIZED_MIN_EIG": tuple(f"greatest({v} / greatest(l2, 1e-300), 1e-3)" for v in ("l2", "l1", "l0")),
    }
    parts = []
    for method, v in values.items():
        cov = ", ".join(
            f"round({' + '.join(f'CAST({w} AS DOUBLE) * {e}{c[0]} * {e}{c[1]}' for w, e in zip(v, 'abc'))}, 4) AS {c}" for c in SYM)
        parts.append(f"SELECT cloud, class, id, '{method}' AS method, {cov} FROM rb")
    size = "sqrt(i0 * i0 + i3 * i3 + i5 * i5 + 2.0 * (i1 * i1 + i2 * i2 + i4 * i4)) / abs(xx * i0 + xy * i1 + xz * i2)"
    parts.append("SELECT cloud, class, id, 'FROBENIUS' AS method, " + ", ".join(f"round({c} * {size}, 4) AS {c}" for c in SYM) + " FROM ri")
    return f"""WITH {FEATURE_SQL}, {normal_sql('rc', 'ringf')}, {normal_sql('ra', 'ringf').replace('l0', 'l2')},
rv AS (SELECT c.cloud, c.class, c.id, c.l0, c.l1, c.l2, a.nx AS ax, a.ny AS ay, a.nz AS az, c.nx AS cx, c.ny AS cy, c.nz AS cz FROM rc c JOIN ra a USING (cloud, id)),
rb AS (SELECT *, cy * az - cz * ay AS bx, cz * ax - cx * az AS "by", cx * ay - cy * ax AS bz FROM rv),
rs AS (SELECT cloud, class, id, xx + CAST(1e-3 AS DOUBLE) AS xx, xy, xz, yy + CAST(1e-3 AS DOUBLE) AS yy, yz, zz + CAST(1e-3 AS DOUBLE) AS zz FROM ringf),
ri AS (SELECT *, yy * zz - yz * yz AS i0, xz * yz - xy * zz AS i1, xy * yz - xz * yy AS i2, xx * zz - xz * xz AS i3, xy * xz - xx * yz AS i4, xx * yy - xy * xy AS i5 FROM rs)
""" + " UNION ALL ".join(parts).replace("by *", '"by" *').replace("* by", '* "by"')


@query("regularized_covariances", _regular_sql())
def regularized_covariances(spark, sf):
    f = cut_lineage(ring_features(spark, sf)).select("cloud", "class", "id", *SYM)
    out = None
    for method in ("PLANE", "LINE", "MIN_EIG", "NORMALIZED_MIN_EIG", "FROBENIUS"):
        part = boxes.regularized(f, method).select("cloud", "class", "id", F.lit(method).alias("method"), *[F.round(c, 4).alias(c) for c in SYM])
        out = part if out is None else out.unionByName(part)
    return out


@query("gaussian_refinement")
def gaussian_refinement(spark, sf):
    corr = corr_table(spark, sf)
    out = gaussian_fit.refine_pose(corr, fitting.fit_pose(corr, PAIR), PAIR, "gaussian")
    return out.select(*PAIR, "converged", F.transform("tf", lambda v: F.round(v, 3)).alias("tf"))


@query("register_correspondences")
def register_correspondences(spark, sf):
    cfg = Config(front_end="none", tf_solver="svd", verify_method="dense_pcd", noise_bounds=(0.2, 0.8), plane_resolution=16.0)
    out = reg.solve_from_correspondences(corr_table(spark, sf), cfg, tables.points(spark, sf))
    return out.select(*PAIR, "valid", "level", F.transform("tf", lambda v: F.round(v, 4)).alias("tf"))
