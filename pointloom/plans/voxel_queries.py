"""Queries for voxel statistics, shape classes, ranking and association."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.linalg import with_eigenvalues
from ..functions.scalar import descriptor_distance, eigenvalue_feature
from ..operators import matching, voxels
from ..operators.voxels import cell_id_sql
from ..session import cut_lineage
from . import features as fx
from . import tables
from .registry import query
from .tables import POINTS_SQL, eigen_sql, gauss_sql, normal_sql

RULE = fx.FeatureRule(size=16.0, min_points=10, plane_ratio=1.6, line_ratio=1.9, min_range=2.0, max_range=60.0, per_class=8)

VOX_SQL = f"""{POINTS_SQL},
vox AS (SELECT *, CAST(floor(x / 16.0) AS INT) AS vx, CAST(floor(y / 16.0) AS INT) AS vy,
               CAST(floor(z / 16.0) AS INT) AS vz FROM pts)"""
ROUNDED = ["mx", "my", "mz", "xx", "xy", "xz", "yy", "yz", "zz"]


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query("voxel_stats", f"""WITH {VOX_SQL}, {gauss_sql('g', 'vox', 'cloud, vx, vy, vz')}
SELECT cloud, vx, vy, vz, n, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)} FROM g""")
def voxel_stats(spark, sf):
    gs = voxels.gaussians(voxels.with_voxel(tables.points(spark, sf), 16.0), ["cloud", *voxels.KEY])
    return rounded(gs.select("cloud", *voxels.KEY, "n", *ROUNDED), ROUNDED)


@query("voxel_downsample", f"""WITH {VOX_SQL}
SELECT cloud, vx, vy, vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n
FROM vox GROUP BY cloud, vx, vy, vz""")
def voxel_downsample(spark, sf):
    return rounded(voxels.downsample(tables.points(spark, sf), ["cloud"], 16.0), list("xyz"))


@query("gaussian_merge", f"""WITH {POINTS_SQL}, {gauss_sql('g', 'pts', 'cloud')}
SELECT cloud, n, {', '.join(f'round({c}, 5) AS {c}' for c in ROUNDED)} FROM g""")
def gaussian_merge(spark, sf):
    parts = voxels.gaussians(voxels.with_voxel(tables.points(spark, sf), 16.0), ["cloud", *voxels.KEY])
    merged = voxels.merge_gaussians(parts, ["cloud"])
    return rounded(merged.select("cloud", "n", *ROUNDED), ROUNDED, 5)


EIG_SQL = f"""{VOX_SQL}, {gauss_sql('g0', 'vox', 'cloud, vx, vy, vz')},
g AS (SELECT * FROM g0 WHERE n >= 10), {eigen_sql('e', 'g')}"""


@query("cov_eigen3", f"WITH {EIG_SQL} SELECT cloud, vx, vy, vz, round(l0, 5) AS l0, round(l1, 5) AS l1, round(l2, 5) AS l2 FROM e")
def cov_eigen3(spark, sf):
    gs = voxels.gaussians(voxels.with_voxel(tables.points(spark, sf), 16.0), ["cloud", *voxels.KEY])
    eig = with_eigenvalues(gs.filter("n >= 10"))
    return rounded(eig.select("cloud", *voxels.KEY, "l0", "l1", "l2"), ["l0", "l1", "l2"], 5)


NORMAL_SQL = f"{EIG_SQL}, {normal_sql('nn', 'e')}"


@query("voxel_normals", f"""WITH {NORMAL_SQL}
SELECT cloud, vx, vy, vz, round(nx * nx, 4) AS nxx, round(nx * ny, 4) AS nxy, round(nz * nz, 4) AS nzz,
       l1 >= CAST(1.6 AS DOUBLE) * greatest(l0, 0.0) AS planar FROM nn""")
def voxel_normals(spark, sf):
    v = voxels.voxel_gaussians(tables.points(spark, sf), ["cloud"], 16.0, 10, 1.6).filter("n >= 10")
    return v.select(
        "cloud", *voxels.KEY, F.round(F.col("nx") * F.col("nx"), 4).alias("nxx"),
        F.round(F.col("nx") * F.col("ny"), 4).alias("nxy"), F.round(F.col("nz") * F.col("nz"), 4).alias("nzz"), "planar",
    )


FEATURE_SQL = f"""{EIG_SQL},
cls AS (SELECT *, CASE WHEN l1 >= CAST(1.6 AS DOUBLE) * greatest(l0, 0.0) THEN 'Plane'
                       WHEN l2 >= CAST(1.9 AS DOUBLE) * greatest(l0, 0.0) THEN 'Line' ELSE 'Cluster' END AS class FROM e),
feat AS (SELECT *, round(CASE class WHEN 'Cluster' THEN (l0 / (l0 + l1 + l2)) * (l1 / (l0 + l1 + l2)) * (l2 / (l0 + l1 + l2))
                              WHEN 'Plane' THEN l1 * l2 WHEN 'Line' THEN l2 ELSE 0.0 END, 6) AS score,
         {cell_id_sql('vx', 'vy', 'vz')} AS id, sqrt(mx * mx + my * my + mz * mz) AS dist FROM cls),
ringf AS (SELECT * FROM feat WHERE dist BETWEEN 2.0 AND 60.0)"""


def features(spark, sf):
    return fx.voxel_features(tables.points(spark, sf), RULE)


def ring_features(spark, sf):
    """All features inside the range ring; only ``topk_per_class`` ranks and cuts them."""
    return fx.in_range(features(spark, sf), RULE)


def pair_lists(spark, sf, desc):
    """Both feature lists of every pair.

    The lists are small next to the points and feed several joins, so they are written
    out once instead of scanning the points for each use.
    """
    return fx.pair_sides(cut_lineage(ring_features(spark, sf)), cloud_pairs(spark, sf), desc)


@query("shape_classes", f"WITH {FEATURE_SQL} SELECT cloud, id, class, n, score FROM feat")
def shape_classes(spark, sf):
    return features(spark, sf).select("cloud", "id", "class", "n", "score")


@query("eigen_features", f"""WITH {FEATURE_SQL},
s AS (SELECT cloud, id, l0 / (l0 + l1 + l2) AS e3, l1 / (l0 + l1 + l2) AS e2, l2 / (l0 + l1 + l2) AS e1 FROM feat)
SELECT cloud, id, round((e1 - e2) / e1, 5) AS linearity, round((e2 - e3) / e1, 5) AS planarity, round(e3 / e1, 5) AS sphericity,
  round(pow(e1 * e2 * e3, CAST(1 AS DOUBLE) / 3), 5) AS omnivariance, round((e1 - e3) / e1, 5) AS anisotropy,
  round(-e1 * ln(e1) - e2 * ln(e2) - e3 * ln(e3), 5) AS eigentropy, round(e1 + e2 + e3, 5) AS total,
  round(e3 / (e1 + e2 + e3), 5) AS curvature FROM s""")
def eigen_features(spark, sf):
    names = ["linearity", "planarity", "sphericity", "omnivariance", "anisotropy", "eigentropy", "total", "curvature"]
    values = eigenvalue_feature(F.col("l0"), F.col("l1"), F.col("l2"))
    return features(spark, sf).select("cloud", "id", *[F.round(v, 5).alias(n) for n, v in zip(names, values)])


@query("topk_per_class", f"""WITH {FEATURE_SQL}
SELECT cloud, class, id, rank, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cloud, class ORDER BY score DESC, id) AS INT) AS rank FROM ringf) WHERE rank <= 8""")
def topk_per_class(spark, sf):
    return fx.top_features(features(spark, sf), RULE).select("cloud", "class", "id", "rank", "score")


def cloud_pairs(spark, sf):
    """Suppliers with consecutive keys."""
    s = tables.read(spark, sf, "supplier")
    other = s.select(F.col("s_suppkey").alias("tgt"))
    return s.select(F.col("s_suppkey").alias("src")).join(other, F.col("src") + 1 == F.col("tgt"))


PAIR_SQL = """prs AS (SELECT a.s_suppkey AS src, b.s_suppkey AS tgt FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)"""

SIM_SQL = f"""{FEATURE_SQL}, {PAIR_SQL},
sim AS (SELECT p.src, p.tgt, a.class, a.id AS src_id, b.id AS tgt_id,
   sqrt(pow(sqrt(greatest(a.l0, 0.0)) - sqrt(greatest(b.l0, 0.0)), 2) + pow(sqrt(greatest(a.l1, 0.0)) - sqrt(greatest(b.l1, 0.0)), 2)
        + pow(sqrt(greatest(a.l2, 0.0)) - sqrt(greatest(b.l2, 0.0)), 2)) AS dist
   FROM prs p JOIN ringf a ON a.cloud = p.src JOIN ringf b ON b.cloud = p.tgt AND b.class = a.class)"""
MUTUAL_SQL = f"""{SIM_SQL},
corr AS (SELECT src, tgt, class, src_id, tgt_id, dist FROM (
   SELECT *, row_number() OVER (PARTITION BY src, tgt, class, src_id ORDER BY dist, tgt_id) AS ri,
             row_number() OVER (PARTITION BY src, tgt, class, tgt_id ORDER BY dist, src_id) AS rj FROM sim)
   WHERE ri <= 3 AND rj <= 3)"""


def matches(spark, sf, k=3):
    src, tgt = pair_lists(spark, sf, fx.spread_descriptor())
    return matching.mutual_top_k(src, tgt, ["src", "tgt", "class"], k, descriptor_distance)


@query("mutual_topk", f"WITH {MUTUAL_SQL} SELECT src, tgt, class, src_id, tgt_id, round(dist, 5) AS dist FROM corr")
def mutual_topk(spark, sf):
    return rounded(matches(spark, sf), ["dist"], 5)


EV_SQL = f"""{FEATURE_SQL}, {PAIR_SQL},
s AS (SELECT cloud, class, id, l0 / (l0 + l1 + l2) AS e3, l1 / (l0 + l1 + l2) AS e2, l2 / (l0 + l1 + l2) AS e1 FROM ringf),
d AS (SELECT cloud, class, id, [(e1 - e2) / e1, (e2 - e3) / e1, e3 / e1, pow(e1 * e2 * e3, CAST(1 AS DOUBLE) / 3), (e1 - e3) / e1,
  -e1 * ln(e1) - e2 * ln(e2) - e3 * ln(e3), e1 + e2 + e3, e3 / (e1 + e2 + e3)] AS v FROM s),
sim AS (SELECT p.src, p.tgt, a.class, a.id AS src_id, b.id AS tgt_id, list_distance(a.v, b.v) AS dist
   FROM prs p JOIN d a ON a.cloud = p.src JOIN d b ON b.cloud = p.tgt AND b.class = a.class)"""


@query("mutual_topk_eigen", f"""WITH {EV_SQL}
SELECT src, tgt, class, src_id, tgt_id, round(dist, 5) AS dist FROM (
   SELECT *, row_number() OVER (PARTITION BY src, tgt, class, src_id ORDER BY dist, tgt_id) AS ri,
             row_number() OVER (PARTITION BY src, tgt, class, tgt_id ORDER BY dist, src_id) AS rj FROM sim)
   WHERE ri <= 3 AND rj <= 3""")
def mutual_topk_eigen(spark, sf):
    src, tgt = pair_lists(spark, sf, fx.eigen_descriptor())
    return rounded(matching.mutual_top_k(src, tgt, ["src", "tgt", "class"], 3, descriptor_distance), ["dist"], 5)


@query("class_pairs", f"""WITH {FEATURE_SQL}, {PAIR_SQL}
SELECT p.src, p.tgt, a.class, a.id AS src_id, b.id AS tgt_id FROM prs p JOIN ringf a ON a.cloud = p.src
JOIN ringf b ON b.cloud = p.tgt AND b.class = a.class""")
def class_pairs(spark, sf):
    src, tgt = pair_lists(spark, sf, fx.spread_descriptor())
    return matching.all_to_all(src, tgt, ["src", "tgt", "class"])


@query("first_k", f"""WITH {FEATURE_SQL}, {PAIR_SQL},
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud, class ORDER BY (id % 1000003 * 7919 + 17) % 1000003, id) AS r FROM ringf) WHERE r <= 3)
SELECT p.src, p.tgt, a.class, a.id AS src_id, b.id AS tgt_id FROM prs p JOIN ringf a ON a.cloud = p.src
JOIN h b ON b.cloud = p.tgt AND b.class = a.class""")
def first_k(spark, sf):
    src, tgt = pair_lists(spark, sf, fx.spread_descriptor())
    return matching.first_k(src, tgt, ["src", "tgt", "class"], 3)


@query("sample_per_voxel", f"""WITH {VOX_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY cloud, vx, vy, vz ORDER BY pid, x, y, z) - 1 AS pos,
             count(*) OVER (PARTITION BY cloud, vx, vy, vz) AS n FROM vox)
SELECT cloud, vx, vy, vz, pid, x, y, z FROM r
WHERE n <= 5 OR (pos % greatest(n // 5, 1) = 0 AND pos // greatest(n // 5, 1) < 5)""")
def sample_per_voxel(spark, sf):
    out = voxels.sample_per_voxel(tables.points(spark, sf), ["cloud"], 16.0, 5, ["pid", "x", "y", "z"])
    return out.select("cloud", *voxels.KEY, "pid", "x", "y", "z")


@query("first_per_cell", f"""WITH {VOX_SQL}
SELECT cloud, vx, vy, vz, pid, x, y, z FROM (
  SELECT *, row_number() OVER (PARTITION BY cloud, vx, vy, vz ORDER BY pid, x, y, z) AS r FROM vox) WHERE r = 1""")
def first_per_cell(spark, sf):
    cells = voxels.with_voxel(tables.points(spark, sf), 16.0)
    return voxels.first_per_cell(cells, ["cloud", *voxels.KEY], ["pid", "x", "y", "z"], [])


@query("box_filter", f"WITH {POINTS_SQL} SELECT cloud, pid, x, y, z FROM pts WHERE x BETWEEN -12 AND 12 AND y BETWEEN -12 AND 12 AND z BETWEEN -12 AND 12")
def box_filter(spark, sf):
    return voxels.box_filter(tables.points(spark, sf), 12.0).select("cloud", "pid", "x", "y", "z")
