"""Queries for descriptors, hulls and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import bin_overlap_distance
from ..operators import boxes, descriptors, matching, voxels
from ..session import cut_lineage
from . import tables
from .registry import query
from .tables import POINTS_SQL, eigen_sql, gauss_sql, normal_sql
from .voxel_queries import FEATURE_SQL, PAIR_SQL, cloud_pairs, rounded, ring_features

BIN_SQL = f"""{FEATURE_SQL}, {normal_sql('tf', 'ringf')},
hp AS (SELECT a.cloud, a.id, b.mx - a.mx AS ex, b.my - a.my AS ey, b.mz - a.mz AS ez, a.nx AS ax, a.ny AS ay, a.nz AS az, b.nx AS bx, b.ny AS by_, b.nz AS bz, a.class AS ac, b.class AS bc
  FROM tf a JOIN tf b ON a.cloud = b.cloud AND (b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz) <= 400.0),
h1 AS (SELECT *, ex * ax + ey * ay + ez * az AS la, ex * bx + ey * by_ + ez * bz AS lb FROM hp),
h2 AS (SELECT cloud, id, CASE ac WHEN 'Line' THEN sqrt(pow(ex - ax * la, 2) + pow(ey - ay * la, 2) + pow(ez - az * la, 2)) ELSE abs(la) END AS d1,
   CASE bc WHEN 'Line' THEN sqrt(pow(ex - bx * lb, 2) + pow(ey - by_ * lb, 2) + pow(ez - bz * lb, 2)) ELSE abs(lb) END AS d2,
   degrees(acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), ax * bx + ay * by_ + az * bz)))) AS an FROM h1),
hb AS (SELECT cloud, id, CAST(floor(greatest(d1, d2) / 0.5) AS INT) AS bx, CAST(floor(least(d1, d2) / 0.5) AS INT) AS by, CAST(floor(an) AS INT) AS bz, count(*) AS n FROM h2 GROUP BY ALL)"""


def oriented_features(spark, sf):
    f = cut_lineage(ring_features(spark, sf))
    return f.select("cloud", "class", "id", *[F.col("m" + a).alias(a) for a in "xyz"], "nx", "ny", "nz")


@query("hash_desc", f"""WITH {BIN_SQL} SELECT cloud, id, bx, "by", bz, n FROM hb""")
def hash_desc(spark, sf):
    return descriptors.hash_bins(oriented_features(spark, sf), ["cloud"])


@query("hash_desc_matches", f"""WITH {BIN_SQL}, {PAIR_SQL},
hh AS (SELECT p.src, p.tgt, a.id AS src_id, b.id AS tgt_id, count(*) AS hits FROM prs p JOIN hb a ON a.cloud = p.src JOIN hb b ON b.cloud = p.tgt
   AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1 AND abs(a.bz - b.bz) <= 1 GROUP BY ALL),
sm AS (SELECT p.src, p.tgt, a.class, a.id AS src_id, b.id AS tgt_id, CAST(1 AS DOUBLE) / (1 + coalesce(hits, 0)) AS dist FROM prs p JOIN ringf a ON a.cloud = p.src
   JOIN ringf b ON b.cloud = p.tgt AND b.class = a.class LEFT JOIN hh ON hh.src = p.src AND hh.tgt = p.tgt AND hh.src_id = a.id AND hh.tgt_id = b.id)
SELECT src, tgt, class, src_id, tgt_id, round(dist, 6) AS dist FROM (
   SELECT *, row_number() OVER (PARTITION BY src, tgt, class, src_id ORDER BY dist, tgt_id) AS ri,
             row_number() OVER (PARTITION BY src, tgt, class, tgt_id ORDER BY dist, src_id) AS rj FROM sm) WHERE ri <= 3 AND rj <= 3""")
def hash_desc_matches(spark, sf):
    f = oriented_features(spark, sf)
    bins = cut_lineage(descriptors.hash_bins(f, ["cloud"]).join(f.select("cloud", "id", "class"), ["cloud", "id"]))
    pairs = cut_lineage(cloud_pairs(spark, sf))
    on = ["src", "tgt", "class"]

    def side(df, which):
        return pairs.join(df.withColumnRenamed("cloud", which), which)

    out = matching.bin_overlap_top_k(side(bins, "src"), side(bins, "tgt"), side(f, "src"), side(f, "tgt"), on, 3, bin_overlap_distance)
    return rounded(out, ["dist"])


@query("fpfh_matches")
def fpfh_matches(spark, sf):
    f = oriented_features(spark, sf)
    desc = cut_lineage(descriptors.fpfh(f, ["cloud"], 30.0))
    pairs = cut_lineage(cloud_pairs(spark, sf))
    src, tgt = (pairs.join(desc.withColumnRenamed("cloud", c), c) for c in ("src", "tgt"))
    return rounded(matching.mutual_nearest(src, tgt, ["src", "tgt"], 5), ["dist"], 4)


_D = ["b.x - a.x", "b.y - a.y", "b.z - a.z"]
_GAP2 = " + ".join(f"({d}) * ({d})" for d in _D)
ISS_SQL = f"""WITH {POINTS_SQL},
dn AS (SELECT cloud, {voxels.cell_id_sql('floor(x / 8.0)', 'floor(y / 8.0)', 'floor(z / 8.0)')} AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY ALL),
nr AS (SELECT a.cloud, a.id AS a, b.id AS b, {_GAP2} AS d2, {', '.join(f'({d}) AS d{c}' for d, c in zip(_D, 'xyz'))}
  FROM dn a JOIN dn b ON a.cloud = b.cloud AND a.id <> b.id AND {_GAP2} <= 324.0),
sc AS (SELECT cloud, a AS id, {', '.join(f'avg(d{c[0]} * d{c[1]}) AS {c}' for c in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM nr GROUP BY cloud, a HAVING count(*) >= 4),
{eigen_sql('ie', 'sc')},
sal AS (SELECT cloud, id, CASE WHEN l1 < CAST(0.975 AS DOUBLE) * l2 AND l0 < CAST(0.975 AS DOUBLE) * l1 THEN l0 ELSE 0.0 END AS saliency FROM ie),
rg AS (SELECT nr.cloud, nr.a AS id, max(saliency) AS m, count(*) AS n FROM nr JOIN sal ON sal.cloud = nr.cloud AND sal.id = nr.b WHERE d2 <= 144.0 GROUP BY ALL)
SELECT cloud, id, round(saliency, 5) AS saliency FROM sal JOIN rg USING (cloud, id) WHERE saliency > 0 AND saliency > m AND n >= 4"""


@query("iss_keypoints", ISS_SQL)
def iss_keypoints(spark, sf):
    small = voxels.downsample(tables.points(spark, sf), ["cloud"], 8.0)
    ids = voxels.cell_id("vx", "vy", "vz")
    pts = cut_lineage(small.select("cloud", ids.alias("id"), "x", "y", "z"))
    out = descriptors.iss_keypoints(pts, ["cloud"], 3.0)
    return out.select("cloud", "id", F.round("saliency", 5).alias("saliency"))


@query("convex_hull", """WITH p AS (SELECT DISTINCT l_suppkey AS cloud, l_quantity AS u, floor(l_extendedprice) / CAST(2048 AS DOUBLE) AS v FROM lineitem),
o AS (SELECT cloud, u, min(v) AS lo, max(v) AS hi FROM p GROUP BY cloud, u),
lows AS (SELECT m.cloud, m.u, m.lo AS v FROM o m WHERE NOT EXISTS (SELECT 1 FROM o a, o b WHERE a.cloud = m.cloud AND b.cloud = m.cloud AND a.u < m.u AND b.u > m.u
   AND (m.lo - a.lo) * (b.u - a.u) >= (b.lo - a.lo) * (m.u - a.u))),
highs AS (SELECT m.cloud, m.u, m.hi AS v FROM o m WHERE NOT EXISTS (SELECT 1 FROM o a, o b WHERE a.cloud = m.cloud AND b.cloud = m.cloud AND a.u < m.u AND b.u > m.u
   AND (m.hi - a.hi) * (b.u - a.u) <= (b.hi - a.hi) * (m.u - a.u)))
SELECT cloud, u, v FROM lows UNION SELECT cloud, u, v FROM highs""")
def convex_hull(spark, sf):
    flat = tables.points(spark, sf).select("cloud", F.col("x").alias("u"), F.col("y").alias("v"))
    return boxes.convex_hull(flat, ["cloud"])


def _box_sql() -> str:
    """Boxes of whole clouds: plane basis, hull by slopes, score of every candidate angle."""
    n = boxes.ANGLES
    return f"""WITH {POINTS_SQL}, {gauss_sql('bg', 'pts', 'cloud')}, {eigen_sql('be', 'bg')}, {normal_sql('bn', 'be')},
bl AS (SELECT cloud, nx, ny, nz, sqrt((ny - nz) * (ny - nz) + nx * nx + nx * nx) AS len FROM bn),
bf AS (SELECT *, CASE WHEN len > 1e-12 THEN (ny - nz) / len ELSE 1.0 END AS ex, CASE WHEN len > 1e-12 THEN -nx / len ELSE 0.0 END AS ey, CASE WHEN len > 1e-12 THEN nx / len ELSE 0.0 END AS ez FROM bl),
bb AS (SELECT *, ny * ez - nz * ey AS fx, nz * ex - nx * ez AS fy, nx * ey - ny * ex AS fz FROM bf),
fl AS (SELECT DISTINCT cloud, x * ex + y * ey + z * ez AS u, x * fx + y * fy + z * fz AS v FROM pts JOIN bb USING (cloud)),
dp AS (SELECT cloud, max(x * nx + y * ny + z * nz) - min(x * nx + y * ny + z * nz) AS w FROM pts JOIN bb USING (cloud) GROUP BY cloud),
sl AS (SELECT p.cloud, p.u, p.v, (q.u > p.u OR (q.u = p.u AND q.v > p.v)) AS later, CASE WHEN q.u = p.u THEN CAST('Infinity' AS DOUBLE) ELSE (q.v - p.v) / (q.u - p.u) END AS s
   FROM fl p JOIN fl q ON q.cloud = p.cloud AND (q.u <> p.u OR q.v <> p.v)),
hl AS (SELECT cloud, u, v FROM sl GROUP BY cloud, u, v
   HAVING coalesce(max(s) FILTER (later), CAST('-Infinity' AS DOUBLE)) < coalesce(min(s) FILTER (NOT later), CAST('Infinity' AS DOUBLE))
       OR coalesce(min(s) FILTER (later), CAST('Infinity' AS DOUBLE)) > coalesce(max(s) FILTER (NOT later), CAST('-Infinity' AS DOUBLE))),
tu AS (SELECT cloud, k, (k + CAST(0.5 AS DOUBLE)) * CAST({90.0 / n} AS DOUBLE) AS angle, u, v FROM hl, range({n}) r(k)),
tp AS (SELECT cloud, k, angle, cos(radians(angle)) * u + sin(radians(angle)) * v AS p, cos(radians(angle)) * v - sin(radians(angle)) * u AS q FROM tu),
bx AS (SELECT cloud, k, min(p) AS lu, max(p) AS hu, min(q) AS lv, max(q) AS hv FROM tp GROUP BY cloud, k),
st AS (SELECT cloud, k, any_value(angle) AS angle, any_value(hu - lu) AS su, any_value(hv - lv) AS sv, any_value((hu - lu) * (hv - lv)) + sum(least(p - lu, hu - p, q - lv, hv - q)) AS score
   FROM tp JOIN bx USING (cloud, k) GROUP BY cloud, k),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY round(score, 9), k) AS r FROM st) WHERE r = 1)
SELECT cloud, round(angle, 3) AS angle, round(su * sv, 4) AS area, round(pow(greatest(su, sv, w), 2) / 4.0 / CAST(7.815 AS DOUBLE), 5) AS prior FROM bs JOIN dp USING (cloud)"""


@query("tight_boxes", _box_sql())
def tight_boxes(spark, sf):
    pts = tables.points(spark, sf)
    shaped = voxels.with_shape(voxels.gaussians(pts, ["cloud"]))
    out = boxes.box_covariance(boxes.tight_boxes(pts, shaped, ["cloud"]))
    return out.select("cloud", F.round("angle", 3).alias("angle"), F.round("area", 4).alias("area"), F.round("prior", 5).alias("prior"))


@query("upright_lines")
def upright_lines(spark, sf):
    p = tables.points(spark, sf)
    tall = voxels.with_voxel(p.select("cloud", "x", "y", (F.col("z") * 8.0).alias("z")), (8.0, 8.0, 1000.0))
    out = boxes.poles(tall, ["cloud", *voxels.KEY], ratio=4.0, reach=16.0)
    return out.select("cloud", *voxels.KEY, "n", F.round("l2", 4).alias("l2"))
