"""Queries for compatibility graphs, consensus and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compatibility as cg
from ..operators import components, consensus
from ..session import cut_lineage
from . import features as fx
from . import tables
from .correspondences import PAIR, correspondences
from .registry import query
from .voxel_queries import MUTUAL_SQL, cloud_pairs, rounded, ring_features
from ..operators.matching import mutual_top_k
from ..functions.scalar import descriptor_distance

LEVELS = [0.2, 0.4, 0.6, 0.8]
CHI2 = [0.115, 0.352, 0.584, 1.005]
SYM = ["xx", "xy", "xz", "yy", "yz", "zz"]


def corr_table(spark, sf):
    """Numbered correspondences of every pair, written once: several joins read them."""
    feats = cut_lineage(ring_features(spark, sf))
    src, tgt = fx.pair_sides(feats, cloud_pairs(spark, sf), fx.spread_descriptor())
    found = mutual_top_k(src, tgt, ["src", "tgt", "class"], 3, descriptor_distance)
    return cut_lineage(correspondences(found, feats))


CORR_SQL = f"""{MUTUAL_SQL},
ct AS (SELECT c.src, c.tgt, c.class, c.src_id, c.tgt_id,
   row_number() OVER (PARTITION BY c.src, c.tgt ORDER BY c.class, c.src_id, c.tgt_id) - 1 AS corr_id,
   a.mx AS sx, a.my AS sy, a.mz AS sz, b.mx AS tx, b.my AS ty, b.mz AS tz, a.l2 AS sl2, b.l2 AS tl2,
   {', '.join(f'a.{c} AS s{c}, b.{c} AS t{c}' for c in SYM)}
   FROM corr c JOIN ringf a ON a.cloud = c.src AND a.class = c.class AND a.id = c.src_id
   JOIN ringf b ON b.cloud = c.tgt AND b.class = c.class AND b.id = c.tgt_id),
prs2 AS (SELECT a.src, a.tgt, a.corr_id AS u, b.corr_id AS v,
   sqrt((b.sx - a.sx) * (b.sx - a.sx) + (b.sy - a.sy) * (b.sy - a.sy) + (b.sz - a.sz) * (b.sz - a.sz)) AS sl,
   sqrt((b.tx - a.tx) * (b.tx - a.tx) + (b.ty - a.ty) * (b.ty - a.ty) + (b.tz - a.tz) * (b.tz - a.tz)) AS tl,
   {', '.join(f'a.s{c} + b.s{c} AS s{c}, a.t{c} + b.t{c} AS t{c}' for c in SYM)}, a.sl2 + b.sl2 AS sl2, a.tl2 + b.tl2 AS tl2
   FROM ct a JOIN ct b ON a.src = b.src AND a.tgt = b.tgt AND a.corr_id < b.corr_id)"""


def level_sql(test: str, bounds) -> str:
    cases = " ".join(f"WHEN {test.format(b=f'CAST({b} AS DOUBLE)')} THEN {i}" for i, b in enumerate(bounds))
    return f"CASE {cases} END"


def edges_sql(test: str, bounds) -> str:
    return f"""{CORR_SQL},
ed AS (SELECT * FROM (SELECT src, tgt, u, v, {level_sql(test, bounds)} AS min_level, sl, tl FROM prs2
       WHERE sl >= 1e-6 AND tl >= 1e-6) WHERE min_level IS NOT NULL)"""


POINT_SQL = edges_sql("abs(sl - tl) < 2.0 * {b}", LEVELS)


def edge_table(spark, sf, kind="point", levels=LEVELS):
    return cg.compatible_pairs(corr_table(spark, sf), PAIR, levels, kind)


@query("compat_graph_pyramid", f"""WITH {POINT_SQL}
SELECT src, tgt, level, count(*) AS edges FROM ed JOIN range(4) r(level) ON r.level >= min_level GROUP BY src, tgt, level""")
def compat_graph_pyramid(spark, sf):
    return (
        cg.expand_levels(edge_table(spark, sf), len(LEVELS)).groupBy(*PAIR, F.col("level").cast("long").alias("level"))
        .agg(F.count(F.lit(1)).alias("edges"))
    )


@query("compat_graph_point", f"WITH {POINT_SQL} SELECT src, tgt, u, v, min_level, round(sl, 6) AS src_len, round(tl, 6) AS tgt_len FROM ed")
def compat_graph_point(spark, sf):
    return rounded(edge_table(spark, sf), ["src_len", "tgt_len"])


@query("compat_graph_ratio", f"""WITH {edges_sql('abs(sl / tl - 1.0) < 2.0 * {b} AND abs(tl / sl - 1.0) < 2.0 * {b}', [0.005, 0.01, 0.02, 0.04])}
SELECT src, tgt, u, v, min_level FROM ed""")
def compat_graph_ratio(spark, sf):
    return edge_table(spark, sf, "point_ratio", [0.005, 0.01, 0.02, 0.04]).select(*PAIR, "u", "v", "min_level")


def _bound_sql(p: str) -> str:
    m = f"(({p}xx + {p}yy + {p}zz) / 3.0)"
    sq = f"({p}xx * {p}xx + {p}yy * {p}yy + {p}zz * {p}zz + 2.0 * ({p}xy * {p}xy + {p}xz * {p}xz + {p}yz * {p}yz))"
    return (f"least(greatest(abs({p}xx) + abs({p}xy) + abs({p}xz), abs({p}xy) + abs({p}yy) + abs({p}yz), "
            f"abs({p}xz) + abs({p}yz) + abs({p}zz)), {m} + sqrt(2.0 * greatest({sq} / 3.0 - {m} * {m}, 0.0)), {p}l2)")


@query("compat_graph_ellipse", f"""WITH {edges_sql(f"abs(sl - tl) < sqrt({_bound_sql('s')} * {{b}}) + sqrt({_bound_sql('t')} * {{b}})", [0.0115, 0.0352, 0.0584, 0.1005])}
SELECT src, tgt, u, v, min_level FROM ed""")
def compat_graph_ellipse(spark, sf):
    levels = [0.0115, 0.0352, 0.0584, 0.1005]
    return edge_table(spark, sf, "ellipse", levels).select(*PAIR, "u", "v", "min_level")


WEIGHT_SQL = f"""{CORR_SQL},
wp AS (SELECT src, tgt, u, v, 1.0 - ((sl - tl) * (sl - tl)) / CAST(0.36 AS DOUBLE) AS w FROM prs2),
we AS (SELECT * FROM wp WHERE w >= CAST(0.9 AS DOUBLE)),
ws AS (SELECT src, tgt, u, v, w FROM we UNION ALL SELECT src, tgt, v, u, w FROM we)"""


def weight_table(spark, sf):
    corr = corr_table(spark, sf)
    return corr, cut_lineage(cg.weighted_pairs(corr, PAIR))


@query("sc2_weights", f"""WITH {WEIGHT_SQL}
SELECT e.src, e.tgt, e.u, e.v, round(e.w * sum(a.w * b.w), 5) AS w FROM we e JOIN ws a ON a.src = e.src AND a.tgt = e.tgt AND a.u = e.u
JOIN ws b ON b.src = e.src AND b.tgt = e.tgt AND b.u = a.v AND b.v = e.v GROUP BY e.src, e.tgt, e.u, e.v, e.w""")
def sc2_weights(spark, sf):
    _, edges = weight_table(spark, sf)
    return rounded(cg.second_order(edges, PAIR), ["w"], 5)


TRI_SQL = f"""{WEIGHT_SQL},
tri AS (SELECT a.src, a.tgt, a.u AS x, a.v AS y, b.v AS z, a.w * b.w * c.w AS p FROM we a
  JOIN we b ON b.src = a.src AND b.tgt = a.tgt AND b.u = a.u AND b.v > a.v
  JOIN we c ON c.src = a.src AND c.tgt = a.tgt AND c.u = a.v AND c.v = b.v)"""


@query("triangles", f"WITH {TRI_SQL} SELECT src, tgt, x, y, z FROM tri")
def triangles(spark, sf):
    _, edges = weight_table(spark, sf)
    abc = F.array_sort(F.array("a", "b", "c"))
    t = cg.triangles(edges, PAIR).select(*PAIR, abc.alias("t"))
    return t.select(*PAIR, *[F.col("t")[i].alias(n) for i, n in enumerate("xyz")])


FACTOR_SQL = f"""{TRI_SQL},
deg AS (SELECT src, tgt, u AS corr_id, count(*) AS degree FROM ws GROUP BY src, tgt, u),
pt AS (SELECT src, tgt, corr_id, sum(pow(p, CAST(1 AS DOUBLE) / 3)) AS tri FROM (
  SELECT src, tgt, x AS corr_id, p FROM tri UNION ALL SELECT src, tgt, y, p FROM tri UNION ALL SELECT src, tgt, z, p FROM tri)
  GROUP BY src, tgt, corr_id),
fac AS (SELECT ct.src, ct.tgt, ct.corr_id, coalesce(degree, 0) AS degree, coalesce(tri, 0.0) AS tri,
  CASE WHEN degree > 1 THEN coalesce(tri, 0.0) / (degree * (degree - 1) * 0.5) ELSE 0.0 END AS factor
  FROM ct LEFT JOIN deg USING (src, tgt, corr_id) LEFT JOIN pt USING (src, tgt, corr_id))"""


@query("cluster_coeff", f"WITH {FACTOR_SQL} SELECT src, tgt, corr_id, degree, round(CAST(factor AS DOUBLE), 5) AS factor FROM fac")
def cluster_coeff(spark, sf):
    corr, edges = weight_table(spark, sf)
    return rounded(cg.clustering(corr, edges, PAIR).select(*PAIR, "corr_id", "degree", "factor"), ["factor"], 5)


@query("cluster_coeff_summary", f"""WITH {FACTOR_SQL}
SELECT src, tgt, round(CAST(avg(factor) AS DOUBLE), 5) AS mean_factor, max(degree) AS max_degree,
  round(CAST(sum(tri) FILTER (degree > 1) / sum(degree * (degree - 1) * 0.5) FILTER (degree > 1) AS DOUBLE), 5) AS total_factor
FROM fac GROUP BY src, tgt""")
def cluster_coeff_summary(spark, sf):
    corr, edges = weight_table(spark, sf)
    out = cg.clustering_summary(cg.clustering(corr, edges, PAIR), PAIR)
    return rounded(out, ["mean_factor", "total_factor"], 5)


OTSU_SQL = """WITH v AS (SELECT event_type, round(value * 100) AS v FROM events),
b AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM v GROUP BY event_type),
h AS (SELECT event_type, CAST(least(floor(v / ((hi - lo) / 100)), 99) AS INT) AS bin, count(*) AS n, sum(v) AS s,
   any_value(lo) AS lo, any_value(hi) AS hi FROM v JOIN b USING (event_type) GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER (PARTITION BY event_type) AS na,
   sum(s) OVER (PARTITION BY event_type) AS sa FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
k AS (SELECT event_type, bin, bin * (hi - lo) / CAST(100 AS DOUBLE) AS t,
   CAST(n1 AS DOUBLE) * CAST(na - n1 AS DOUBLE) * pow(s1 / n1 - (sa - s1) / (na - n1), 2) AS sb FROM c WHERE na > n1)
SELECT event_type, round(t, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sb DESC, bin) AS r FROM k) WHERE r = 1"""


@query("otsu_threshold", OTSU_SQL)
def otsu_threshold(spark, sf):
    ev = tables.read(spark, sf, "events")
    return rounded(consensus.otsu(ev, ["event_type"], F.round(F.col("value") * 100)), ["threshold"])


TLS_SQL = """WITH r AS (SELECT user_id, round(value * 100) AS x, CAST(500 AS DOUBLE) AS r FROM events),
e AS (SELECT user_id, x - r AS h, -1 AS o, x, r, 1 AS s FROM r UNION ALL SELECT user_id, x + r, 1, x, r, -1 FROM r),
g AS (SELECT user_id, h, o, sum(s) AS card, sum(s / (r * r)) AS w, sum(s * (x / (r * r))) AS wx, sum(s * x) AS sx,
   sum(s * x * x) AS sxx, sum(s * r) AS sr FROM e GROUP BY user_id, h, o),
c AS (SELECT user_id, h, o, sum(card) OVER w AS card, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx, sum(sr) OVER w AS sr FROM g
   WINDOW w AS (PARTITION BY user_id ORDER BY h, o ROWS UNBOUNDED PRECEDING)),
k AS (SELECT user_id, h, o, sx / card AS est, card * (sx / card) * (sx / card) + sxx - 2.0 * sx * (sx / card) + (tot - sr) AS cost
   FROM c JOIN (SELECT user_id, sum(r) AS tot FROM r GROUP BY user_id) USING (user_id) WHERE card > 0)
SELECT user_id, round(est, 2) AS estimate, round(cost, 1) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(cost, 3), h, o) AS rn FROM k) WHERE rn = 1"""


@query("tls_sweep", TLS_SQL)
def tls_sweep(spark, sf):
    ev = tables.read(spark, sf, "events")
    out = consensus.tls_sweep(ev, ["user_id"], F.round(F.col("value") * 100), F.lit(500.0), 3)
    return out.select("user_id", F.round("estimate", 2).alias("estimate"), F.round("cost", 1).alias("cost"))


@query("scale_inliers", f"WITH {CORR_SQL} SELECT src, tgt, u, v, abs(sl - tl) <= CAST(0.4 AS DOUBLE) AS inlier FROM prs2 WHERE abs(sl - tl) < CAST(1.6 AS DOUBLE) AND sl >= 1e-6 AND tl >= 1e-6")
def scale_inliers(spark, sf):
    return consensus.scale_inliers(edge_table(spark, sf), 0.2).select(*PAIR, "u", "v", "inlier")


CHAIN_SQL = f"""WITH {CORR_SQL}
SELECT src, tgt, corr_id, {', '.join(f"round(coalesce(lead({s}{a}) OVER w, first_value({s}{a}) OVER w) - {s}{a}, 6) AS d{s}{a}" for s in 'st' for a in 'xyz')}
FROM ct WINDOW w AS (PARTITION BY src, tgt ORDER BY corr_id)"""


@query("chain_lead_wrap", CHAIN_SQL)
def chain_lead_wrap(spark, sf):
    names = ["d" + s + a for s in "st" for a in "xyz"]
    return rounded(cg.chain(corr_table(spark, sf), PAIR).select(*PAIR, "corr_id", *names), names)


COMPONENT_SQL = f"""WITH RECURSIVE {POINT_SQL},
es AS (SELECT src, tgt, u, v FROM ed WHERE min_level = 0 UNION SELECT src, tgt, v, u FROM ed WHERE min_level = 0),
reach AS (SELECT src, tgt, corr_id AS a, corr_id AS b FROM ct
  UNION SELECT r.src, r.tgt, r.a, e.v FROM reach r JOIN es e ON e.src = r.src AND e.tgt = r.tgt AND e.u = r.b)
SELECT src, tgt, a AS corr_id, min(b) AS component FROM reach GROUP BY src, tgt, a"""


@query("connected_components", COMPONENT_SQL)
def connected_components(spark, sf):
    corr = corr_table(spark, sf)
    edges = cg.compatible_pairs(corr, PAIR, LEVELS, "point").filter("min_level = 0")

    out = components.connected_components(corr.select(*PAIR, F.col("corr_id").alias("id")), edges.select(*PAIR, "u", "v"), keys=PAIR)
    return out.select(*PAIR, F.col("id").alias("corr_id"), "component")
