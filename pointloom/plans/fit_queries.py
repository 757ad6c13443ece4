"""Queries for cliques and transform fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cliques, consensus, fitting
from ..operators import compatibility as cg
from ..session import cut_lineage
from .correspondences import PAIR
from .graph_queries import CORR_SQL, LEVELS, POINT_SQL, WEIGHT_SQL, corr_table, weight_table
from .registry import query
from .tables import eigen_sql
from .voxel_queries import rounded

CLIQUE_CTE = """nb AS (SELECT src, tgt, v, list(u) AS ins FROM {edges} GROUP BY src, tgt, v),
cl AS (SELECT src, tgt, [u, v] AS m, v AS last FROM {edges}
  UNION ALL SELECT c.src, c.tgt, list_append(c.m, nb.v), nb.v FROM cl c
  JOIN nb ON nb.src = c.src AND nb.tgt = c.tgt AND nb.v > c.last AND list_has_all(nb.ins, c.m))"""


@query("max_clique", f"""WITH RECURSIVE {POINT_SQL}, e0 AS (SELECT src, tgt, u, v FROM ed WHERE min_level <= 1),
{CLIQUE_CTE.format(edges='e0')}
SELECT src, tgt, CAST(len(m) AS INT) AS size, array_to_string(m, ',') AS members FROM (
  SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY len(m) DESC, m) AS r FROM cl) WHERE r = 1""")
def max_clique(spark, sf):
    edges = cg.compatible_pairs(corr_table(spark, sf), PAIR, LEVELS, "point").filter("min_level <= 1")
    out = cliques.max_clique(cut_lineage(edges), PAIR)
    return out.select(*PAIR, "size", F.array_join("members", ",").alias("members"))


@query("max_clique_levels", f"""WITH RECURSIVE {POINT_SQL},
el AS (SELECT src, tgt, level, u, v FROM ed JOIN range(4) r(level) ON r.level >= min_level),
nb AS (SELECT src, tgt, level, v, list(u) AS ins FROM el GROUP BY src, tgt, level, v),
cl AS (SELECT src, tgt, level, [u, v] AS m, v AS last FROM el
  UNION ALL SELECT c.src, c.tgt, c.level, list_append(c.m, nb.v), nb.v FROM cl c
  JOIN nb ON nb.src = c.src AND nb.tgt = c.tgt AND nb.level = c.level AND nb.v > c.last AND list_has_all(nb.ins, c.m))
SELECT src, tgt, level, max(len(m)) AS size FROM cl GROUP BY src, tgt, level""")
def max_clique_levels(spark, sf):
    edges = cut_lineage(cg.compatible_pairs(corr_table(spark, sf), PAIR, LEVELS, "point"))
    out = cliques.max_clique_levels(edges, PAIR, len(LEVELS))
    return out.select(*PAIR, F.col("level").cast("long").alias("level"), F.col("size").cast("long").alias("size"))


MAXIMAL_SQL = f"""WITH RECURSIVE {POINT_SQL}, e0 AS (SELECT src, tgt, u, v FROM ed WHERE min_level <= 1),
{CLIQUE_CTE.format(edges='e0')},
full_nb AS (SELECT src, tgt, u AS x, list(v) AS ns FROM (SELECT src, tgt, u, v FROM e0 UNION ALL SELECT src, tgt, v, u FROM e0) GROUP BY src, tgt, u),
mx AS (SELECT src, tgt, m FROM cl c WHERE len(m) >= 3 AND NOT EXISTS (
  SELECT 1 FROM full_nb f WHERE f.src = c.src AND f.tgt = c.tgt AND list_has_all(f.ns, c.m)))"""


def maximal_table(spark, sf):
    corr = corr_table(spark, sf)
    edges = cg.compatible_pairs(corr, PAIR, LEVELS, "point").filter("min_level <= 1")
    d = F.col("src_len") - F.col("tgt_len")
    edges = cut_lineage(edges.select(*PAIR, "u", "v", (1.0 - d * d).alias("w")))
    return corr, edges, cliques.maximal_cliques(edges, PAIR)


@query("maximal_cliques", MAXIMAL_SQL + " SELECT src, tgt, array_to_string(m, ',') AS members FROM mx")
def maximal_cliques(spark, sf):
    _, _, found = maximal_table(spark, sf)
    return found.select(*PAIR, F.array_join("members", ",").alias("members"))


@query("best_clique_per_node", MAXIMAL_SQL + """,
pr AS (SELECT src, tgt, m, a.x AS x, b.x AS y FROM mx, unnest(m) AS a(x), unnest(m) AS b(x) WHERE a.x < b.x),
wt AS (SELECT pr.src, pr.tgt, m, round(sum(1.0 - (sl - tl) * (sl - tl)), 9) AS w FROM pr JOIN ed ON ed.src = pr.src AND ed.tgt = pr.tgt
   AND ed.u = pr.x AND ed.v = pr.y GROUP BY pr.src, pr.tgt, m),
nd AS (SELECT src, tgt, a.x AS node, m, w FROM wt, unnest(m) AS a(x))
SELECT DISTINCT src, tgt, array_to_string(m, ',') AS members, round(w, 5) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY src, tgt, node ORDER BY w DESC, m) AS r FROM nd) WHERE r = 1""")
def best_clique_per_node(spark, sf):
    _, edges, found = maximal_table(spark, sf)
    best = cliques.best_cliques_per_node(found, edges, PAIR)
    return best.select(*PAIR, F.array_join("members", ",").alias("members"), F.round("weight", 5).alias("weight"))


@query("clique_hypotheses")
def clique_hypotheses(spark, sf):
    corr, edges, found = maximal_table(spark, sf)
    best = cliques.best_cliques_per_node(cut_lineage(found), edges, PAIR)
    out = fitting.clique_hypotheses(corr, best, PAIR, 2.0)
    return out.select(*PAIR, "members", F.round("score", 5).alias("score"))


@query("kabsch_sums", f"""WITH {CORR_SQL}
SELECT src, tgt, count(*) AS n, {', '.join(f"round(sum(s{a}), 4) AS s{a}, round(sum(t{a}), 4) AS t{a}" for a in 'xyz')},
  {', '.join(f"round(sum(s{a} * t{b}), 3) AS h{a}{b}" for a in 'xyz' for b in 'xyz')} FROM ct GROUP BY src, tgt""")
def kabsch_sums(spark, sf):
    m = corr_table(spark, sf).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), *fitting.moment_aggs())
    return m.select(
        *PAIR, "n", *[F.round(f"m_{s}{a}", 4).alias(s + a) for s in "st" for a in "xyz"],
        *[F.round(f"m_h{i}{j}", 3).alias("h" + a + b) for i, a in enumerate("xyz") for j, b in enumerate("xyz")],
    )


def _optimum_sql() -> str:
    """Least possible mean squared residual of a rigid fit, from the singular values of the covariance of both sides.

    No rotation is built: the squared singular values are the eigenvalues of H'H, and the
    smallest counts negative where a reflection would fit better.
    """
    h = {(i, j): f"h{i}{j}" for i in "xyz" for j in "xyz"}
    gram = {p + q: " + ".join(f"{h[r, p]} * {h[r, q]}" for r in "xyz") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")}
    det = ("hxx * (hyy * hzz - hyz * hzy) - hxy * (hyx * hzz - hyz * hzx) + hxz * (hyx * hzy - hyy * hzx)")
    return f"""WITH {CORR_SQL},
kc AS (SELECT src, tgt, count(*) AS n, {', '.join(f'avg({s}{a}) AS m{s}{a}' for s in 'st' for a in 'xyz')} FROM ct GROUP BY src, tgt),
kd AS (SELECT ct.src, ct.tgt, any_value(n) AS n, {', '.join(f'sum((s{i} - ms{i}) * (t{j} - mt{j})) AS h{i}{j}' for i in 'xyz' for j in 'xyz')},
  sum({' + '.join(f'({s}{a} - m{s}{a}) * ({s}{a} - m{s}{a})' for s in 'st' for a in 'xyz')}) AS spread FROM ct JOIN kc USING (src, tgt) GROUP BY ct.src, ct.tgt),
kg AS (SELECT src, tgt, n, spread, {det} AS det, {', '.join(f'{e} AS {c}' for c, e in gram.items())} FROM kd), {eigen_sql('ke', 'kg')}
SELECT src, tgt, n, true AS proper, round(sqrt(greatest(spread - 2.0 * (sqrt(greatest(l2, 0.0)) + sqrt(greatest(l1, 0.0)) + sign(det) * sqrt(greatest(l0, 0.0))), 0.0) / n), 3) AS rms FROM ke"""


@query("kabsch_fit", _optimum_sql())
def kabsch_fit(spark, sf):
    """Residual of the fitted pose, and whether its rotation is one: what no other pose can beat."""
    corr = corr_table(spark, sf)
    fit = cut_lineage(fitting.fit_pose(corr, PAIR))
    tf = F.col("tf")
    cells = [[tf[4 * i + j] for j in range(3)] for i in range(3)]
    square = [F.abs(sum((cells[k][i] * cells[k][j] for k in range(3)), F.lit(0.0)) - float(i == j)) for i in range(3) for j in range(i, 3)]
    det = sum((cells[0][i] * (cells[1][(i + 1) % 3] * cells[2][(i + 2) % 3] - cells[1][(i + 2) % 3] * cells[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))
    proper = (F.greatest(*square) < 1e-9) & (det > 0)
    rows = corr.join(fit.select(*PAIR, "n", "tf", proper.alias("proper")), PAIR)
    out = rows.groupBy(*PAIR, "n", "proper").agg(F.avg(fitting.residual2("tf")).alias("_m"))
    return out.select(*PAIR, F.col("n").cast("long").alias("n"), "proper", F.round(F.sqrt("_m"), 3).alias("rms"))


@query("yaw_fit", f"""WITH {CORR_SQL}
SELECT src, tgt, round(atan2(sum(sx * ty) - sum(sy * tx), sum(sx * tx) + sum(sy * ty)), 6) AS yaw FROM ct GROUP BY src, tgt""")
def yaw_fit(spark, sf):
    out = fitting.fit_pose(corr_table(spark, sf), PAIR, "yaw")
    return out.select(*PAIR, F.round(F.atan2(F.col("tf")[4], F.col("tf")[0]), 6).alias("yaw"))


def _axis_sql(a: str) -> str:
    return f"""SELECT src, tgt, '{a}' AS axis, round((t{a} - s{a}) * 1024) AS x FROM ct"""


@query("tls_translation", f"""WITH {CORR_SQL},
tr AS ({' UNION ALL '.join(_axis_sql(a) for a in 'xyz')}),
te AS (SELECT src, tgt, axis, x - 1024.0 AS h, -1 AS o, x, 1 AS s FROM tr UNION ALL SELECT src, tgt, axis, x + 1024.0, 1, x, -1 FROM tr),
tg AS (SELECT src, tgt, axis, h, o, sum(s) AS card, sum(s * x) AS sx, sum(s * x * x) AS sxx FROM te GROUP BY ALL),
tc AS (SELECT src, tgt, axis, h, o, sum(card) OVER w AS card, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx FROM tg
   WINDOW w AS (PARTITION BY src, tgt, axis ORDER BY h, o ROWS UNBOUNDED PRECEDING)),
tk AS (SELECT tc.*, sx / card AS est, card * (sx / card) * (sx / card) + sxx - 2.0 * sx * (sx / card) + (n - card) * 1024.0 AS cost
   FROM tc JOIN (SELECT src, tgt, axis, count(*) AS n FROM tr GROUP BY ALL) USING (src, tgt, axis) WHERE card > 0),
best AS (SELECT src, tgt, axis, est FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, axis ORDER BY round(cost, 3), h, o) AS rn FROM tk) WHERE rn = 1),
tm AS (SELECT ct.src, ct.tgt, ct.corr_id, bool_and(abs(round(CASE axis WHEN 'x' THEN (tx - sx) WHEN 'y' THEN (ty - sy) ELSE (tz - sz) END * 1024) - est) <= 1024.0) AS inlier
   FROM ct JOIN best USING (src, tgt) GROUP BY ALL)
SELECT src, tgt, corr_id, inlier FROM tm""")
def tls_translation(spark, sf):
    corr = corr_table(spark, sf)
    ints = corr.select(*PAIR, "corr_id", *[F.lit(0.0).alias("s" + a) for a in "xyz"],
                       *[F.round((F.col("t" + a) - F.col("s" + a)) * 1024).alias("t" + a) for a in "xyz"])
    _, masked = consensus.tls_translation(ints, PAIR, 1024.0, 3)
    return masked.select(*PAIR, "corr_id", "inlier")


def clique_chain(spark, sf, planar: bool):
    """Consecutive differences along the largest clique of every pair."""
    corr = corr_table(spark, sf)
    edges = cut_lineage(cg.compatible_pairs(corr, PAIR, LEVELS, "point"))
    best = cliques.max_clique(edges, PAIR).select(*PAIR, F.explode("members").alias("corr_id"))
    chained = cg.chain(corr.join(best, [*PAIR, "corr_id"]), PAIR)
    flat = {"z"} if planar else set()
    cells = [(F.lit(0.0) if a in flat else F.col("d" + s + a)).alias(s + a) for s in "st" for a in "xyz"]
    return chained.select(*PAIR, "corr_id", *cells)


@query("gnc_rotation")
def gnc_rotation(spark, sf):
    poses, rows = fitting.gnc_fit(clique_chain(spark, sf, False), PAIR, 2.0, "rotation")
    n = rows.groupBy(*PAIR).agg(F.count_if("inlier").alias("inliers"))
    return poses.join(n, PAIR).select(*PAIR, "inliers", F.transform("tf", lambda v: F.round(v, 4)).alias("tf"))


@query("gnc_yaw")
def gnc_yaw(spark, sf):
    poses, rows = fitting.gnc_fit(clique_chain(spark, sf, True), PAIR, 2.0, "yaw", inlier_weight=0.4)
    n = rows.groupBy(*PAIR).agg(F.count_if("inlier").alias("inliers"))
    return poses.join(n, PAIR).select(*PAIR, "inliers", F.round(F.atan2(F.col("tf")[4], F.col("tf")[0]), 4).alias("yaw"))


@query("ransac_fit")
def ransac_fit(spark, sf):
    out = fitting.ransac_fit(corr_table(spark, sf), PAIR, 3.0)
    return out.select(*PAIR, "inliers", "converged", F.transform("tf", lambda v: F.round(v, 4)).alias("tf"))
