"""Queries for neighbour joins, verification and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.linalg import SYM, cols, mahalanobis, rigid_array
from ..operators import evaluate, spatial, verify, voxels
from ..operators import compatibility as cg
from ..session import cut_lineage
from ..sources.poses import neighbour_frames
from . import tables
from .correspondences import PAIR
from .graph_queries import CORR_SQL, corr_table
from .registry import query
from .tables import POINTS_SQL, eigen_sql, gauss_sql, normal_sql
from .voxel_queries import FEATURE_SQL, PAIR_SQL, VOX_SQL, cloud_pairs, features, rounded

KERNELS = ("huber", "cauchy", "tukey", "geman_mcclure", "tls", "dcs")


@query("robust_kernels", """WITH r AS (SELECT event_id, value AS r, CAST(41.3 AS DOUBLE) AS c FROM events)
SELECT event_id, round(CASE WHEN abs(r) <= c THEN r * r / 2 ELSE c * (abs(r) - c / 2) END, 6) AS huber,
  round(c * c * ln(1 + r * r / (c * c)), 6) AS cauchy,
  round(CASE WHEN abs(r) <= c THEN c * c / 6 * (1 - pow(1 - r * r / (c * c), 3)) ELSE c * c / 6 END, 6) AS tukey,
  round(r * r / (2 * (c * c + r * r)), 6) AS geman_mcclure, round(least(r * r, c * c) / 2, 6) AS tls,
  round(c * c * (1 - exp(-r * r / (2 * c * c))), 6) AS dcs FROM r""")
def robust_kernels(spark, sf):
    ev = tables.read(spark, sf, "events")
    return ev.select("event_id", *[F.round(scalar.robust_kernel(F.col("value"), 41.3, k), 6).alias(k) for k in KERNELS])


@query("radius_neighbours", f"""WITH {FEATURE_SQL}
SELECT a.cloud, a.id AS a, b.id AS b, round((b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz), 5) AS d2
FROM feat a JOIN feat b ON a.cloud = b.cloud AND (b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz) <= 324.0""")
def radius_neighbours(spark, sf):
    f = features(spark, sf).select("cloud", "id", *[F.col("m" + c).alias(c) for c in "xyz"])
    return rounded(spatial.radius_pairs(f, f, ["cloud"], 18.0), ["d2"], 5)


def shift_candidates(pairs):
    """Three trial translations per pair."""
    rot = tuple(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    k = F.col("level")
    tf = rigid_array(rot, (k * 1.5, k * -0.75, F.lit(0.0)))
    return pairs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("tf", tf)


def verify_inputs(spark, sf):
    pts = tables.points(spark, sf)
    pairs = cut_lineage(cloud_pairs(spark, sf))
    samples = voxels.sample_per_voxel(pts, ["cloud"], 16.0, 5, ["pid", "x", "y", "z"])
    samples = samples.withColumn("sid", F.struct("pid", "x", "y", "z")).select(F.col("cloud").alias("src"), "sid", "x", "y", "z")
    vox = voxels.voxel_gaussians(pts, ["cloud"], 16.0, 10, 1.6)
    kind = F.when(F.col("planar"), F.lit("Plane")).otherwise(F.lit("Cluster"))
    targets = vox.select(
        F.col("cloud").alias("tgt"), F.struct(*voxels.KEY).alias("tid"), *[F.col("m" + c).alias(c) for c in "xyz"],
        kind.alias("kind"), *[F.col("n" + c).alias("a" + c) for c in "xyz"],
    )
    return pairs.join(samples, "src"), pairs.join(targets, "tgt"), shift_candidates(pairs)


SAMPLE_SQL = f"""{VOX_SQL}, {PAIR_SQL},
sr AS (SELECT *, row_number() OVER (PARTITION BY cloud, vx, vy, vz ORDER BY pid, x, y, z) - 1 AS pos,
             count(*) OVER (PARTITION BY cloud, vx, vy, vz) AS cnt FROM vox),
smp AS (SELECT cloud, pid, x, y, z FROM sr WHERE cnt <= 5 OR (pos % greatest(cnt // 5, 1) = 0 AND pos // greatest(cnt // 5, 1) < 5)),
{gauss_sql('tg0', 'vox', 'cloud, vx, vy, vz')}, {eigen_sql('te', 'tg0')}, {normal_sql('tn', 'te')},
mv AS (SELECT p.src, p.tgt, k.level, s.pid, s.x AS sx0, s.y AS sy0, s.z AS sz0, s.x + k.level * CAST(1.5 AS DOUBLE) AS x, s.y + k.level * CAST(-0.75 AS DOUBLE) AS y, s.z AS z
  FROM prs p JOIN smp s ON s.cloud = p.src, range(3) k(level)),
nn AS (SELECT mv.*, t.mx, t.my, t.mz, t.nx, t.ny, t.nz, t.n >= 10 AND t.l1 >= CAST(1.6 AS DOUBLE) * greatest(t.l0, 0.0) AS planar,
   (t.mx - x) * (t.mx - x) + (t.my - y) * (t.my - y) + (t.mz - z) * (t.mz - z) AS d2,
   row_number() OVER (PARTITION BY mv.src, mv.tgt, mv.level, mv.pid, mv.sx0, mv.sy0, mv.sz0 ORDER BY (t.mx - x) * (t.mx - x) + (t.my - y) * (t.my - y) + (t.mz - z) * (t.mz - z), t.vx, t.vy, t.vz) AS r
   FROM mv JOIN tn t ON t.cloud = mv.tgt)"""


@query("nearest_centres", f"WITH {SAMPLE_SQL} SELECT src, tgt, level, pid, round(sx0, 6) AS x, round(sqrt(d2), 5) AS dist FROM nn WHERE r = 1")
def nearest_centres(spark, sf):
    samples, targets, candidates = verify_inputs(spark, sf)
    moved = samples.join(candidates, PAIR)
    q = moved.select(*PAIR, F.struct("level", "sid").alias("qid"), (F.col("x") + F.col("tf")[3]).alias("x"),
                     (F.col("y") + F.col("tf")[7]).alias("y"), "z")
    out = spatial.nearest(q, targets.select(*PAIR, "tid", "x", "y", "z"), PAIR)
    return out.select(*PAIR, F.col("qid.level").cast("long").alias("level"), F.col("qid.sid.pid").alias("pid"),
                      F.round("qid.sid.x", 6).alias("x"), F.round(F.sqrt("d2"), 5).alias("dist"))


SCORE_SQL = f"""{SAMPLE_SQL},
res AS (SELECT *, CASE WHEN planar THEN (x - mx) * nx + (y - my) * ny + (z - mz) * nz ELSE sqrt(d2) END AS rr FROM nn WHERE r = 1),
scr AS (SELECT src, tgt, level, avg(CAST(256 AS DOUBLE) * (1.0 - exp(-(rr * rr) / CAST(512 AS DOUBLE)))) AS score, count(*) AS n FROM res GROUP BY src, tgt, level)"""


@query("candidate_scores", f"WITH {SCORE_SQL} SELECT src, tgt, level, round(score, 4) AS score, n FROM scr")
def candidate_scores(spark, sf):
    samples, targets, candidates = verify_inputs(spark, sf)
    s = verify.score_candidates(samples, targets, candidates, PAIR, "dcs", 16.0)
    return s.select(*PAIR, F.col("level").cast("long").alias("level"), F.round("score", 4).alias("score"), "n")


@query("nn_verify", f"""WITH {SCORE_SQL} SELECT src, tgt, level, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY round(score, 7), level) AS r FROM scr) WHERE r = 1""")
def nn_verify(spark, sf):
    samples, targets, candidates = verify_inputs(spark, sf)
    candidates = cut_lineage(verify.drop_near_repeats(candidates, PAIR))
    s = verify.score_candidates(samples, targets, candidates, PAIR, "dcs", 16.0)
    best = verify.best_candidate(s, candidates, PAIR, 7)
    return best.select(*PAIR, F.col("level").cast("long").alias("level"), F.round("score", 4).alias("score"))


@query("inliers_by_class", f"""WITH {CORR_SQL}
SELECT src, tgt, count(*) FILTER (class = 'Plane') AS plane_inliers, count(*) FILTER (class = 'Line') AS line_inliers,
  count(*) FILTER (class = 'Cluster') AS cluster_inliers FROM ct
WHERE sqrt((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz)) < 5.0 GROUP BY src, tgt""")
def inliers_by_class(spark, sf):
    corr = corr_table(spark, sf)
    d = [F.col("s" + a) - F.col("t" + a) for a in "xyz"]
    near = corr.filter(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < 5.0)
    return verify.inliers_by_class(near, PAIR)


def identity_truth(df):
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    return df.select(*PAIR, F.array(*[F.lit(v) for v in eye]).alias("truth"))


PRECISION_SQL = f"""{CORR_SQL},
pm AS (SELECT src, tgt, count(*) AS matches,
  count(*) FILTER (sqrt((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz)) < 5.0) AS tp FROM ct GROUP BY src, tgt)"""


@query("match_precision", f"WITH {PRECISION_SQL} SELECT src, tgt, matches, tp, round(100.0 * tp / matches, 6) AS precision FROM pm")
def match_precision(spark, sf):
    out = evaluate.match_precision(corr_table(spark, sf), identity_truth(cloud_pairs(spark, sf)), PAIR, 5.0)
    return rounded(out, ["precision"])


@query("match_summary", f"""WITH {PRECISION_SQL} SELECT count(*) AS pairs, round(avg(100.0 * tp / matches), 6) AS precision, round(avg(tp), 6) AS tp,
  round(100.0 * avg(CASE WHEN tp >= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS success_1,
  round(100.0 * avg(CASE WHEN tp >= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS success_3 FROM pm""")
def match_summary(spark, sf):
    m = evaluate.match_precision(corr_table(spark, sf), identity_truth(cloud_pairs(spark, sf)), PAIR, 5.0)
    return rounded(evaluate.match_summary(m), ["precision", "tp", "success_1", "success_3"])


def event_results(spark, sf):
    """Events as registration results: the value is the run time, a yaw and an offset are the errors."""
    ev = tables.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")

    def yaw(angle, dx):
        return rigid_array((F.cos(angle), -F.sin(angle), F.lit(0.0), F.sin(angle), F.cos(angle), F.lit(0.0),
                            F.lit(0.0), F.lit(0.0), F.lit(1.0)), (dx, F.lit(0.0), F.lit(0.0)))

    return ev.select(
        "event_id", F.col("event_type").alias("seq"), F.col("value").alias("total_time"), k.alias("plane_inliers"),
        yaw(F.radians(F.col("value")), k / 16.0).alias("tf"), yaw(F.lit(0.05), F.lit(1.0)).alias("truth"),
    )


EVENT_SQL = """ev AS (SELECT event_id, event_type AS seq, value AS total_time, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
er AS (SELECT event_id, seq, total_time, k, degrees(acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE),
  (2 * (cos(CAST(0.05 AS DOUBLE)) * cos(radians(total_time)) + sin(CAST(0.05 AS DOUBLE)) * sin(radians(total_time))) + 1.0 - 1.0) / 2.0)))) AS rot_err, abs(k / 16.0 - 1.0) AS trans_err FROM ev),
es AS (SELECT *, rot_err < 5.0 AND trans_err < 2.0 AS success FROM er)"""


@query("pose_errors", f"WITH {EVENT_SQL} SELECT event_id, round(rot_err, 4) AS rot_err, round(trans_err, 5) AS trans_err, success FROM es")
def pose_errors(spark, sf):
    out = evaluate.with_success(event_results(spark, sf))
    return out.select("event_id", F.round("rot_err", 4).alias("rot_err"), F.round("trans_err", 5).alias("trans_err"), "success")


@query("eval_rollup", f"""WITH {EVENT_SQL}
SELECT seq, count(*) AS pairs, round(100.0 * avg(CASE WHEN success THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS success_rate,
  round(avg(total_time), 6) AS total_time_avg, round(avg(k), 6) AS plane_inliers_avg,
  round(avg(rot_err) FILTER (success), 5) AS rot_err_mae, round(stddev_pop(rot_err) FILTER (success), 5) AS rot_err_std,
  round(sqrt(avg(rot_err * rot_err) FILTER (success)), 5) AS rot_err_rmse,
  round(avg(trans_err) FILTER (success), 5) AS trans_err_mae, round(stddev_pop(trans_err) FILTER (success), 5) AS trans_err_std,
  round(sqrt(avg(trans_err * trans_err) FILTER (success)), 5) AS trans_err_rmse, grouping(seq) = 1 AS overall
FROM es GROUP BY GROUPING SETS ((), (seq))""")
def eval_rollup(spark, sf):
    out = evaluate.summarize(evaluate.with_success(event_results(spark, sf)))
    out = rounded(out, ["success_rate", "total_time_avg", "plane_inliers_avg"])
    return rounded(out, [c for c in out.columns if "_err_" in c], 5)


@query("frame_neighbour_lookup", """WITH p AS (SELECT DISTINCT o_custkey AS seq, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS frame FROM orders)
SELECT a.seq, a.frame, coalesce(b.frame, c.frame) AS partner FROM p a LEFT JOIN p b ON b.seq = a.seq AND b.frame = a.frame - 1
LEFT JOIN p c ON c.seq = a.seq AND c.frame = a.frame + 1""")
def frame_neighbour_lookup(spark, sf):
    o = tables.read(spark, sf, "orders")
    frame = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("frame")
    poses = o.select(F.col("o_custkey").alias("seq"), frame).distinct()
    return neighbour_frames(poses).select("seq", "frame", "partner")


@query("set_ops", """SELECT 'union_all' AS op, n_nationkey AS k FROM nation UNION ALL SELECT 'union_all', s_nationkey FROM supplier
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf):
    n = tables.read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    s = tables.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    c = tables.read(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    parts = [("union_all", n.unionAll(s)), ("intersect", c.intersect(s)), ("except", n.exceptAll(s).distinct())]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("op"), "k")
        out = df if out is None else out.unionAll(df)
    return out
