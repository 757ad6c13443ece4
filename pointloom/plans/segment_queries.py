"""Queries for range images, curved voxels, ground cells and plane regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ground, planes, polar, rangeimage, voxels
from ..operators.components import sized
from ..operators.pairs import parts_for
from ..session import cut_lineage
from . import tables
from .registry import query
from .tables import POINTS_SQL, eigen_sql, gauss_sql, normal_sql
from .voxel_queries import rounded

KEYS = ["cloud"]
ORDER = ["pid", "x", "y", "z"]
IMAGE = rangeimage.RangeImageRule(rows=17, cols=360, min_angle=-25.0, max_angle=25.0, row_gap=1.5, link_gap=1.0, link_rows=2,
                                  link_cols=3, skip=3, extension=3, min_range=2.0, max_range=60.0, min_size=3)
POLAR = polar.PolarRule(start=3.0, shrink=0.01, pitch=6.0, azimuth=6.0, min_range=2.0, max_range=60.0, min_size=3)
GROUND = ground.GroundRule(min_range=2.0, max_range=64.0, cell=32.0)


def centred(spark, sf, flat=1.0):
    p = tables.points(spark, sf)
    return p.select("cloud", "pid", (F.col("x") - 25.5).alias("x"), (F.col("y") - 25.0).alias("y"),
                    ((F.col("z") - 4.5) / flat).alias("z"))


def centred_sql(flat: float = 1.0) -> str:
    return f"""{POINTS_SQL},
cp AS (SELECT cloud, pid, x - CAST(25.5 AS DOUBLE) AS x, y - CAST(25 AS DOUBLE) AS y, (z - CAST(4.5 AS DOUBLE)) / CAST({flat} AS DOUBLE) AS z FROM pts)"""


PIXEL_SQL = f"""{centred_sql()},
pr AS (SELECT *, CAST(greatest(0, least(16, floor((degrees(atan2(z, sqrt(x * x + y * y))) + 25.0) / CAST(3.125 AS DOUBLE) + 0.5))) AS INT) AS row,
   CAST(-round(degrees(atan2(x, y)) - 90.0) AS INT) + 180 AS c0 FROM cp WHERE sqrt(x * x + y * y + z * z) BETWEEN 2.0 AND 60.0),
pc AS (SELECT *, CASE WHEN c0 >= 360 THEN c0 - 360 ELSE c0 END AS col FROM pr),
px AS (SELECT cloud, row, col, pid, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cloud, row, col ORDER BY pid, x, y, z) AS r
   FROM pc WHERE col BETWEEN 0 AND 359) WHERE r = 1)"""


def pixels(spark, sf):
    return rangeimage.project(centred(spark, sf), KEYS, ORDER, IMAGE)


@query("range_pixels", f"WITH {PIXEL_SQL} SELECT cloud, row, col, pid, x, y, z FROM px")
def range_pixels(spark, sf):
    return pixels(spark, sf).select("cloud", "row", "col", *ORDER)


RUN_SQL = f"""{PIXEL_SQL},
pg AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) >= CAST(1.5 AS DOUBLE)
   THEN 1 ELSE 0 END AS s FROM px WINDOW w AS (PARTITION BY cloud, row ORDER BY col)),
pn AS (SELECT *, CAST(sum(s) OVER (PARTITION BY cloud, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM pg),
rn AS (SELECT cloud, row, run, min(col) AS st, max(col) AS en, count(*) AS n, arg_min(x, col) AS hx, arg_min(y, col) AS hy,
   arg_max(x, col) AS tx, arg_max(y, col) AS ty FROM pn GROUP BY cloud, row, run)"""


def run_pixels(spark, sf):
    return rangeimage.with_runs(pixels(spark, sf), KEYS, IMAGE)


@query("runs_gaps_islands", f"WITH {RUN_SQL} SELECT cloud, row, run, st AS start, en AS \"end\", n FROM rn")
def runs_gaps_islands(spark, sf):
    return rangeimage.runs(run_pixels(spark, sf), KEYS).select("cloud", "row", "run", "start", "end", "n")


ROW_LINK_SQL = f"""{RUN_SQL},
rm AS (SELECT *, max(run) OVER (PARTITION BY cloud, row) AS many FROM rn),
rl AS (SELECT a.cloud, a.row, a.run AS a, b.run AS b FROM rm a JOIN rm b ON a.cloud = b.cloud AND a.row = b.row AND b.run BETWEEN a.run + 1 AND a.run + 3
   WHERE a.many > 2 AND sqrt((a.tx - b.hx) * (a.tx - b.hx) + (a.ty - b.hy) * (a.ty - b.hy)) < CAST(1.5 AS DOUBLE))"""


@query("run_skip_links", f"WITH {ROW_LINK_SQL} SELECT cloud, row, a, b FROM rl")
def run_skip_links(spark, sf):
    return rangeimage.row_links(rangeimage.runs(run_pixels(spark, sf), KEYS), KEYS, IMAGE)


OVERLAP_SQL = f"""{ROW_LINK_SQL},
ov AS (SELECT a.cloud, a.row AS row_a, a.run AS run_a, b.row AS row_b, b.run AS run_b, a.st AS sa, a.en AS ea, b.st AS sb, b.en AS eb,
   a.hx AS ahx, a.hy AS ahy, a.tx AS atx, a.ty AS aty, b.hx AS bhx, b.hy AS bhy, b.tx AS btx, b.ty AS bty
   FROM rn a JOIN rn b ON a.cloud = b.cloud AND b.row BETWEEN a.row - 2 AND a.row - 1 AND a.st - 3 <= b.en AND b.st <= a.en + 3)"""


@query("run_overlap_join", f"WITH {OVERLAP_SQL} SELECT cloud, row_a, run_a, row_b, run_b FROM ov")
def run_overlap_join(spark, sf):
    rs = rangeimage.runs(run_pixels(spark, sf), KEYS)
    parts = parts_for(tables.points(spark, sf), IMAGE.link_rows + 1)  # a run has a point at least
    return rangeimage.overlapping_runs(rs, KEYS, IMAGE, parts).select("cloud", "row_a", "run_a", "row_b", "run_b")


LINK_SQL = f"""{OVERLAP_SQL},
lk AS (SELECT cloud, row_a, run_a, row_b, run_b FROM ov WHERE (eb < sa AND sqrt((ahx - btx) * (ahx - btx) + (ahy - bty) * (ahy - bty)) < 1.0)
    OR (ea < sb AND sqrt((atx - bhx) * (atx - bhx) + (aty - bhy) * (aty - bhy)) < 1.0)
  UNION ALL SELECT o.cloud, o.row_a, o.run_a, o.row_b, o.run_b FROM ov o WHERE o.eb >= o.sa AND o.ea >= o.sb AND EXISTS (
    SELECT 1 FROM pn p JOIN pn q ON q.cloud = p.cloud AND q.col BETWEEN p.col - 3 AND p.col + 3 AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 1.0
    WHERE p.cloud = o.cloud AND p.row = o.row_a AND p.run = o.run_a AND q.row = o.row_b AND q.run = o.run_b))"""


@query("run_vertical_links", f"WITH {LINK_SQL} SELECT cloud, row_a, run_a, row_b, run_b FROM lk")
def run_vertical_links(spark, sf):
    pix = run_pixels(spark, sf).select("cloud", "row", "col", "run", "x", "y")
    return rangeimage.link_rows(pix, rangeimage.runs(pix, KEYS), KEYS, IMAGE)


def component_sql(nodes: str, edges: str) -> str:
    """Closure over ``edges(cloud, u, v)``; the smallest reachable node names the component."""
    return f"""es AS (SELECT cloud, u, v FROM {edges} UNION SELECT cloud, v, u FROM {edges}),
reach AS (SELECT cloud, id AS a, id AS b FROM {nodes} UNION SELECT r.cloud, r.a, e.v FROM reach r JOIN es e ON e.cloud = r.cloud AND e.u = r.b),
comp AS (SELECT cloud, a AS id, min(b) AS root FROM reach GROUP BY cloud, a)"""


@query("range_clusters", f"""WITH RECURSIVE {LINK_SQL},
nd AS (SELECT cloud, row * 1000 + run AS id FROM rn),
eg AS (SELECT cloud, row_a * 1000 + run_a AS u, row_b * 1000 + run_b AS v FROM lk UNION ALL SELECT cloud, row * 1000 + a, row * 1000 + b FROM rl),
{component_sql('nd', 'eg')}
SELECT comp.cloud, CAST(root AS INT) AS cluster, count(*) AS size FROM comp JOIN pn ON pn.cloud = comp.cloud AND pn.row * 1000 + pn.run = comp.id
GROUP BY comp.cloud, root HAVING count(*) >= 3""")
def range_clusters(spark, sf):
    pix = run_pixels(spark, sf).select("cloud", "row", "col", "run", "x", "y")
    labelled = rangeimage.cluster(pix, KEYS, IMAGE)
    named = labelled.select("cloud", (F.col("cluster.row") * 1000 + F.col("cluster.run")).alias("cluster"))
    return sized(named, ["cloud", "cluster"], IMAGE.min_size, IMAGE.max_size)


POLAR_SQL = f"""{centred_sql()},
po AS (SELECT *, sqrt(x * x + y * y + z * z) AS range FROM cp),
pf AS (SELECT *, degrees(asin(z / range)) AS pitch, CASE WHEN degrees(atan2(y, x)) > 0 THEN degrees(atan2(y, x)) ELSE degrees(atan2(y, x)) + 360.0 END AS azimuth
   FROM po WHERE range < 60.0 AND range > 2.0),
lo AS (SELECT cloud, min(range) AS lr, min(pitch) AS lp FROM pf GROUP BY cloud),
bd AS (SELECT m, m * CAST(3 AS DOUBLE) - CAST(0.01 AS DOUBLE) * m * (m + 1) / 2.0 AS e FROM range(1, 60) t(m)),
pb AS (SELECT cloud, pid, x, y, z, (SELECT count(*) FROM bd WHERE e <= range - lr) AS ring, CAST(round((pitch - lp) / 6.0) AS INT) AS pitch_bin,
   CAST(round(azimuth / 6.0) AS INT) % 60 AS azimuth_bin FROM pf JOIN lo USING (cloud))"""


def polar_cells(spark, sf):
    return polar.with_polar_cell(polar.to_polar(centred(spark, sf), POLAR), KEYS, POLAR)


@query("polar_cells", f"WITH {POLAR_SQL} SELECT cloud, pid, x, y, z, CAST(ring AS INT) AS ring, pitch_bin, azimuth_bin FROM pb")
def polar_cell_table(spark, sf):
    return polar_cells(spark, sf).select("cloud", *ORDER, *polar.CELL)


POLAR_EDGE_SQL = f"""{POLAR_SQL},
cc AS (SELECT DISTINCT cloud, ring, pitch_bin, azimuth_bin, (ring * 1000 + pitch_bin) * 1000 + azimuth_bin AS id FROM pb),
pe AS (SELECT a.cloud, a.id AS u, b.id AS v FROM cc a JOIN cc b ON a.cloud = b.cloud AND a.id < b.id AND abs(a.ring - b.ring) <= 1
   AND abs(a.pitch_bin - b.pitch_bin) <= 1 AND (abs(a.azimuth_bin - b.azimuth_bin) <= 1 OR abs(a.azimuth_bin - b.azimuth_bin) = 59))"""


@query("polar_neighbours", f"WITH {POLAR_EDGE_SQL} SELECT cloud, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM pe")
def polar_neighbours(spark, sf):
    out = polar.adjacent(polar_cells(spark, sf), KEYS, POLAR)

    def code(s):
        return ((F.col(s + ".ring") * 1000 + F.col(s + ".pitch_bin")) * 1000 + F.col(s + ".azimuth_bin")).cast("long")

    return out.select("cloud", code("u").alias("u"), code("v").alias("v"))


@query("polar_clusters", f"""WITH RECURSIVE {POLAR_EDGE_SQL}, {component_sql('cc', 'pe')}
SELECT comp.cloud, CAST(root AS BIGINT) AS cluster, count(*) AS size FROM comp JOIN pb ON pb.cloud = comp.cloud AND (pb.ring * 1000 + pb.pitch_bin) * 1000 + pb.azimuth_bin = comp.id
GROUP BY comp.cloud, root HAVING count(*) >= 3""")
def polar_clusters(spark, sf):
    celled = cut_lineage(polar_cells(spark, sf).select("cloud", *polar.CELL))
    labelled = polar.cluster(celled, KEYS, POLAR)
    code = ((F.col("cluster.ring") * 1000 + F.col("cluster.pitch_bin")) * 1000 + F.col("cluster.azimuth_bin")).cast("long")
    return sized(labelled.select("cloud", code.alias("cluster")), ["cloud", "cluster"], POLAR.min_size)


@query("euclidean_clusters", f"""WITH RECURSIVE {POINTS_SQL},
dn AS (SELECT cloud, {voxels.cell_id_sql('floor(x / 4.0)', 'floor(y / 4.0)', 'floor(z / 4.0)')} AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z
   FROM pts GROUP BY ALL),
eg AS (SELECT a.cloud, a.id AS u, b.id AS v FROM dn a JOIN dn b ON a.cloud = b.cloud AND a.id < b.id
   AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 6.25),
{component_sql('dn', 'eg')}
SELECT cloud, id, CAST(sum(1) OVER (PARTITION BY cloud, root) AS BIGINT) AS size FROM comp""")
def euclidean_clusters(spark, sf):
    small = voxels.downsample(tables.points(spark, sf), KEYS, 4.0)
    ids = voxels.cell_id("vx", "vy", "vz")
    pts = cut_lineage(small.select("cloud", ids.alias("id"), "x", "y", "z"))
    out = cut_lineage(polar.euclidean_cluster(pts, KEYS, 2.5))
    size = out.groupBy("cloud", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return out.join(size, ["cloud", "cluster"]).select("cloud", "id", "size")


def ground_sql() -> str:
    cell = "cloud, row, col, tri"
    out = [centred_sql(16.0), """gr AS (SELECT *, CAST(trunc((x + 64.0) / 32.0) AS INT) AS row, CAST(trunc((y + 64.0) / 32.0) AS INT) AS col FROM cp
   WHERE sqrt(x * x + y * y) < 64.0 AND sqrt(x * x + y * y) > 2.0),
ga AS (SELECT *, atan2(y - (col * CAST(32 AS DOUBLE) + 16.0 + -64.0), x - (row * CAST(32 AS DOUBLE) + 16.0 + -64.0)) AS ang FROM gr),
gc AS (SELECT *, CASE WHEN ang >= pi() / 4 AND ang < 3 * pi() / 4 THEN 1 WHEN ang >= -pi() / 4 AND ang < pi() / 4 THEN 0
   WHEN ang >= -3 * pi() / 4 AND ang < -pi() / 4 THEN 3 ELSE 2 END AS tri FROM ga),
gl AS (SELECT cloud, row, col, tri, avg(z) FILTER (r <= 5) AS lpr, count(*) AS points FROM (
   SELECT *, row_number() OVER (PARTITION BY cloud, row, col, tri ORDER BY z) AS r FROM gc) GROUP BY cloud, row, col, tri HAVING count(*) >= 10),
s0 AS (SELECT gc.* FROM gc JOIN gl USING (cloud, row, col, tri) WHERE z < lpr + CAST(0.5 AS DOUBLE) AND z >= lpr - CAST(0.3 AS DOUBLE))"""]
    for k in range(3):
        out += [gauss_sql(f"q{k}", f"s{k}", cell), eigen_sql(f"r{k}", f"q{k}"), normal_sql(f"t{k}", f"r{k}"),
                f"u{k} AS (SELECT {cell}, n, mx, my, mz, nx, ny, nz, l0, l1, l2, -(nx * mx + ny * my + nz * mz) AS d FROM t{k} WHERE n >= 3)"]
        if k < 2:
            out.append(f"""s{k + 1} AS (SELECT gc.* FROM gc JOIN gl USING ({cell}) JOIN u{k} USING ({cell})
   WHERE nx * x + ny * y + nz * z < CAST(0.125 AS DOUBLE) - d)""")
    out.append(f"""cells AS (SELECT {cell}, points, mx, my, mz, nx, ny, nz, d,
   (l2 + l1) * l1 / (l2 * greatest(l0, 0.0) + CAST(0.001 AS DOUBLE)) AS weight, coalesce(nz >= CAST(0.94 AS DOUBLE), false) AS ground FROM gl LEFT JOIN u2 USING ({cell}))""")
    return ",\n".join(out)


GROUND_SQL = ground_sql()


def ground_points(spark, sf):
    return ground.with_cell(ground.ring_filter(centred(spark, sf, 16.0), GROUND.min_range, GROUND.max_range), GROUND)


@query("ground_planes", f"""WITH {GROUND_SQL} SELECT cloud, row, col, tri, points, round(nz, 4) AS nz, round(d, 4) AS d, round(weight, 2) AS weight, ground FROM cells""")
def ground_planes(spark, sf):
    cells = ground.cell_planes(ground_points(spark, sf), KEYS, GROUND)
    out = cells.select("cloud", *ground.CELL, "points", "nz", "d", "weight", "ground")
    return rounded(rounded(out, ["nz", "d"], 4), ["weight"], 2)


@query("ground_labels", f"""WITH {GROUND_SQL},
lb AS (SELECT gc.cloud, gc.pid, gc.x, gc.y, gc.z, c.d, coalesce(c.ground, false) AS g, c.nx * gc.x + c.ny * gc.y + c.nz * gc.z AS o FROM gc LEFT JOIN cells c USING (cloud, row, col, tri)),
ll AS (SELECT *, CASE WHEN NOT g THEN 'nonground' WHEN o < CAST(-0.3 AS DOUBLE) - d THEN 'outlier' WHEN o < CAST(0.125 AS DOUBLE) - d THEN 'ground' ELSE 'nonground' END AS label FROM lb)
SELECT cloud, pid, x, y, z, label, NOT g OR (o < 1.0 - d AND label = 'nonground') AS obstacle FROM ll""")
def ground_labels(spark, sf):
    pts = ground_points(spark, sf)
    cells = cut_lineage(ground.cell_planes(pts, KEYS, GROUND))
    return ground.label_points(pts, cells, KEYS, GROUND).select("cloud", *ORDER, "label", "obstacle")


def _touch_sql() -> str:
    rows = [f"({t}, {r}, {c}, {o})" for t in range(4) for r, c, o in ground.neighbour_offsets(t)]
    return f"nb(tri, dr, dc, tri2) AS (VALUES {', '.join(rows)})"


@query("ground_neighbours", f"""WITH {GROUND_SQL}, {_touch_sql()},
np AS (SELECT a.cloud, a.row, a.col, a.tri, b.row AS row_b, b.col AS col_b, b.tri AS tri_b, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS same,
   sqrt((b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz)) AS len,
   abs(a.nx * (b.mx - a.mx) + a.ny * (b.my - a.my) + a.nz * (b.mz - a.mz)) AS da, abs(b.nx * (b.mx - a.mx) + b.ny * (b.my - a.my) + b.nz * (b.mz - a.mz)) AS db
   FROM cells a JOIN nb USING (tri) JOIN cells b ON b.cloud = a.cloud AND b.row = a.row + dr AND b.col = a.col + dc AND b.tri = tri2 WHERE a.ground AND b.ground)
SELECT cloud, row, col, tri, row_b, col_b, tri_b, same >= 1.0 - sin(len * CAST(0.03 AS DOUBLE)) AND da <= len * sin(CAST(0.1 AS DOUBLE)) AND db <= len * sin(CAST(0.1 AS DOUBLE)) AS convex FROM np""")
def ground_neighbours(spark, sf):
    cells = cut_lineage(ground.cell_planes(ground_points(spark, sf), KEYS, GROUND))
    out = ground.neighbour_pairs(cells, KEYS)
    return out.select("cloud", "a.*", F.col("b.row").alias("row_b"), F.col("b.col").alias("col_b"), F.col("b.tri").alias("tri_b"), "convex")


@query("ground_segmentation")
def ground_segmentation(spark, sf):
    out = ground.segment_ground(centred(spark, sf, 16.0), KEYS, GROUND)
    return out.groupBy("cloud", "label").agg(F.count(F.lit(1)).alias("points"))


REGION_SQL = f"""{POINTS_SQL},
v8 AS (SELECT *, CAST(floor(x / 8.0) AS INT) AS vx, CAST(floor(y / 8.0) AS INT) AS vy, CAST(floor(z / 8.0) AS INT) AS vz FROM pts),
{gauss_sql('h0', 'v8', 'cloud, vx, vy, vz')}, {eigen_sql('h1', 'h0')}, {normal_sql('h2', 'h1')},
pl AS (SELECT *, {voxels.cell_id_sql('vx', 'vy', 'vz')} AS id FROM h2 WHERE n >= 5 AND l1 >= CAST(3 AS DOUBLE) * greatest(l0, 0.0)),
eg AS (SELECT a.cloud, a.id AS u, b.id AS v FROM pl a JOIN pl b ON a.cloud = b.cloud AND a.id < b.id AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1
   WHERE abs((b.mx - a.mx) * a.nx + (b.my - a.my) * a.ny + (b.mz - a.mz) * a.nz) <= CAST(2 AS DOUBLE)
     AND abs((a.mx - b.mx) * b.nx + (a.my - b.my) * b.ny + (a.mz - b.mz) * b.nz) <= CAST(2 AS DOUBLE)
     AND abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) >= CAST(0.8 AS DOUBLE)),
{component_sql('pl', 'eg')}"""


def region_table(spark, sf):
    vox = cut_lineage(voxels.voxel_gaussians(tables.points(spark, sf), KEYS, 8.0, 5, 3.0))
    return vox, planes.plane_regions(vox, KEYS, 2.0, 0.8)


def _code(s: str):
    return voxels.cell_id(s + "vx", s + "vy", s + "vz")


@query("plane_regions", f"WITH RECURSIVE {REGION_SQL} SELECT cloud, id, root AS region FROM comp")
def plane_regions(spark, sf):
    _, regions = region_table(spark, sf)
    return regions.select("cloud", _code("").alias("id"), _code("region.").alias("region"))


@query("plane_features", f"""WITH RECURSIVE {REGION_SQL},
mm AS (SELECT comp.cloud, root, p.x, p.y, p.z FROM comp JOIN v8 p ON p.cloud = comp.cloud AND {voxels.cell_id_sql('p.vx', 'p.vy', 'p.vz')} = comp.id),
{gauss_sql('m0', 'mm', 'cloud, root')}
SELECT cloud, root AS region, n, round(mx, 5) AS mx, round(my, 5) AS my, round(mz, 5) AS mz, round(xx, 4) AS xx, round(yz, 4) AS yz FROM m0 WHERE n > 12""")
def plane_features(spark, sf):
    vox, regions = region_table(spark, sf)
    out = planes.plane_features(vox, regions, KEYS, 12, 1.1)
    out = out.select("cloud", _code("region.").alias("region"), "n", "mx", "my", "mz", "xx", "yz")
    return rounded(rounded(out, ["mx", "my", "mz"], 5), ["xx", "yz"], 4)


@query("plane_split", f"""WITH RECURSIVE {REGION_SQL},
sz AS (SELECT comp.cloud, root, sum(n) AS n FROM comp JOIN pl USING (cloud, id) GROUP BY comp.cloud, root HAVING sum(n) > 12),
tk AS (SELECT comp.cloud, comp.id FROM comp JOIN sz ON sz.cloud = comp.cloud AND sz.root = comp.root)
SELECT cloud, pid, x, y, z FROM v8 p WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.cloud = p.cloud AND tk.id = {voxels.cell_id_sql('p.vx', 'p.vy', 'p.vz')})""")
def plane_split(spark, sf):
    vox, regions = region_table(spark, sf)
    regions = cut_lineage(regions)
    good = planes.plane_features(vox, regions, KEYS, 12, 1.1)
    pts = voxels.with_voxel(tables.points(spark, sf), 8.0)
    return planes.without_planes(pts, regions, good, KEYS).select("cloud", *ORDER)
