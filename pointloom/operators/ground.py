"""Ground segmentation on a grid of triangular cells.

The plane is cut into square cells and each square into four triangles (0: +x, 1: +y,
2: -x, 3: -y about the centre).  Vertices live on a doubled lattice: square corners at
(2r, 2c), square centres at (2r + 1, 2c + 1).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import cols, cross, dot, norm, scale, sub, with_eigenvalues, with_eigenvector
from ..functions.scalar import convex_neighbours
from ..session import cut_lineage
from .voxels import gaussians, top_k

CELL = ["row", "col", "tri"]

# corners of a triangle, as offsets on the doubled lattice from its square's low corner
VERTICES = {0: ((2, 0), (2, 2)), 1: ((2, 2), (0, 2)), 2: ((0, 2), (0, 0)), 3: ((0, 0), (2, 0))}


@dataclass(frozen=True)
class GroundRule:
    min_range: float = 2.0
    max_range: float = 80.0
    cell: float = 8.0
    low_points: int = 5
    min_points: int = 10
    seed_above: float = 0.5
    seed_below: float = 0.3
    near: float = 0.125
    below: float = 0.3
    min_nz: float = 0.94
    obstacle: float = 1.0
    normal_rate: float = 0.03
    dist_rate: float = 0.1
    refits: int = 2


def ring_filter(points: DataFrame, low: float, high: float) -> DataFrame:
    """Points strictly inside the XY ring."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return points.filter((r < high) & (r > low))


def with_cell(points: DataFrame, rule: GroundRule) -> DataFrame:
    """Square and triangle of every point."""
    side = F.lit(rule.cell)
    low = F.lit(-rule.max_range)
    df = points.withColumns({
        "row": ((F.col("x") - low) / side).cast("int"), "col": ((F.col("y") - low) / side).cast("int"),
    })
    angle = F.atan2(
        F.col("y") - (F.col("col") * side + side / 2.0 + low), F.col("x") - (F.col("row") * side + side / 2.0 + low)
    )
    q = math.pi / 4
    tri = (
        F.when((angle >= q) & (angle < 3 * q), 1).when((angle >= -q) & (angle < q), 0)
        .when((angle >= -3 * q) & (angle < -q), 3).otherwise(2)
    )
    return df.withColumn("tri", tri)


def cell_planes(points: DataFrame, keys: list[str], rule: GroundRule) -> DataFrame:
    """Plane of every filled cell after the refits, with its weight and ground flag.

    ``points`` come from :func:`with_cell`.  A refit is one aggregation of moment sums and
    one join back on the same keys, so points are shuffled by cell once.
    """
    cell = [*keys, *CELL]
    size = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= rule.min_points)
    lowest = top_k(points.select(*cell, "z"), cell, rule.low_points, [F.col("z")])
    lpr = lowest.groupBy(*cell).agg(F.avg("z").alias("lpr")).join(size, cell)
    kept = points.join(lpr, cell)
    ground = kept.filter((F.col("z") < F.col("lpr") + rule.seed_above) & (F.col("z") >= F.col("lpr") - rule.seed_below))
    planes, ok = None, None
    for step in range(rule.refits + 1):
        g = gaussians(ground, cell)
        planes = with_eigenvector(with_eigenvalues(g), "l0").withColumn("d", -dot(cols("n"), cols("m")))
        planes = planes if ok is None else planes.join(ok, cell)
        # a few hundred rows per cloud; written out so that later filters stay simple
        planes = cut_lineage(planes)
        if step == rule.refits:
            break
        ok = planes.filter(F.col("n") >= 3).select(*cell, *[F.col("n" + a).alias("p" + a) for a in "xyz"], F.col("d").alias("pd"))
        near = kept.select(*cell, "x", "y", "z").join(ok, cell)
        ground = near.filter(dot(cols("p"), cols("")) < rule.near - F.col("pd"))
        ok = ok.select(*cell)
    s0, s1, s2 = F.col("l2"), F.col("l1"), F.greatest(F.col("l0"), F.lit(0.0))
    planes = planes.filter(F.col("n") >= 3).select(
        *cell, "mx", "my", "mz", "nx", "ny", "nz", "d", ((s0 + s1) * s1 / (s0 * s2 + 0.001)).alias("weight"),
        (F.col("nz") >= rule.min_nz).alias("ground"),
    )
    return size.join(planes, cell, "left").na.fill(False, ["ground"])


def shared_corner(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Two triangles touch in a square corner or belong to one square."""
    if a[:2] == b[:2]:
        return True
    ends = [{(2 * r + p, 2 * c + q) for p, q in VERTICES[t]} for r, c, t in (a, b)]
    return bool(ends[0] & ends[1])


def neighbour_offsets(tri: int, edge_only: bool = False) -> list[tuple[int, int, int]]:
    """Offsets (row, col, tri) of the 14 touching triangles, or of the 3 that share an edge."""
    around = [(r, c, t) for r in (-1, 0, 1) for c in (-1, 0, 1) for t in range(4)]
    if not edge_only:
        return [o for o in around if o != (0, 0, tri) and shared_corner((0, 0, tri), o)]
    ends = {p for p in VERTICES[tri]}
    across = [(r, c, t) for r, c, t in around if (r, c) != (0, 0) and {(2 * r + p, 2 * c + q) for p, q in VERTICES[t]} == ends]
    return [*across, (0, 0, (tri + 1) % 4), (0, 0, (tri + 3) % 4)]


def neighbour_pairs(cells: DataFrame, keys: list[str], edge_only: bool = False) -> DataFrame:
    """Adjacent ground cells with the flag that they continue each other."""
    cell = [*keys, *CELL]
    offsets = F.coalesce(*[F.when(F.col("tri") == t, F.array(*[
        F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(o).alias("t")) for r, c, o in neighbour_offsets(t, edge_only)
    ])) for t in range(4)])
    flat = cells.filter("ground")
    names = [p + a for p in "mn" for a in "xyz"]
    left = flat.select(*keys, F.struct(*CELL).alias("a"), *[F.col(n).alias("a" + n) for n in names], F.explode(offsets).alias("_o"))
    left = left.withColumns({"row": F.col("a.row") + F.col("_o.r"), "col": F.col("a.col") + F.col("_o.c"), "tri": F.col("_o.t")})
    right = flat.select(*cell, *[F.col(n).alias("b" + n) for n in names])
    out = left.join(right, cell)
    v = {s + p: tuple(F.col(s + p + a) for a in "xyz") for s in "ab" for p in "mn"}
    return out.select(*keys, "a", F.struct(*CELL).alias("b"), convex_neighbours(v["am"], v["an"], v["bm"], v["bn"]).alias("convex"))


def traversal_schema(cells: DataFrame, keys: list[str]) -> str:
    names = [*keys, *CELL]
    return ", ".join([*(f"{k} {cells.schema[k].dataType.simpleString()}" for k in names), "depth int, rejected boolean"])


def traverse(cells: DataFrame, keys: list[str], rule: GroundRule) -> DataFrame:
    """Breadth-first walk over ground cells from the heaviest one near the sensor.

    A cell first reached over a step or a crease is rejected.  A cloud has at most
    4 (2 max_range / cell)^2 cells, whatever its number of points, so one cloud's cells
    are walked by one small function.
    """
    names = [*keys, *CELL]
    near = {t: neighbour_offsets(t) for t in range(4)}
    ego = int(rule.max_range / rule.cell)

    def passes(a, b) -> bool:
        d = [b.mx - a.mx, b.my - a.my, b.mz - a.mz]
        length = math.sqrt(sum(v * v for v in d))
        limit = length * math.sin(rule.dist_rate)
        na, nb = (a.nx, a.ny, a.nz), (b.nx, b.ny, b.nz)
        flat = max(abs(sum(p * q for p, q in zip(n, d))) for n in (na, nb)) <= limit
        return flat and sum(p * q for p, q in zip(na, nb)) >= 1.0 - math.sin(length * rule.normal_rate)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {(r.row, r.col, r.tri): r for r in pdf.sort_values(CELL).itertuples()}
        depth, rejected = {}, set()
        close = [k for k in rows if abs(k[0] - ego + 0.5) < 2.5 and abs(k[1] - ego + 0.5) < 2.5]
        queue = [max(close, key=lambda k: (rows[k].weight, [-v for v in k]))] if close else []
        depth.update((k, 0) for k in queue)
        for here in queue:
            for r, c, t in near[here[2]]:
                there = (here[0] + r, here[1] + c, t)
                if there not in rows or there in depth or there in rejected:
                    continue
                if passes(rows[here], rows[there]):
                    depth[there] = depth[here] + 1
                    queue.append(there)
                else:
                    rejected.add(there)
        out = pdf[names].copy()
        keys_of = list(zip(pdf["row"], pdf["col"], pdf["tri"]))
        out["depth"] = [-1 if k in rejected else depth.get(k, 0) for k in keys_of]
        out["rejected"] = [k in rejected for k in keys_of]
        return out

    good = cells.filter("ground").select(*names, "mx", "my", "mz", "nx", "ny", "nz", "weight")
    return good.groupBy(*keys).applyInPandas(walk, traversal_schema(good, keys))


def _vertex_list() -> Column:
    """The triangle's two corners and its centre on the doubled lattice."""
    r2, c2 = 2 * F.col("row"), 2 * F.col("col")

    def at(i: int, axis: int) -> Column:
        out = F.lit(0)
        for t, ends in VERTICES.items():
            out = F.when(F.col("tri") == t, F.lit(ends[i][axis])).otherwise(out)
        return out

    corners = [F.struct((r2 + at(i, 0)).alias("a"), (c2 + at(i, 1)).alias("b"), F.lit(i).alias("k")) for i in range(2)]
    return F.array(*corners, F.struct((r2 + 1).alias("a"), (c2 + 1).alias("b"), F.lit(2).alias("k")))


def refit_cells(cells: DataFrame, walked: DataFrame, keys: list[str], rule: GroundRule) -> DataFrame:
    """Replace every cell's plane by the one through its weighted vertex heights.

    Vertex heights are means over accepted cells, weighted by cell weight over distance.
    """
    cell = [*keys, *CELL]
    low, half = F.lit(-rule.max_range), F.lit(rule.cell / 2.0)
    used = cells.join(walked.filter(~F.col("rejected")).select(*cell), cell, "left_semi").select("*", F.explode(_vertex_list()).alias("_v"))
    x, y = low + F.col("_v.a") * half, low + F.col("_v.b") * half
    height = (-F.col("nx") * x - F.col("ny") * y - F.col("d")) / F.col("nz")
    away = F.sqrt((F.col("mx") - x) * (F.col("mx") - x) + (F.col("my") - y) * (F.col("my") - y))
    w = F.try_divide(F.col("weight"), away)
    grid = used.groupBy(*keys, F.col("_v.a").alias("a"), F.col("_v.b").alias("b")).agg(
        F.try_divide(F.sum(height * w), F.sum(w)).alias("vz")
    )
    wanted = cells.select(*cell, F.explode(_vertex_list()).alias("_v")).select(*cell, "_v.*")
    three = wanted.join(grid, [*keys, "a", "b"]).groupBy(*cell).agg(
        F.count("vz").alias("_n"),
        *[F.max(F.when(F.col("k") == k, F.struct((low + F.col("a") * half).alias("x"), (low + F.col("b") * half).alias("y"), F.col("vz").alias("z")))).alias(f"v{k}") for k in range(3)],
    ).filter(F.col("_n") == 3)
    v = [tuple(F.col(f"v{k}.{a}") for a in "xyz") for k in range(3)]
    raw = cross(sub(v[0], v[2]), sub(v[1], v[2]))
    three = three.withColumns({f"c{a}": c for a, c in zip("xyz", raw)})
    normal = scale(cols("c"), 1.0 / norm(cols("c")))
    three = three.withColumns({f"n{a}": n for a, n in zip("xyz", normal)})
    three = three.withColumns({f"m{a}": (v[0][i] + v[1][i] + v[2][i]) / 3.0 for i, a in enumerate("xyz")})
    three = three.select(*cell, *cols("m"), *cols("n"), (-dot(cols("n"), cols("m"))).alias("d"), (F.col("nz") >= rule.min_nz).alias("ground"))
    return cells.select(*cell, "points").join(three, cell, "left").na.fill(False, ["ground"])


def label_points(points: DataFrame, cells: DataFrame, keys: list[str], rule: GroundRule) -> DataFrame:
    """Label ground, outlier and non-ground points; low non-ground points are obstacles."""
    cell = [*keys, *CELL]
    planes = cells.select(*cell, *[F.col("n" + a).alias("_n" + a) for a in "xyz"], F.col("d").alias("_d"), F.col("ground").alias("_g"))
    rows = points.join(planes, cell, "left")
    over = dot(cols("_n"), cols(""))
    flat = F.coalesce(F.col("_g"), F.lit(False))
    label = (
        F.when(~flat, F.lit("nonground"))
        .when(over < -rule.below - F.col("_d"), F.lit("outlier"))
        .when(over < rule.near - F.col("_d"), F.lit("ground"))
        .otherwise(F.lit("nonground"))
    )
    low = ~flat | ((over < rule.obstacle - F.col("_d")) & (label == "nonground"))
    return rows.withColumns({"label": label, "obstacle": low}).drop("_nx", "_ny", "_nz", "_d", "_g")


def label_by_best_neighbour(points: DataFrame, cells: DataFrame, keys: list[str], rule: GroundRule) -> DataFrame:
    """Variant that lets a cell without ground borrow the plane of its heaviest edge neighbour."""
    cell = [*keys, *CELL]
    options = [F.when(F.col("tri") == t, F.array(*[
        F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c"), F.lit(o).alias("t"))
        for r, c, o in neighbour_offsets(t, edge_only=True)
    ])) for t in range(4)]
    near = cells.filter(~F.col("ground")).select(*cell, F.explode(F.coalesce(*options)).alias("_o"))
    good = cells.filter("ground").select(
        *keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("tri").alias("_t"), "weight",
        F.struct("mx", "my", "mz", "nx", "ny", "nz", "d").alias("plane"),
    )
    match = [near[k] == good[k] for k in keys] + [F.col("_o.r") == F.col("_r"), F.col("_o.c") == F.col("_c"), F.col("_o.t") == F.col("_t")]
    found = near.join(good, match).select(*[near[c] for c in cell], "weight", "plane")
    lent = found.groupBy(*cell).agg(F.max_by("plane", "weight").alias("_p"))
    names = ["mx", "my", "mz", "nx", "ny", "nz", "d"]
    out = cells.join(lent, cell, "left")
    has = ~F.col("ground") & F.col("_p").isNotNull()
    out = out.withColumns({**{c: F.when(has, F.col("_p." + c)).otherwise(F.col(c)) for c in names}, "ground": F.col("ground") | has})
    return label_points(points, out.drop("_p"), keys, rule)


def segment_ground(points: DataFrame, keys: list[str], rule: GroundRule = GroundRule()) -> DataFrame:
    """Points inside the ring with a ground label."""
    celled = with_cell(ring_filter(points, rule.min_range, rule.max_range), rule)
    cells = cut_lineage(cell_planes(celled, keys, rule))
    refit = refit_cells(cells, traverse(cells, keys, rule), keys, rule)
    return label_points(celled, refit, keys, rule)
