"""Clustering on curved voxels: range, pitch and azimuth cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components, sized
from .pairs import by_size
from .spatial import nearest

CELL = ["ring", "pitch_bin", "azimuth_bin"]


@dataclass(frozen=True)
class PolarRule:
    start: float = 0.35
    shrink: float = 0.0004
    pitch: float = 1.2
    azimuth: float = 1.2
    min_range: float = 2.0
    max_range: float = 80.0
    min_size: int = 20


def to_polar(points: DataFrame, rule: PolarRule) -> DataFrame:
    """Range, pitch and azimuth (0, 360] of the points strictly inside the range limits."""
    x, y, z = (F.col(c) for c in "xyz")
    df = points.withColumn("range", F.sqrt(x * x + y * y + z * z))
    df = df.filter((F.col("range") < rule.max_range) & (F.col("range") > rule.min_range))
    turn = F.degrees(F.atan2(y, x))
    return df.withColumns({"pitch": F.degrees(F.asin(z / F.col("range"))), "azimuth": F.when(turn > 0, turn).otherwise(turn + 360.0)})


def ring_index(d: Column, rule: PolarRule) -> Column:
    """Ring of a distance ``d`` past the nearest point; each ring is narrower than the last.

    Ring m ends at m start - shrink m (m + 1) / 2, so the index is the root of a quadratic,
    corrected by one where rounding puts it on the wrong side.
    """
    s, g = rule.start, rule.shrink

    def end(m: Column) -> Column:
        return m * F.lit(s) - F.lit(g) * m * (m + 1.0) / 2.0

    if g == 0:
        m = F.floor(d / F.lit(s))
    else:
        b = s - g / 2.0
        m = F.floor((b - F.sqrt(F.greatest(F.lit(b * b) - 2.0 * g * d, F.lit(0.0)))) / F.lit(g))
    m = F.when(end(m.cast("double")) > d, m - 1).when(end(m.cast("double") + 1.0) <= d, m + 1).otherwise(m)
    return F.greatest(m, F.lit(0)).cast("int")


def with_polar_cell(polar: DataFrame, keys: list[str], rule: PolarRule) -> DataFrame:
    """Curved-voxel key; rings and pitch bins start at each cloud's smallest value."""
    lows = polar.groupBy(*keys).agg(F.min("range").alias("_r"), F.min("pitch").alias("_p"))
    turns = max(int(round(360.0 / rule.azimuth)), 1)
    df = polar.join(lows, keys)
    return df.withColumns({
        "ring": ring_index(F.col("range") - F.col("_r"), rule),
        "pitch_bin": F.round((F.col("pitch") - F.col("_p")) / F.lit(rule.pitch)).cast("int"),
        "azimuth_bin": F.pmod(F.round(F.col("azimuth") / F.lit(rule.azimuth)).cast("int"), F.lit(turns)),
    }).drop("_r", "_p")


def adjacent(cells: DataFrame, keys: list[str], rule: PolarRule) -> DataFrame:
    """Neighbouring occupied curved voxels, each pair once; azimuth wraps around.

    Cells of one ring and pitch bin, at most one per azimuth bin, travel as one row.
    """
    turns = max(int(round(360.0 / rule.azimuth)), 1)
    arcs = cut_lineage(cells.groupBy(*keys, "ring", "pitch_bin").agg(F.collect_set("azimuth_bin").alias("_v")))
    # a pair is met from its smaller end: the next arcs, or the own one
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = arcs.select(*keys, F.struct("ring", "pitch_bin").alias("_at"), F.col("_v").alias("_u"), F.explode(steps).alias("_o")).select(
        *keys, "_at", "_u", (F.col("_at.ring") + F.col("_o.a")).alias("ring"), (F.col("_at.pitch_bin") + F.col("_o.b")).alias("pitch_bin"))
    both = near.join(arcs, [*keys, "ring", "pitch_bin"]).withColumn("_a", F.explode("_u")).drop("_u").withColumn("_v", F.explode("_v"))
    own = (F.col("_at.ring") == F.col("ring")) & (F.col("_at.pitch_bin") == F.col("pitch_bin"))
    gap = F.abs(F.col("_a") - F.col("_v"))
    both = both.filter(((gap <= 1) | (gap == turns - 1)) & (~own | (F.col("_a") < F.col("_v"))))
    u = F.struct("_at.ring", "_at.pitch_bin", F.col("_a").alias("azimuth_bin"))
    return both.select(*keys, u.alias("u"), F.struct("ring", "pitch_bin", F.col("_v").alias("azimuth_bin")).alias("v"))


def cluster(celled: DataFrame, keys: list[str], rule: PolarRule) -> DataFrame:
    """Label points with the component of their curved voxel."""
    cells = cut_lineage(celled.select(*keys, *CELL).distinct())
    turns = max(int(round(360.0 / rule.azimuth)), 1)
    pitches = int(180.0 / rule.pitch) + 2

    def number(cell: str = "") -> Column:  # in the order of (ring, pitch, azimuth)
        ring, pitch, azimuth = (F.col(cell + c) for c in CELL)
        return (ring.cast("long") * pitches + pitch) * turns + azimuth

    edges = adjacent(cells, keys, rule).select(*keys, number("u.").alias("u"), number("v.").alias("v"))
    labels = connected_components(cells.select(*keys, number().alias("id")), edges, keys=keys)
    root = F.col("component")
    cell = F.struct(*[c.cast("int").alias(n) for n, c in zip(CELL, (F.floor(root / (pitches * turns)), F.pmod(F.floor(root / turns), F.lit(pitches)), F.pmod(root, F.lit(turns))))])
    return celled.withColumn("id", number()).join(labels.select(*keys, "id", cell.alias("cluster")), [*keys, "id"]).drop("id")


def segment(points: DataFrame, keys: list[str], rule: PolarRule) -> DataFrame:
    """Clustered points of large enough clusters."""
    labelled = cluster(with_polar_cell(to_polar(points, rule), keys, rule), keys, rule)
    return labelled.join(sized(labelled, [*keys, "cluster"], rule.min_size).drop("size"), [*keys, "cluster"], "left_semi")


_AXES = ("x", "y", "z")


def _cell_pairs(boxes: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Pairs u < v of cells that may hold points within the tolerance; ``sure`` where all of them are.

    Cells are a little narrower than the tolerance over the root of three, so partners lie at
    most two cells away.  Those of keys with few cells are looked for among all of the key.
    """
    def end(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("cell").alias(name), *[F.col(e + a).alias(f"{name}_{e}{a}") for e in ("lo", "hi") for a in _AXES])

    gap = [F.greatest(F.col(f"u_lo{a}") - F.col(f"v_hi{a}"), F.col(f"v_lo{a}") - F.col(f"u_hi{a}"), F.lit(0.0)) for a in _AXES]
    far = [F.greatest(F.col(f"u_hi{a}") - F.col(f"v_lo{a}"), F.col(f"v_hi{a}") - F.col(f"u_lo{a}")) for a in _AXES]
    low, high = (sum((c * c for c in cs[1:]), cs[0] * cs[0]) for cs in (gap, far))
    reach = tolerance * tolerance
    beside = F.lit(True)
    for a in _AXES:
        u, v = F.col("u." + a), F.col("v." + a)
        beside = beside & (u.eqNullSafe(v) | (F.abs(u - v) <= 2))
    small, large = by_size([boxes, boxes], keys)
    both = end(small[0], "u").join(end(small[1], "v"), keys).filter((low <= reach) & (F.col("u") < F.col("v")) & beside)
    if large is not None:
        steps = F.sequence(F.lit(-2), F.lit(2))
        around = F.explode(F.flatten(F.transform(steps, lambda a: F.flatten(F.transform(steps, lambda b: F.transform(
            steps, lambda c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))))))))
        one = end(large[0], "u").select("*", around.alias("_o"))
        one = one.withColumn("v", F.struct(*[(F.col("u." + a) + F.col("_o." + a)).alias(a) for a in _AXES])).filter(F.col("u") < F.col("v")).drop("_o")
        both = both.unionByName(one.join(end(large[1], "v"), [*keys, "v"]))
    return both.filter(low <= reach).withColumn("sure", high <= reach)


def _touching(celled: DataFrame, pairs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Pairs of cells with two points within the tolerance, by the nearest point of one for each of the other.

    Only points within the tolerance of the other cell's box take part.
    """
    pair = [*keys, "u", "v"]

    def side(own: str, other: str, name: str) -> DataFrame:
        rows = celled.withColumnRenamed("cell", own).join(pairs, [*keys, own])
        gap = [F.greatest(F.col(f"{other}_lo{a}") - F.col(a), F.col(a) - F.col(f"{other}_hi{a}"), F.lit(0.0)) for a in _AXES]
        near = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= tolerance * tolerance
        return rows.filter(near).select(*pair, F.col("id").alias(name), *_AXES)

    best = nearest(side("u", "v", "qid"), side("v", "u", "tid"), pair)
    return best.filter(F.col("d2") <= tolerance * tolerance).select(*pair).distinct()


def euclidean_cluster(points: DataFrame, keys: list[str], tolerance: float = 1.0, min_size: int = 1) -> DataFrame:
    """Components of points closer than ``tolerance``; ``points`` have ``id``.

    All points of one cell, whose diagonal is the tolerance, belong together, and so do those
    of two cells whose boxes lie within it.  Points are compared only for pairs of cells
    that boxes do not decide and that are not joined by way of others, so a cell full of
    points costs one pass over them.
    """
    side = tolerance / 3.0 ** 0.5 * (1.0 - 1e-9)
    cell = F.struct(*[F.floor(F.col(c) / F.lit(side)).alias(c) for c in _AXES])
    celled = cut_lineage(points.withColumn("cell", cell))
    boxes = celled.groupBy(*keys, "cell").agg(*[f(a).alias(e + a) for e, f in (("lo", F.min), ("hi", F.max)) for a in _AXES])
    boxes = cut_lineage(boxes)
    pairs = cut_lineage(_cell_pairs(boxes, keys, tolerance))

    nodes = boxes.select(*keys, F.col("cell").alias("id"))
    sure = pairs.filter("sure").select(*keys, "u", "v")
    groups = cut_lineage(connected_components(nodes, sure, keys=keys))
    open_pairs = pairs.filter("not sure")
    for end in "uv":
        at = groups.select(*keys, F.col("id").alias(end), F.col("component").alias("_" + end))
        open_pairs = open_pairs.join(at, [*keys, end])
    open_pairs = cut_lineage(open_pairs.filter(F.col("_u") != F.col("_v")).drop("_u", "_v", "sure"))
    links = _touching(celled.select(*keys, "cell", "id", *_AXES), open_pairs, keys, tolerance)
    labels = connected_components(nodes, sure.unionByName(links), keys=keys)
    found = labels.select(*keys, F.col("id").alias("cell"), F.col("component").alias("cluster"))
    out = celled.join(found, [*keys, "cell"]).drop("cell")
    return out.join(sized(out, [*keys, "cluster"], min_size).drop("size"), [*keys, "cluster"], "left_semi")
