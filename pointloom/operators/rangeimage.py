"""Clustering on a range image: runs along rows, then links between rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs
from .components import connected_components, sized
from .pairs import beside, parts_for
from .voxels import first_per_cell

#: Points of a pixel of a large cloud meet in so many parts first, in case one pixel holds a large share of them.
_SALTS = 16


@dataclass(frozen=True)
class RangeImageRule:
    rows: int = 64
    cols: int = 4500
    min_angle: float = -24.8
    max_angle: float = 2.0
    keep_every: int = 1
    row_gap: float = 0.4
    link_gap: float = 0.5
    link_rows: int = 3
    link_cols: int = 5
    skip: int = 5
    extension: int = 5
    min_range: float = 2.0
    max_range: float = 80.0
    min_size: int = 20
    max_size: int | None = None


def project(points: DataFrame, keys: list[str], order: list[str], rule: RangeImageRule) -> DataFrame:
    """Row and column of every point in range; the first point of a pixel wins.

    Afterwards a row of a cloud holds at most ``cols`` points, which bounds the row windows.
    The number of partitions follows the number of points, so that no task sorts more than
    its share.  The pixels of a cloud, at most ``rows * cols``, end up in one partition, where
    windows and aggregates by ``keys`` and more need no exchange; a cloud of more points than
    a partition is reduced to its pixels before.
    """
    x, y, z = (F.col(c) for c in "xyz")
    flat = F.sqrt(x * x + y * y)
    span = F.sqrt(x * x + y * y + z * z)
    step = (rule.max_angle - rule.min_angle) / (rule.rows - 1)
    pitch = F.degrees(F.atan2(z, flat))
    row = F.floor((pitch - F.lit(rule.min_angle)) / F.lit(step) + 0.5)
    row = F.greatest(F.lit(0), F.least(F.lit(rule.rows - 1), row)).cast("int")
    width = 360.0 / rule.cols
    col = (-F.round((F.degrees(F.atan2(x, y)) - 90.0) / F.lit(width)) + F.lit(rule.cols // 2)).cast("int")
    col = F.when(col >= rule.cols, col - rule.cols).otherwise(col)
    cell, place = [*keys, "row", "col"], {"row": row, "col": col}
    kept = [*keys, *order, *[v for v in "xyz" if v not in order]]
    inside = (span >= rule.min_range) & (span <= rule.max_range) & (row % rule.keep_every == 0) & col.between(0, rule.cols - 1)
    parts = parts_for(points)
    large = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > pairs.PART_ROWS)
    many = large.count()
    if not many:
        some = points.filter(inside).select(*kept)
    else:
        large, same = beside(large.select(*[F.col(k).alias("_" + k) for k in keys]), many), reduce(and_, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys])
        some = points.join(large, same, "left_anti").filter(inside).select(*kept)
        salted = points.join(large, same, "left_semi").filter(inside).select(*kept, F.pmod(F.xxhash64(*order), F.lit(_SALTS)).alias("_salt")).withColumns(place)
        few = first_per_cell(salted.repartition(parts, *cell, "_salt"), [*cell, "_salt"], order, list("xyz"))
        few = first_per_cell(few.repartition(parts, *keys, "row"), cell, order, list("xyz"))
        some = some.unionByName(few.select(*kept))
    # a point's place is told again behind the exchange, which moves less without it
    return first_per_cell(some.repartition(parts, *keys).withColumns(place), cell, order, list("xyz"))


def flat_gap(a: str, b: str) -> Column:
    """XY distance of two point structs."""
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def with_runs(pixels: DataFrame, keys: list[str], rule: RangeImageRule) -> DataFrame:
    """Number the runs of each row: a new one starts where the XY gap is too wide."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    df = pixels.withColumns({"_px": F.lag("x").over(w), "_py": F.lag("y").over(w)})
    gap = F.sqrt((F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py")))
    starts = F.when(F.col("_px").isNull() | (gap >= rule.row_gap), 1).otherwise(0)
    df = df.withColumn("_s", starts)
    return df.withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_px", "_py", "_s")


def runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end column of every run, with its end points."""
    point = F.struct("x", "y")
    return pixels.groupBy(*keys, "row", "run").agg(
        F.min("col").alias("start"), F.max("col").alias("end"), F.count(F.lit(1)).alias("n"),
        F.min_by(point, "col").alias("head"), F.max_by(point, "col").alias("tail"),
    )


def known(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose image row and run can be equal to others, as in a join."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in (*keys, "row", "run")]))


def row_links(rs: DataFrame, keys: list[str], rule: RangeImageRule, ring: bool = False) -> DataFrame:
    """Runs of one row that continue each other behind an occlusion of few runs.

    Only rows with more than two runs are searched.  ``ring`` also closes the row from its
    last to its first run.  The runs of a row are few, so that windows find the next ones
    where the row lies.
    """
    w = Window.partitionBy(*keys, "row")
    many = known(rs, keys).withColumn("_runs", F.max("run").over(w)).filter(F.col("_runs") > 2)
    ahead = F.collect_list(F.struct("run", "head")).over(w.orderBy("run").rangeBetween(*sorted((1, rule.skip))))
    left = many.select(*keys, "row", F.col("run").alias("a"), F.col("tail").alias("_t"), ahead.alias("_next"))
    left = left.select(*keys, "row", "a", "_t", F.explode("_next").alias("_n")).withColumn("_h", F.col("_n.head"))
    out = left.filter(flat_gap("_t", "_h") < rule.row_gap).select(*keys, "row", "a", F.col("_n.run").alias("b"))
    if ring:
        first = many.filter(F.col("run") == 1).select(*keys, "row", F.col("head").alias("_h"))
        last = many.filter(F.col("run") == F.col("_runs")).select(*keys, "row", F.col("run").alias("b"), F.col("tail").alias("_t"))
        close = first.join(last, [*keys, "row"]).filter(flat_gap("_t", "_h") < rule.row_gap)
        out = out.unionByName(close.select(*keys, "row", F.lit(1).alias("a"), "b")).distinct()
    return out


def overlapping_runs(rs: DataFrame, keys: list[str], rule: RangeImageRule, parts: int, bucket: int = 64) -> DataFrame:
    """Runs of the rows just above that overlap a run extended by a few columns.

    Column buckets give the interval join an equality key; both sides meet in ``parts`` partitions.
    """
    def buckets(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket)))

    ext = rule.extension
    cur = rs.select(*keys, F.col("row").alias("row_a"), F.col("run").alias("run_a"), F.col("start").alias("sa"), F.col("end").alias("ea"),
                    F.col("head").alias("ha"), F.col("tail").alias("ta"))
    cur = cur.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rule.link_rows)))).withColumn("row_b", F.col("row_a") - F.col("_k"))
    cur = cur.withColumn("_u", buckets(F.col("sa") - ext, F.col("ea") + ext))
    prev = rs.select(*keys, F.col("row").alias("row_b"), F.col("run").alias("run_b"), F.col("start").alias("sb"), F.col("end").alias("eb"),
                     F.col("head").alias("hb"), F.col("tail").alias("tb"))
    prev = prev.withColumn("_u", buckets(F.col("sb"), F.col("eb")))
    meet = (F.col("sa") - ext <= F.col("eb")) & (F.col("sb") <= F.col("ea") + ext)
    # count a pair only in the first bucket both touch
    first = F.col("_u") == F.greatest(F.floor((F.col("sa") - ext) / bucket), F.floor(F.col("sb") / bucket))
    meeting = [*keys, "row_b", "_u"]
    return cur.repartition(parts, *meeting).join(prev.repartition(parts, *meeting), meeting).filter(meet & first).drop("_u", "_k")


def link_rows(pixels: DataFrame, rs: DataFrame, keys: list[str], rule: RangeImageRule) -> DataFrame:
    """Runs of nearby rows that belong together; ``rs`` are the runs of ``pixels``.

    Overlapping runs need one pair of pixels a few columns apart that is close in XY; runs
    that only meet through the extension need close end points.  Both are pairs of pixels a
    few columns apart: every pixel also goes to the rows just above, where a window along the
    columns lists the pixels of that row around it.  Pixels that lie together by ``keys`` stay where
    they are.
    """
    run = Window.partitionBy(*keys, "row", "run")
    seen = known(pixels, keys).select(*keys, "row", "run", "col", "x", "y", F.min("col").over(run).alias("start"), F.max("col").over(run).alias("end"))
    pixel = F.struct("row", "run", "col", "x", "y", "start", "end")
    steps = F.concat(F.array(F.lit(None).cast("int")), F.sequence(F.lit(1), F.lit(rule.link_rows)))  # none: a pixel in its own row
    seen = seen.select(*keys, "col", pixel.alias("a"), F.explode(steps).alias("_k")).withColumn("row_b", F.col("a.row") - F.coalesce("_k", F.lit(0)))
    reach = max(rule.link_cols, rule.extension)
    around = Window.partitionBy(*keys, "row_b").orderBy("col").rangeBetween(-reach, reach)
    seen = seen.withColumn("_near", F.collect_list(F.when(F.col("_k").isNull(), F.col("a"))).over(around))
    both = seen.filter("_k IS NOT NULL").select(*keys, "a", F.explode("_near").alias("b")).filter(flat_gap("a", "b") < rule.link_gap)
    touch = (F.abs(F.col("a.col") - F.col("b.col")) <= rule.link_cols) & (F.col("b.end") >= F.col("a.start")) & (F.col("a.end") >= F.col("b.start"))

    def behind(p: str, q: str) -> Column:
        """``p`` starts a run a few columns after ``q`` ends one."""
        gap = F.col(f"{p}.start") - F.col(f"{q}.end")
        return (F.col(f"{p}.col") == F.col(f"{p}.start")) & (F.col(f"{q}.col") == F.col(f"{q}.end")) & gap.between(1, rule.extension)

    out = both.filter(touch | behind("a", "b") | behind("b", "a"))
    return out.select(*keys, *[F.col(f"{p}.{c}").alias(f"{c}_{p}") for p in "ab" for c in ("row", "run")]).distinct()


def cluster(pixels: DataFrame, keys: list[str], rule: RangeImageRule) -> DataFrame:
    """Label every pixel of a run image with its cluster, a (row, run) struct.

    ``pixels`` are read several times.  The links need no exchange of pixels that lie
    together by ``keys``, as those of :func:`project` do.
    """
    pixels = known(pixels, keys)
    rs = runs(pixels, keys)
    same = row_links(rs, keys, rule)
    cross_rows = link_rows(pixels, rs, keys, rule)

    def node(row: str, run: str) -> Column:
        """One number, in the order of row and run."""
        return F.shiftleft(F.col(row).cast("long"), 32) + F.col(run)

    edges = same.select(*keys, node("row", "a").alias("u"), node("row", "b").alias("v")).unionByName(
        cross_rows.select(*keys, node("row_a", "run_a").alias("u"), node("row_b", "run_b").alias("v"))
    )
    rest = [c for c in pixels.columns if c not in (*keys, "row", "run")]
    labels = connected_components(pixels.withColumn("id", node("row", "run")), edges, keys=keys, carry=["row", "run", *rest])
    low = F.col("component").bitwiseAND(F.lit((1 << 32) - 1))
    cluster = F.struct(F.shiftright("component", 32).cast("int").alias("row"), low.cast("int").alias("run"))
    return labels.select(*keys, "row", "run", *rest, cluster.alias("cluster"))


def segment(points: DataFrame, keys: list[str], order: list[str], rule: RangeImageRule) -> DataFrame:
    """Clustered points of clusters with an accepted size."""
    labelled = cluster(with_runs(project(points, keys, order, rule), keys, rule), keys, rule)
    good = sized(labelled, [*keys, "cluster"], rule.min_size, rule.max_size)
    return labelled.join(good.drop("size"), [*keys, "cluster"], "left_semi")
