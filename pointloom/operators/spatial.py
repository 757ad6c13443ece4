"""Neighbour joins through grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pairs import by_size, tiled_pairs

CELL = ("_cx", "_cy", "_cz")


def stencil() -> Column:
    """The 27 offsets (a, b, c) of a cell and its neighbours."""
    return F.expr(
        "flatten(transform(sequence(-1,1), a -> flatten(transform(sequence(-1,1),"
        " b -> transform(sequence(-1,1), c -> named_struct('a',a,'b',b,'c',c))))))"
    )


def cells(size: float, xyz=("x", "y", "z")) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(size))).alias(n) for c, n in zip(xyz, CELL)]


def spread(df: DataFrame, cell=CELL) -> DataFrame:
    """One row per neighbouring cell of a row's cell."""
    df = df.withColumn("_o", F.explode(stencil()))
    return df.withColumns({n: F.col(n) + F.col("_o." + o) for n, o in zip(cell, "abc")}).drop("_o")


def radius_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float, carry: list[str] = ()) -> DataFrame:
    """Pairs closer than or at ``radius`` within ``keys``.

    ``left`` and ``right`` have ``keys``, ``id``, ``x y z``; the result has ``a``, ``b``
    and the squared distance ``d2``.  Columns ``carry`` of both ends (of one end, if only
    that has them) follow, named with ``a`` and ``b`` in front.  Keys with few rows are
    compared as a whole.  Rows of others meet only in equal or adjacent cells, those of a
    full cell tile by tile.
    """
    d = [F.col("b" + c) - F.col("a" + c) for c in "xyz"]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    def end(df: DataFrame, name: str) -> DataFrame:
        names = [*"xyz", *[c for c in carry if c not in "xyz" and c in df.columns]]
        return df.select(*keys, F.col("id").alias(name), *[F.col(c).alias(name + c) for c in names])

    def out(met: DataFrame) -> DataFrame:
        return met.select(*keys, "a", "b", d2.alias("d2"), *[n + c for c in carry for n in "ab" if n + c in met.columns])

    def gridded(df: DataFrame, name: str) -> DataFrame:
        return df.withColumns(dict(zip(CELL, cells(radius, [name + c for c in "xyz"]))))

    small, large = by_size([left, right], keys)
    found = out(tiled_pairs(end(small[0], "a"), end(small[1], "b"), keys, ["a"], ["b"], d2 <= radius * radius, None))
    if large is None:
        return found
    a, b = spread(gridded(end(large[0], "a"), "a")), gridded(end(large[1], "b"), "b")
    return found.unionByName(out(tiled_pairs(a, b, [*keys, *CELL], ["a"], ["b"], d2 <= radius * radius)))


#: A cell with at most this many targets is searched as a whole.
LEAF = 64
#: Halvings of a key's cube at most: finer cells would be below the precision of the numbers.
DEPTH = 20
_BOX = tuple(s + a for s in ("lo", "hi") for a in "xyz")


def _box_aggs() -> list[Column]:
    return [F.min("t" + a).alias("lo" + a) for a in "xyz"] + [F.max("t" + a).alias("hi" + a) for a in "xyz"]


def _lower(box) -> Column:
    """Squared distance to a box: no target inside it is nearer."""
    gaps = [F.greatest(box("lo" + a) - F.col(a), F.col(a) - box("hi" + a), F.lit(0.0)) for a in "xyz"]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def _upper(box) -> Column:
    """Squared distance within which the box surely has a target: every face of a tight box holds one."""
    far = [F.greatest(F.abs(F.col(a) - box("lo" + a)), F.abs(F.col(a) - box("hi" + a))) for a in "xyz"]
    near = [F.least(F.abs(F.col(a) - box("lo" + a)), F.abs(F.col(a) - box("hi" + a))) for a in "xyz"]
    far, near = [c * c for c in far], [c * c for c in near]
    total = far[0] + far[1] + far[2]
    return F.least(*[total - f + n for f, n in zip(far, near)])


def _leaves(rows: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """Points of each leaf in order of ``tid``."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tid", "tx", "ty", "tz", *carry))).alias("_points"))


def _pyramid(targets: DataFrame, keys: list[str], carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Occupied cells of every level, and the points of the cells that are not halved further.

    A key's targets lie in one cube; a cell is named by its level and the leading bits of its
    three coordinates.  Only cells with more than ``LEAF`` targets are halved, so the rounds
    follow the densest place and each round reads only what is still too dense.
    """
    span = F.greatest(*[F.col("hi" + a) - F.col("lo" + a) for a in "xyz"])
    extent = targets.groupBy(*keys).agg(*_box_aggs()).select(*keys, *["lo" + a for a in "xyz"], span.alias("_span"))
    steps = 1 << DEPTH
    spot = {"_i" + a: F.least(F.floor(F.coalesce(F.try_divide(F.col("t" + a) - F.col("lo" + a), F.col("_span")), F.lit(0.0)) * steps), F.lit(steps - 1)) for a in "xyz"}
    left = cut_lineage(targets.join(extent, keys).withColumns(spot).drop("_span", *["lo" + a for a in "xyz"]))
    levels, leaves = [], None
    for level in range(DEPTH + 1):
        shift = DEPTH - level
        cell = sum((F.shiftleft(F.shiftright("_i" + a, shift), k * (DEPTH + 1)) for k, a in enumerate("xyz")), F.lit(0).cast("long"))
        up = sum((F.shiftleft(F.shiftright("_i" + a, min(shift + 1, DEPTH)), k * (DEPTH + 1)) for k, a in enumerate("xyz")), F.lit(0).cast("long"))
        placed = left.withColumns({"_cell": cell, "_up": up})
        nodes = placed.groupBy(*keys, "_cell", "_up").agg(F.count(F.lit(1)).alias("_n"), *_box_aggs())
        nodes = cut_lineage(nodes.withColumn("_leaf", (F.col("_n") <= LEAF) | F.lit(level == DEPTH)))
        levels.append(nodes)
        dense = nodes.filter(~F.col("_leaf")).select(*keys, "_cell")
        # only at the last level can a cell hold more than LEAF points; it is then cut by hash
        ended = placed.join(nodes.filter("_leaf").select(*keys, "_cell", "_n"), [*keys, "_cell"])
        ended = ended.withColumns({"_level": F.lit(level), "_part": F.pmod(F.xxhash64("tx", "ty", "tz"), F.ceil(F.col("_n") / LEAF))})
        some = _leaves(ended, [*keys, "_level", "_cell", "_part"], carry)
        leaves = some if leaves is None else leaves.unionByName(some)
        if dense.isEmpty():
            return levels, leaves
        left = cut_lineage(placed.join(dense, [*keys, "_cell"], "left_semi").drop("_cell", "_up"))
    raise AssertionError("the last level has leaves only")


def _descend(queries: DataFrame, levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per query and leaf that may hold its nearest target: ``_level``, ``_cell``.

    Level by level a query's open cells give way to their occupied children; a cell stays
    only while its lower bound is within the least upper bound seen for the query.
    """
    who = [*keys, "qid"]
    at = F.struct("x", "y", "z").alias("_at")
    front = None
    for level, nodes in enumerate(levels):
        box = F.struct("_cell", "_leaf", *_BOX)
        if front is None:
            near = queries.select(*who, "x", "y", "z", F.lit(float("inf")).alias("_best")).join(nodes.select(*keys, box.alias("_b")), keys)
            rest = None
        else:
            opened = front.select(*who, "_at.*", "_best", F.explode("_cells").alias("_c"))
            rest = opened.filter("_c.leaf").select(*who, at, "_best", F.col("_c").alias("_e"))
            children = nodes.groupBy(*keys, "_up").agg(F.collect_list(box).alias("_b"))  # at most eight
            near = opened.filter("not _c.leaf").withColumn("_up", F.col("_c.cell")).drop("_c").join(children, [*keys, "_up"])
            near = near.withColumn("_b", F.explode("_b"))
        entry = F.struct(F.lit(level).alias("level"), F.col("_b._cell").alias("cell"), F.col("_b._leaf").alias("leaf"), _lower(lambda n: F.col("_b." + n)).alias("low"))
        met = near.select(*who, at, F.least("_best", _upper(lambda n: F.col("_b." + n))).alias("_best"), entry.alias("_e"))
        met = met if rest is None else met.unionByName(rest)
        front = met.groupBy(*who).agg(F.first("_at").alias("_at"), F.min("_best").alias("_best"), F.collect_list("_e").alias("_cells"))
        # the bounds are rounded: leave room for the last digits
        front = front.withColumn("_cells", F.filter("_cells", lambda c: c["low"] <= F.col("_best") * (1 + 1e-9)))
        front = cut_lineage(front)
    cells = front.select(*who, F.explode("_cells").alias("_c"))
    return cells.select(*who, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))


def nearest(queries: DataFrame, targets: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """Exact nearest target of every query within ``keys``.

    ``queries`` have ``qid``, ``targets`` have ``tid`` (both unique per key), both with
    ``x y z``.  Adds ``tid``, the squared distance ``d2`` and the target's ``carry`` columns to
    the queries; queries whose key has no target are left out.  Ties go to the smaller ``tid``.

    The targets' occupied cells form a pyramid (:func:`_pyramid`) that is searched from coarse
    to fine with lower and upper bounds (:func:`_descend`); targets are never copied, and a
    query is compared with at most ``LEAF`` points of each leaf it still has.  A key with few
    targets is a single leaf.  Of targets in one place only the smallest ``tid`` is kept.
    """
    carry = list(carry)
    value = F.struct("tid", *carry)
    one = targets.groupBy(*keys, *[F.col(c).cast("double").alias("t" + c) for c in "xyz"]).agg(F.min(value).alias("_v"))
    one = cut_lineage(one.select(*keys, "tx", "ty", "tz", "_v.*"))
    most = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def closest(points: Column) -> Column:
        def gap(t: Column) -> Column:
            d = [t["t" + a] - F.col(a) for a in "xyz"]
            return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

        # points are in order of tid: of equal distances the first wins
        near = F.array_min(F.transform(points, lambda t, i: F.struct(gap(t).alias("d2"), i.alias("i"))))
        one = F.get(points, near["i"])
        return F.struct(near["d2"].alias("d2"), *[one[c].alias(c) for c in ("tid", *carry)])

    if most <= LEAF:
        hit = queries.join(_leaves(one, keys, carry), keys).withColumn("_h", closest(F.col("_points"))).drop("_points")
        return hit.select(*queries.columns, *[F.col("_h." + c).alias(c) for c in ("tid", "d2", *carry)])
    rows = cut_lineage(queries)
    levels, leaves = _pyramid(one, keys, carry)
    cells = _descend(rows, levels, keys).join(rows.select(*keys, "qid", "x", "y", "z"), [*keys, "qid"])
    hit = cells.join(leaves, [*keys, "_level", "_cell"]).select(*keys, "qid", closest(F.col("_points")).alias("_h"))
    best = hit.groupBy(*keys, "qid").agg(F.min("_h").alias("_h"))
    return rows.join(best, [*keys, "qid"]).select(*queries.columns, *[F.col("_h." + c).alias(c) for c in ("tid", "d2", *carry)])


def adjacent_cells(cells_df: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Pairs of occupied neighbouring cells, each once, as structs ``u < v`` of ``cell``."""
    here = cells_df.select(*keys, *cell).distinct()
    near = spread(here.withColumn("u", F.struct(*cell)), tuple(cell))
    other = here.withColumn("v", F.struct(*cell))
    return near.join(other, [*keys, *cell]).filter(F.col("u") < F.col("v")).select(*keys, "u", "v")
