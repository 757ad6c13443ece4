"""Association of features between two clouds of a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import descriptor_distance
from ..session import cut_lineage
from .pairs import TILE_ROWS, tiled_pairs
from .running import with_row_number
from .voxels import top_k


def _sides(src: DataFrame, tgt: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    left = src.select(*on, F.col("id").alias("src_id"), F.col("desc").alias("_sd"))
    right = tgt.select(*on, F.col("id").alias("tgt_id"), F.col("desc").alias("_td"))
    return left, right


def mutual_top_k(src: DataFrame, tgt: DataFrame, on: list[str], k: int, distance,
                 tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Pairs in which each side is among the other's ``k`` nearest by descriptor.

    ``src``/``tgt`` have ``on``, ``id`` and ``desc``; ``distance`` maps two descriptor
    columns to a dissimilarity.  Ties go to the smaller id.  Both rank filters prune to
    k rows per id before their shuffle, so the pair space itself is never moved.
    """
    left, right = _sides(src, tgt, on)
    pairs = tiled_pairs(left, right, on, ["src_id"], ["tgt_id"], tile_rows=tile_rows).select(
        *on, "src_id", "tgt_id", distance(F.col("_sd"), F.col("_td")).alias("dist")
    )
    best_src = top_k(pairs, [*on, "src_id"], k, [F.col("dist"), F.col("tgt_id")]).drop("rank")
    best_tgt = top_k(pairs, [*on, "tgt_id"], k, [F.col("dist"), F.col("src_id")]).select(*on, "src_id", "tgt_id")
    return best_src.join(best_tgt, [*on, "src_id", "tgt_id"], "left_semi")


#: Descriptors of a cell of the metric index, and of a block that is assigned to cells.
CELL_ROWS = 512
BLOCK_ROWS = 8192


def _matrix(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)


def _distances(a: np.ndarray, b: np.ndarray):
    """Slices of rows of ``a`` with their distances to all rows of ``b``; equal rows give equal numbers."""
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        yield i, np.sqrt((d * d).sum(axis=2))


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def metric_cells(side: DataFrame, on: list[str], rows: int = CELL_ROWS, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Descriptors of each group in balls around pivots.

    Pivots are about one row in ``rows``, drawn by hash; each row goes to its nearest one.
    Returns the balls (on, cell, n, centre, radius) and their members in lists of at most about
    ``rows`` (on, cell, members of id and desc): a ball with more is several lists.
    """
    side = cut_lineage(side.select(*on, "id", "desc"))
    draw = F.xxhash64("id", F.lit(seed))
    sizes = side.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(draw, "id")).alias("_f"))
    sizes = cut_lineage(sizes.select(*on, "_n", F.col("_f.id").alias("_first"), F.ceil(F.col("_n") / BLOCK_ROWS).alias("_blocks")))
    known = side.join(sizes, on)
    lucky = F.pmod(draw, F.col("_n")) < F.ceil(F.col("_n") / rows)
    pivots = cut_lineage(known.filter(lucky | (F.col("id") == F.col("_first"))))
    # columns of their own: both sides of a cogroup must not share any
    spread = pivots.select(*[F.col(c).alias(c) for c in on], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), F.col("id").alias("pid"), F.col("desc").alias("pdesc"))
    blocks = known.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).select(*on, "_block", "id", "desc")

    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("pid")
        a, b = _matrix(rows.column("desc")), _matrix(pivots.column("pdesc"))
        cell, dist = np.empty(len(a), np.int64), np.empty(len(a))
        for i, d in _distances(a, b):
            cell[i : i + len(d)] = d.argmin(axis=1)
            dist[i : i + len(d)] = d.min(axis=1)
        out = rows.drop_columns("_block")
        return out.append_column("cell", pivots.column("pid").take(pa.array(cell))).append_column("dist", pa.array(dist))

    schema = StructType([*(side.schema[c] for c in (*on, "id", "desc")), StructField("cell", side.schema["id"].dataType), StructField("dist", DoubleType())])
    placed = cut_lineage(blocks.groupBy(*on, "_block").cogroup(spread.groupBy(*on, "_block")).applyInArrow(assign, schema))
    balls = placed.groupBy(*on, "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
    balls = cut_lineage(balls.join(pivots.select(*on, F.col("id").alias("cell"), F.col("desc").alias("centre")), [*on, "cell"]))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / rows)).alias("_part")
    lists = placed.join(balls.select(*on, "cell", "n"), [*on, "cell"]).select(*on, "cell", part, "id", "desc")
    return balls, lists.groupBy(*on, "cell", "_part").agg(F.collect_list(F.struct("id", "desc")).alias("members")).drop("_part")


def _near_balls(src: DataFrame, tgt: DataFrame, on: list[str], k: int) -> DataFrame:
    """Pairs of balls that may hold one of the ``k`` nearest of some member, by the triangle inequality.

    All members of a ball have ``k`` partners within the distance at which the balls that are
    surely reached hold ``k`` rows; a ball whose nearest possible member is farther is out.
    """
    s = src.select(*on, F.col("cell").alias("s_cell"), F.col("n").alias("s_n"), F.col("centre").alias("s_c"), F.col("radius").alias("s_r"))
    t = tgt.select(*on, F.col("cell").alias("t_cell"), F.col("n").alias("t_n"), F.col("centre").alias("t_c"), F.col("radius").alias("t_r"))
    gap, reach = descriptor_distance(F.col("s_c"), F.col("t_c")), F.col("s_r") + F.col("t_r")
    both = tiled_pairs(s, t, on, ["s_cell"], ["t_cell"]).select(*on, "s_cell", "t_cell", "s_n", "t_n", (gap - reach).alias("low"), (gap + reach).alias("high"))
    both = cut_lineage(both)
    for own, other in (("s", "t"), ("t", "s")):
        upto = Window.partitionBy(*on, f"{own}_cell").orderBy("high", f"{other}_cell").rowsBetween(Window.unboundedPreceding, 0)
        sure = both.withColumn("_k", F.sum(f"{other}_n").over(upto)).filter(F.col("_k") >= k)
        bound = sure.groupBy(*on, f"{own}_cell").agg(F.min("high").alias(f"{own}_bound"))
        both = both.join(bound, [*on, f"{own}_cell"], "left")
    most = F.greatest(F.coalesce("s_bound", F.lit(float("inf"))), F.coalesce("t_bound", F.lit(float("inf"))))
    return both.filter(F.col("low") <= most * (1 + 1e-9)).select(*on, "s_cell", "t_cell")  # room for rounding


def mutual_nearest(src: DataFrame, tgt: DataFrame, on: list[str], k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """:func:`mutual_top_k` by Euclidean distance, for large lists of many-dimensional descriptors.

    Both sides are put into balls around pivots and only pairs of balls that the triangle
    inequality leaves are compared.  One pass over those gives both ranks: a comparison
    returns the ``k`` nearest of every row of either list.  ``id`` is unique per group;
    descriptors have one length and no nulls.
    """
    (s_balls, s_lists), (t_balls, t_lists) = metric_cells(src, on, cell_rows), metric_cells(tgt, on, cell_rows)
    near = _near_balls(s_balls, t_balls, on, k)
    near = near.join(s_lists.select(*on, F.col("cell").alias("s_cell"), F.col("members").alias("s")), [*on, "s_cell"])
    near = near.join(t_lists.select(*on, F.col("cell").alias("t_cell"), F.col("members").alias("t")), [*on, "t_cell"]).select(*on, "s", "t")

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                s, t = (batch.column(c)[r].values for c in "st")
                ids_s, ids_t = s.field("id"), t.field("id")
                by_s, by_t = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in (ids_s, ids_t))
                d = np.concatenate([x for _, x in _distances(_matrix(s.field("desc")), _matrix(t.field("desc")))])
                hit = np.zeros(d.shape, bool)
                for m, h, ids in ((d, hit, by_t), (d.T, hit.T, by_s)):  # least distance, then smaller id
                    order = np.argsort(ids, kind="stable")
                    best = order[np.argsort(m[:, order], axis=1, kind="stable")[:, :k]]
                    np.put_along_axis(h, best, True, axis=1)
                i, j = np.nonzero(hit)
                keys = [pa.array([batch.column(c)[r].as_py()] * len(i), batch.schema.field(c).type) for c in on]
                yield pa.RecordBatch.from_arrays([*keys, ids_s.take(pa.array(i)), ids_t.take(pa.array(j)), pa.array(d[i, j])], [*on, "src_id", "tgt_id", "dist"])

    kind = src.schema["id"].dataType.simpleString(), tgt.schema["id"].dataType.simpleString()
    pairs = cut_lineage(near.mapInArrow(compare, f"{_types(near, on)}, src_id {kind[0]}, tgt_id {kind[1]}, dist double"))
    best_src = top_k(pairs, [*on, "src_id"], k, [F.col("dist"), F.col("tgt_id")]).drop("rank")
    best_tgt = top_k(pairs, [*on, "tgt_id"], k, [F.col("dist"), F.col("src_id")]).select(*on, "src_id", "tgt_id")
    return best_src.join(best_tgt, [*on, "src_id", "tgt_id"], "left_semi")


def all_to_all(src: DataFrame, tgt: DataFrame, on: list[str]) -> DataFrame:
    """Every same-class pair of two feature lists, tile by tile: all pairs are what is asked for."""
    left, right = _sides(src, tgt, on)
    return tiled_pairs(left, right, on, ["src_id"], ["tgt_id"]).select(*on, "src_id", "tgt_id")


#: Modulus of the draw; a prime.
DRAW = 1_000_003


def first_k(src: DataFrame, tgt: DataFrame, on: list[str], k: int, seed: int = 17) -> DataFrame:
    """Every source feature with ``k`` target features of its class, drawn at random.

    The draw is the order of a seeded hash over all targets, the same for every source.
    """
    left, right = _sides(src, tgt, on)
    mixed = (F.pmod(F.col("tgt_id"), F.lit(DRAW)) * 7919 + seed) % DRAW
    head = top_k(right, on, k, [mixed, F.col("tgt_id")]).drop("rank")
    return left.join(head, on).select(*on, "src_id", "tgt_id")


def bin_overlap_top_k(src_bins: DataFrame, tgt_bins: DataFrame, src_ids: DataFrame, tgt_ids: DataFrame,
                      on: list[str], k: int, distance) -> DataFrame:
    """Mutual top-k on sparse histograms.

    The similarity of two features is the number of (bin of one, bin of the other)
    pairs that are equal or adjacent; features with no common bin rank last.
    """
    stencil = F.explode(F.expr(
        "flatten(transform(sequence(-1,1), a -> flatten(transform(sequence(-1,1),"
        " b -> transform(sequence(-1,1), c -> named_struct('a',a,'b',b,'c',c))))))"
    )).alias("_o")
    near = src_bins.select(*on, F.col("id").alias("src_id"), "bx", "by", "bz", stencil).select(
        *on, "src_id", *[(F.col(f"b{c}") + F.col(f"_o.{o}")).cast("int").alias(f"b{c}") for c, o in zip("xyz", "abc")]
    )
    other = tgt_bins.select(*on, F.col("id").alias("tgt_id"), *[F.col(f"b{c}").cast("int").alias(f"b{c}") for c in "xyz"])
    hits = near.join(other, [*on, "bx", "by", "bz"]).groupBy(*on, "src_id", "tgt_id").agg(F.count(F.lit(1)).alias("hits"))
    left = src_ids.select(*on, F.col("id").alias("src_id"))
    right = tgt_ids.select(*on, F.col("id").alias("tgt_id"))
    pairs = (
        tiled_pairs(left, right, on, ["src_id"], ["tgt_id"])
        .join(hits, [*on, "src_id", "tgt_id"], "left")
        .select(*on, "src_id", "tgt_id", distance(F.coalesce("hits", F.lit(0))).alias("dist"))
    )
    best_src = top_k(pairs, [*on, "src_id"], k, [F.col("dist"), F.col("tgt_id")]).drop("rank")
    best_tgt = top_k(pairs, [*on, "tgt_id"], k, [F.col("dist"), F.col("src_id")]).select(*on, "src_id", "tgt_id")
    return best_src.join(best_tgt, [*on, "src_id", "tgt_id"], "left_semi")


def with_corr_id(corr: DataFrame, pair: list[str], order: list[str]) -> DataFrame:
    """Number the correspondences of a pair from 0, across tasks: a pair may be of any size."""
    return with_row_number(corr, pair, order, "corr_id").withColumn("corr_id", F.col("corr_id") - 1)


def tuple_test(corr: DataFrame, pair: list[str], scale: float = 0.95, trials: int = 100, seed: int = 7) -> DataFrame:
    """Keep correspondences that pass an edge-length test in some seeded triple.

    Each trial hashes the pair's correspondences into buckets of about six and tests the
    consecutive triples of a bucket, so no task ever sorts a whole pair.
    """
    size = corr.groupBy(*pair).agg(F.greatest(F.floor(F.count(F.lit(1)) / 6), F.lit(1)).alias("_buckets"))
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))
    point = F.struct("corr_id", "sx", "sy", "sz", "tx", "ty", "tz")
    rows = corr.join(size, pair).select(*pair, "_buckets", point.alias("_p"), trial.alias("_trial"))
    bucket = F.pmod(F.xxhash64("_p.corr_id", "_trial", F.lit(seed)), F.col("_buckets"))
    groups = rows.groupBy(*pair, "_trial", bucket.alias("_bucket")).agg(F.array_sort(F.collect_list("_p")).alias("_l"))
    groups = groups.filter(F.size("_l") >= 3)
    starts = F.sequence(F.lit(1), F.floor(F.size("_l") / 3).cast("int"))
    triples = groups.select(*pair, F.explode(F.transform(starts, lambda k: F.slice("_l", 3 * k - 2, 3))).alias("_t"))

    def length(i: int, j: int, side: str) -> Column:
        d = [F.col("_t")[i][side + a] - F.col("_t")[j][side + a] for a in "xyz"]
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    ok = F.lit(True)
    for i, j in ((0, 1), (1, 2), (0, 2)):
        s, t = length(i, j, "s"), length(i, j, "t")
        ok = ok & (s * scale < t) & (t * scale < s)
    good = triples.filter(ok).select(*pair, F.explode(F.transform("_t", lambda v: v.corr_id)).alias("corr_id"))
    return corr.join(good.distinct(), [*pair, "corr_id"], "left_semi")
