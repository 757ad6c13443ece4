"""Tiled pair joins.

Pairs inside a group are found tile against tile: both sides of a group are split
into tiles of a bounded number of rows and each pair of tiles is its own join key.
Many tasks share a large group and the pair predicate is applied inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TILE_ROWS = 512
#: Rows of a partition that is sorted or aggregated as a whole.
PART_ROWS = 1 << 19


def parts_for(df: DataFrame, times: int = 1) -> int:
    """Shuffle partitions for ``times`` rows per row of ``df``: at least Spark's setting, at most ``PART_ROWS`` rows each on average."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * times // PART_ROWS))


def _tiles(df: DataFrame, on: list[str], tile_rows: int, name: str) -> DataFrame:
    return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("long").alias(name))


def tiled_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], right_id: list[str],
                where: Column | None = None, tile_rows: int | None = TILE_ROWS) -> DataFrame:
    """Join ``left`` and ``right`` within ``on``, tile by tile, keeping rows that pass ``where``.

    Apart from ``on`` the two sides must have different column names.  ``tile_rows=None``
    is for groups already cut to one tile, such as top-k lists: a plain equi-join.
    """
    if tile_rows is None:
        out = left.join(right, on)
        return out if where is None else out.filter(where)
    sizes = _tiles(left, on, tile_rows, "_lt").join(_tiles(right, on, tile_rows, "_rt"), on)
    lhs = left.join(sizes, on).withColumns(
        {
            "_i": F.pmod(F.xxhash64(*left_id), F.col("_lt")),
            "_j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rt") - 1)),
        }
    ).drop("_lt", "_rt")
    rhs = right.join(sizes, on).withColumns(
        {
            "_j": F.pmod(F.xxhash64(*right_id), F.col("_rt")),
            "_i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lt") - 1)),
        }
    ).drop("_lt", "_rt")
    out = lhs.join(rhs, [*on, "_i", "_j"])
    if where is not None:
        out = out.filter(where)
    return out.drop("_i", "_j")


def by_size(sides: list[DataFrame], keys: list[str], most: int = TILE_ROWS) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The sides' rows of keys with at most ``most`` rows on each side, and those of other keys, if any.

    The sides are read several times; a key that is small on all sides can be joined as a whole.
    """
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) for i, df in enumerate(sides) if all(df is not d for d in sides[:i])]
    count = counts[0]
    for other in counts[1:]:
        count = count.unionByName(other)
    if (count.agg(F.max("_rows")).first()[0] or 0) <= most:
        return sides, None
    large = cut_lineage(count.filter(F.col("_rows") > most).select(*keys).distinct())
    return [df.join(large, keys, "left_anti") for df in sides], [df.join(large, keys, "left_semi") for df in sides]


def beside(state: DataFrame, groups: int, row_bytes: int = 512, most_bytes: int = 64 << 20) -> DataFrame:
    """One row per group, ready to be joined with the groups' rows.

    Up to a proven size it is broadcast, so the rows stay where they are and only partial
    sums are shuffled; beyond it Spark chooses the join.
    """
    return F.broadcast(state) if groups * row_bytes <= most_bytes else state
