"""Ranks and running sums over groups of any size.

A window partitioned by the group alone would put a hot group into one task.  Here
rows are range-partitioned on (group, order), so a large group spans many chunks;
each chunk is summed on its own and shifted by the totals of the chunks before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, object]) -> DataFrame:
    """Add inclusive running sums ``sums`` (name -> expression), in ``order`` within ``keys``.

    ``order`` must be a total order within the group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    df = df.withColumns({f"_t_{n}": e for n, e in sums.items()})
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # written out once: both branches below must see the same chunk ids
    chunked = cut_lineage(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_chunk", F.spark_partition_id())
    )
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in sums])
    # at most one row per chunk of a group: bounded by the partition count
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({f"_l_{n}": F.sum(f"_t_{n}").over(inside) for n in sums})
    out = local.join(shift, [*keys, "_chunk"]).withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_chunk", *[f"_{p}_{n}" for n in sums for p in "tol"])


def with_row_number(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    """1-based position within the group, for groups of any size."""
    return with_running_sums(df, keys, order, {name: F.lit(1).cast("long")})
