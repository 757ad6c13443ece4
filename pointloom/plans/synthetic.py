"""Seeded synthetic features: points of lines, planes and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Points per feature kind.
SIZES = {"Line": 20, "Plane": 100, "Cluster": 20}


def random_features(spark: SparkSession, features: int, seed: int = 7) -> DataFrame:
    """``features`` features of each kind: ``id, class, pid, x, y, z``.

    Every number is a hash of its feature and role, so a feature is the same in any plan.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.lit(n).alias("n")) for k, n in SIZES.items()]))
    rows = spark.range(features).select("id", kinds.alias("_k")).select("id", "_k.class", F.explode(F.sequence(F.lit(0), F.col("_k.n") - 1)).alias("pid"))

    def unit(*parts: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id", "class", *parts), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0

    corner = [[unit(F.lit(f"corner{k}{a}")) for a in "xyz"] for k in range(3)]
    u, v = (unit(F.lit(n), "pid") for n in "uv")
    out = {}
    for i, a in enumerate("xyz"):
        p, q, r = (c[i] for c in corner)
        box = p + (0.2, 0.3, 0.4)[i] * unit(F.lit("box" + a), "pid")
        out[a] = F.when(F.col("class") == "Line", p + (q - p) * u).when(F.col("class") == "Plane", u * p + v * q + (1.0 - u - v) * r).otherwise(box)
    return rows.withColumns(out)
