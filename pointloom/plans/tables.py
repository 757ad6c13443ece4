"""Point clouds and pair lists seen in the relational tables.

A supplier is a cloud: its line items are points with quantity, price and
discount-plus-tax as coordinates and the return flag as class.  A cloud pair is two
suppliers with consecutive keys.  Coordinates are multiples of a power of two, so
moment sums are exact in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cloud"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"),
        F.col("l_quantity").alias("x"),
        (F.floor("l_extendedprice") / F.lit(2048.0)).alias("y"),
        (F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)).alias("z"),
        F.col("l_returnflag").alias("class"),
    )


POINTS_SQL = """pts AS (
  SELECT l_suppkey AS cloud, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pid, l_quantity AS x,
         floor(l_extendedprice) / CAST(2048 AS DOUBLE) AS y,
         round(l_discount * 100) + round(l_tax * 100) AS z, l_returnflag AS class
  FROM lineitem)"""


def gauss_sql(name: str, source: str, keys: str) -> str:
    """CTE with count, mean and population covariance per ``keys``."""
    return f"""{name} AS (
  SELECT {keys}, n, mx, my, mz, sxx / n - mx * mx AS xx, sxy / n - mx * my AS xy, sxz / n - mx * mz AS xz,
         syy / n - my * my AS yy, syz / n - my * mz AS yz, szz / n - mz * mz AS zz
  FROM (SELECT {keys}, count(*) AS n, sum(x) / count(*) AS mx, sum(y) / count(*) AS my, sum(z) / count(*) AS mz,
               sum(x * x) AS sxx, sum(x * y) AS sxy, sum(x * z) AS sxz, sum(y * y) AS syy, sum(y * z) AS syz,
               sum(z * z) AS szz
        FROM {source} GROUP BY {keys}))"""


def eigen_sql(name: str, source: str) -> str:
    """CTEs that add ascending eigenvalues l0 l1 l2 of (xx .. zz) to ``source``."""
    return f"""{name}_q AS (SELECT *, (xx + yy + zz) / 3.0 AS q, xy * xy + xz * xz + yz * yz AS off FROM {source}),
{name}_p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * off) / 6.0) AS p
  FROM {name}_q),
{name}_f AS (SELECT *, CASE WHEN p > 1e-100 THEN acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE),
    ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz))
    / (2.0 * p * p * p)))) / 3.0 ELSE 0.0 END AS phi FROM {name}_p),
{name}_e AS (SELECT *, q + 2.0 * p * cos(phi) AS l2, q + 2.0 * p * cos(phi + 2.0 * pi() / 3.0) AS l0 FROM {name}_f),
{name} AS (SELECT *, 3.0 * q - l0 - l2 AS l1 FROM {name}_e)"""


def normal_sql(name: str, source: str) -> str:
    """CTEs that add the unit normal nx ny nz (eigenvector of l0) to ``source``."""
    c = ("ay * bz - az * by", "az * bx - ax * bz", "ax * by - ay * bx")

    def cr(i: int, j: int, k: int) -> str:
        rows = (("(xx - l0)", "xy", "xz"), ("xy", "(yy - l0)", "yz"), ("xz", "yz", "(zz - l0)"))
        a, b = rows[i], rows[j]
        m = {"ax": a[0], "ay": a[1], "az": a[2], "bx": b[0], "by": b[1], "bz": b[2]}
        return " ".join(m.get(t, t) for t in c[k].split())

    crosses = ", ".join(
        f"{cr(i, j, k)} AS c{m}{'xyz'[k]}" for m, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))) for k in range(3)
    )
    norms = ", ".join(f"c{m}x * c{m}x + c{m}y * c{m}y + c{m}z * c{m}z AS n{m}" for m in range(3))
    pick = ", ".join(
        f"CASE WHEN n0 >= n1 AND n0 >= n2 THEN c0{a} WHEN n1 >= n2 THEN c1{a} ELSE c2{a} END AS w{a}" for a in "xyz"
    )
    unit = ", ".join(
        f"CASE WHEN len > 1e-300 THEN w{a} / len ELSE {1.0 if a == 'z' else 0.0} END AS u{a}" for a in "xyz"
    )
    sign = ("CASE WHEN (CASE WHEN abs(uz) > 1e-9 THEN uz WHEN abs(uy) > 1e-9 THEN uy ELSE ux END) < 0 "
            "THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END")
    return f"""{name}_c AS (SELECT *, {crosses} FROM {source}),
{name}_n AS (SELECT *, {norms} FROM {name}_c),
{name}_v AS (SELECT *, sqrt(greatest(n0, n1, n2)) AS len, {pick} FROM {name}_n),
{name}_u AS (SELECT *, {unit} FROM {name}_v),
{name} AS (SELECT *, ux * {sign} AS nx, uy * {sign} AS ny, uz * {sign} AS nz FROM {name}_u)"""
