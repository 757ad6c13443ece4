"""One-dimensional consensus: truncated least squares and Otsu thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import with_running_sums


def tls_sweep(df: DataFrame, keys: list[str], x: Column, r: Column, digits: int = 6) -> DataFrame:
    """Consensus estimate of scalars ``x`` with interval half-widths ``r`` per group.

    Interval ends are first summed per distinct position, then swept in order with
    running sums.  The best position has the least truncated squared error; starts come
    before ends at the same place and the first of equal costs (to ``digits``) wins.
    """
    rows = df.select(*keys, x.cast("double").alias("x"), r.cast("double").alias("r"))
    ends = F.array(
        F.struct((F.col("x") - F.col("r")).alias("h"), F.lit(1).alias("s")),
        F.struct((F.col("x") + F.col("r")).alias("h"), F.lit(-1).alias("s")),
    )
    terms = {
        "card": F.lit(1.0), "w": 1.0 / (F.col("r") * F.col("r")), "wx": F.col("x") / (F.col("r") * F.col("r")),
        "sx": F.col("x"), "sxx": F.col("x") * F.col("x"), "sr": F.col("r"),
    }
    points = rows.withColumns(terms).select(*keys, F.explode(ends).alias("_e"), *terms)
    points = points.groupBy(*keys, F.col("_e.h").alias("h"), (-F.col("_e.s")).alias("o")).agg(
        *[F.sum(F.col("_e.s") * F.col(t)).alias(t) for t in terms]
    )
    run = with_running_sums(points, keys, ["h", "o"], {"c_" + t: F.col(t) for t in terms})
    total = rows.groupBy(*keys).agg(F.sum("r").alias("r_all"))
    run = run.filter(F.col("c_card") > 0.5).join(total, keys)
    est = F.col("c_wx") / F.col("c_w")
    run = run.withColumn("estimate", est)
    cost = (
        F.col("c_card") * F.col("estimate") * F.col("estimate") + F.col("c_sxx") - 2.0 * F.col("c_sx") * F.col("estimate")
        + (F.col("r_all") - F.col("c_sr"))
    )
    run = run.withColumn("cost", cost)
    return run.groupBy(*keys).agg(F.min(F.struct(F.round("cost", digits).alias("at"), "h", "o", "estimate", "cost")).alias("_b")).select(
        *keys, F.col("_b.estimate").alias("estimate"), F.col("_b.cost").alias("cost")
    )


def tls_translation(rows: DataFrame, keys: list[str], bound: float, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Per-axis consensus of ``t - s`` and the rows inside on all three axes.

    ``rows`` have ``sx sy sz`` (already rotated) and ``tx ty tz``.
    """
    axes = F.array(*[F.struct(F.lit(i).alias("axis"), (F.col("t" + a) - F.col("s" + a)).alias("value"))
                     for i, a in enumerate("xyz")])
    long = rows.select(*keys, F.explode(axes).alias("_v")).select(*keys, "_v.*")
    best = tls_sweep(long, [*keys, "axis"], F.col("value"), F.lit(float(bound)), digits)
    wide = best.groupBy(*keys).agg(
        *[F.max(F.when(F.col("axis") == i, F.col("estimate"))).alias("t" + str(i)) for i in range(3)]
    )
    inside = F.lit(True)
    for i, a in enumerate("xyz"):
        inside = inside & (F.abs(F.col("t" + a) - F.col("s" + a) - F.col(f"t{i}")) <= bound)
    masked = rows.join(wide, keys).withColumn("inlier", inside).drop("t0", "t1", "t2")
    return wide, masked


def tls_scale(rows: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """Consensus of the length ratio target over source; ``rows`` have ``src_len``, ``tgt_len``."""
    return tls_sweep(rows, keys, F.col("tgt_len") / F.col("src_len"), 2.0 * bound / F.col("src_len"))


def scale_inliers(rows: DataFrame, bound: float) -> DataFrame:
    """With the scale fixed at one: lengths that agree within twice the noise bound."""
    return rows.withColumn("inlier", F.abs(F.col("src_len") - F.col("tgt_len")) <= 2.0 * bound)


def otsu(df: DataFrame, keys: list[str], value: Column, bins: int = 100) -> DataFrame:
    """Two-class threshold of a value per group over a fixed number of bins.

    The rows collapse to at most ``bins`` histogram rows per group before any window.
    """
    rows = df.select(*keys, value.cast("double").alias("v"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    if not keys:
        raise ValueError("group by a constant column for one global threshold")
    step = (F.col("hi") - F.col("lo")) / bins
    cell = F.when(step > 0, F.least(F.floor(F.col("v") / step), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    # the ends ride on the histogram through the group key
    hist = rows.join(ends, keys).groupBy(*keys, cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.withColumns({"n1": F.sum("n").over(upto), "s1": F.sum("s").over(upto),
                          "n_all": F.sum("n").over(whole), "s_all": F.sum("s").over(whole)})
    n2 = F.col("n_all") - F.col("n1")
    gap = F.col("s1") / F.col("n1") - F.try_divide(F.col("s_all") - F.col("s1"), n2)
    between = F.when(n2 > 0, F.col("n1").cast("double") * n2.cast("double") * gap * gap)
    at = F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    best = h.withColumns({"between": between, "at": at}).groupBy(*keys).agg(
        F.max(F.when(F.col("between").isNotNull(), F.struct("between", -F.col("bin"), "at"))).alias("_b"),
        F.max((F.col("hi") - F.col("lo")) / 2.0).alias("_d"),
    )
    return best.select(*keys, F.coalesce(F.col("_b.at"), F.col("_d")).alias("threshold"))
