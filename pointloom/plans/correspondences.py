"""Correspondence tables: matches joined with the features they connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import SYM
from ..operators.matching import with_corr_id

PAIR = ["src", "tgt"]


def correspondences(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches (src, tgt, class, src_id, tgt_id) with centres and covariances of both ends."""
    out = matches
    for side, prefix in (("src", "s"), ("tgt", "t")):
        cells = [F.col("m" + a).alias(prefix + a) for a in "xyz"]
        cells += [F.col(c).alias(prefix + c) for c in SYM] + [F.col("l2").alias(prefix + "l2")]
        out = out.join(
            features.select(F.col("cloud").alias(side), "class", F.col("id").alias(side + "_id"), *cells),
            [side, "class", side + "_id"],
        )
    return with_corr_id(out, PAIR, ["class", "src_id", "tgt_id"])
