"""Line-numbered text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small text files with their 0-based number in the file.

    A file is read as one row, so numbers do not depend on how files are split; pose and
    pair lists are a few MB each and are read side by side.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    each = F.transform(F.split("value", r"\r?\n"), lambda v, i: F.struct(i.alias("line"), v.alias("value")))
    # blank lines go before the rows are made, so that no later step ever sees them
    return files.select("path", F.explode(F.filter(each, lambda x: F.trim(x["value"]) != "")).alias("_l")).select("path", "_l.line", "_l.value")


def numbers(value: Column) -> Column:
    """Whitespace-separated numbers of a line."""
    return F.transform(F.split(F.trim(value), r"\s+"), lambda v: v.cast("double"))
