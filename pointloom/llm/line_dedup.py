"""Line de-duplication over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import NOT_SPACE, digest, own_columns, plain_text


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """Remove every later occurrence of ``window`` consecutive lines.

    Lines are split at ``\\n``; lines without a word are passed over when windows are formed
    and are never removed.  A window is the text of its lines, hashed to 128 bits.  Windows
    overlap.  The first occurrence, by (doc_id, line), stays whole; all lines of every other
    occurrence go, judged on the input and not on what is left.

    Adds ``n_lines`` and ``n_removed`` and replaces ``text`` (columns of ``docs`` with these
    two names are replaced).  Null text is treated as empty and comes back as ''.  A document
    with fewer than ``window`` lines with words stays as it is.  Null ids come after all
    others.  Rows with equal id and text are one document: all of them are the first, or none;
    rows with equal id and other text are told apart by the text's hash.  An empty table gives
    an empty table.

    The windows of all documents are grouped by their hash with map-side partial results, and
    only windows found again are joined back, so a window that a third of all documents share
    is a skewed join at most, which adaptive execution splits.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    p = own_columns(docs)
    t, key, late, lines, rank = (f"{p}{n}" for n in ("text", "key", "late", "lines", "id"))
    base = docs.withColumn(t, plain_text(text)).withColumn(key, digest(F.col(t)))
    base = base.withColumn(rank, F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")))

    worded = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(NOT_SPACE))
    spots = base.select(rank, key, worded.alias("l")).filter(F.size("l") >= window)
    at = F.sequence(F.lit(1), F.size("l") - (window - 1))
    spots = spots.select(rank, key, F.posexplode(F.transform(at, lambda i: digest(F.array_join(F.slice("l", i, window), "\n")))).alias("k", "h"))
    place = F.struct(rank, key, "k")
    again = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = spots.join(again.select("h", "first"), "h").filter(place != F.col("first"))
    removed = later.groupBy(rank, key).agg(F.collect_list("k").alias(late))

    # the id part of the join key is never null: the struct holds the null flag, the id has a stand-in
    def joinable(df: DataFrame) -> DataFrame:
        return df.withColumn(f"{p}a", F.to_json(F.col(rank)))

    out = joinable(base).join(joinable(removed).select(f"{p}a", key, late), [f"{p}a", key], "left")
    out = out.withColumn(lines, F.split(F.col(t), "\n"))
    spot = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_SPACE), i)), lambda i: i.isNotNull())
    gone = F.array_distinct(F.flatten(F.transform(late, lambda k: F.slice(F.col(f"{p}spot"), k + 1, window))))
    out = out.withColumn(f"{p}spot", F.when(F.col(late).isNotNull(), spot)).withColumn(f"{p}gone", gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{p}gone"))
    return (
        out.withColumn(text, F.when(F.col(late).isNull(), F.col(t)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size(f"{p}gone"), F.lit(0)).cast("long"))
        .drop(t, key, late, lines, rank, f"{p}a", f"{p}spot", f"{p}gone")
    )
