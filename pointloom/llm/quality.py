"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import NOT_SPACE, SPACE, by_size, digest, own_columns, plain_text, stored

#: A run of this many words that comes twice or more in a text counts as repetition.
RUN = 8


def normal_line(line: Column) -> Column:
    """Lower case, outer white space off, inner white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _covered(starts: Column) -> Column:
    """Words covered by runs at the sorted ``starts``."""
    zero = F.struct(F.lit(-RUN).alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.least(F.lit(RUN), s - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def text_counts(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.

    All come from the text of the row alone.  The steps stand in columns of their own, so
    that each is computed once; positions of repeated runs are sorted only for the texts
    that have any.
    """
    w, h, runs, placed, same, lines = (f"{prefix}_{n}" for n in ("w", "h", "r", "p", "s", "l"))
    empty = F.array().cast("array<bigint>")
    df = df.withColumn(w, words_of(text)).withColumn(lines, F.filter(_lines(text), lambda x: x.rlike(NOT_SPACE)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(h)
    at = F.sequence(F.lit(1), F.greatest(n - (RUN - 1), F.lit(1)))
    df = df.withColumn(runs, F.when(n >= RUN, F.transform(at, lambda i: F.xxhash64(F.slice(h, i, RUN)))).otherwise(empty))
    repeats = F.size(F.array_distinct(runs)) < F.size(runs)
    sorted_runs = F.array_sort(F.transform(runs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn(placed, F.when(repeats, sorted_runs))
    p = F.col(placed)
    twin = F.filter(p, lambda x, k: F.get(p, k - 1)["x"].eqNullSafe(x["x"]) | F.get(p, k + 1)["x"].eqNullSafe(x["x"]))
    df = df.withColumn(same, F.when(p.isNotNull(), F.array_sort(F.transform(twin, lambda x: x["i"]))))
    return df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(_covered(F.col(same)), F.lit(0)).cast("long"),
        }
    ).drop(w, h, runs, placed, same, lines)


def common_lines(docs: DataFrame, host: Column, text: Column, max_share: float, min_documents: int) -> DataFrame:
    """(host, line): normalised lines that more than the given share of a host's texts have.

    Exact copies of a text count as one document, so copying a text does not turn its own
    lines into boilerplate.  The counts pre-aggregate before each shuffle.
    """
    texts = docs.select(host.alias("host"), text.alias("t")).filter(F.col("t").rlike(NOT_SPACE))
    sizes = texts.select("host", digest(F.col("t")).alias("d")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    lines = texts.select("host", digest(F.col("t")).alias("d"), F.explode(F.array_distinct(F.transform(_lines(F.col("t")), normal_line))).alias("line"))
    lines = lines.filter(F.col("line") != "").select("host", digest(F.col("line")).alias("line"), "d").distinct()
    seen = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_documents)
    return seen.join(sizes, "host").filter(F.col("k") > max_share * F.col("n")).select("host", "line")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    max_share: float = 0.1,
    min_documents: int = 10,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_left: float = 0.5,
) -> DataFrame:
    """Judge every document by its own counts and by lines that many documents of its host share.

    A line counts by its normalised form (see ``normal_line``).  A line that at least
    ``min_documents`` and more than ``max_share`` of the distinct texts of a host have is
    removed from that host's documents; a document with fewer than ``min_left`` of its words
    left is depleted.  ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` per cent of them in runs of eight words found twice or more.

    Adds the five counts, ``base_failed``, ``n_common_words`` (words on removed lines),
    ``clean_text`` and ``kept``.  A column of ``docs`` with one of these names is replaced.

    Null text counts as empty and fails; null host is a host of its own together with ''.
    Rows are judged one by one, so repeated rows and null or repeated ids stay as they are.
    An empty table gives an empty table.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "clean_text", "kept")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    p = own_columns(docs, *new)
    t, at, bad, gone = (f"{p}{n}" for n in ("text", "host", "bad", "gone"))
    body, place = plain_text(text), plain_text(F.col(host).cast("string"))

    # a host has at most (mean lines of a text) / max_share such lines
    common = common_lines(docs, place, body, max_share, min_documents).groupBy("host").agg(F.collect_set("line").alias(bad))
    common = stored(common.withColumnRenamed("host", at), "common-lines")
    size = common.agg(F.sum(32 * F.size(bad) + 64)).first()[0] or 0

    out = text_counts(docs.withColumn(t, body).withColumn(at, place), F.col(t), p)
    out = out.join(by_size(common, size, 1), at, "left")
    hit = lambda x: F.array_contains(F.col(bad), digest(normal_line(x)))
    out = out.withColumn(gone, F.when(F.col(bad).isNotNull(), F.filter(_lines(F.col(t)), hit)))
    some = F.coalesce(F.size(gone), F.lit(0)) > 0
    clean = F.array_join(F.filter(_lines(F.col(t)), lambda x: ~hit(x)), "\n")
    out = out.withColumn("clean_text", F.when(some, clean).otherwise(F.col(t)))
    lost = F.when(some, F.size(words_of(F.array_join(F.col(gone), "\n")))).otherwise(0)
    out = out.withColumn("n_common_words", lost.cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= min_left * F.col("n_words"))
    ).drop(t, at, bad, gone)
