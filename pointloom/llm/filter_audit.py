"""How filters interact: what each removes in every order, and its Shapley share from a potential."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, digest, plain_text, stored

LETTERS = "ABCDE"
#: The filter that compares texts; the others look at one text alone.
COPY = "E"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure condition of each filter that needs one text alone."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters in ``mask`` (bit 0 is A).

    Texts are looked at once, in the task that reads them; only ids, digests and flags move.
    Copies are counted, never listed: documents are first summed by (text, part, flags), so a
    text shared by a third of the table is a few rows when its smallest id is looked for.
    """
    body = plain_text(text)
    seen = docs.select(
        F.col(doc_id).cast("long").alias("id"), plain_text(F.col(part).cast("string")).alias("part"), body.alias("t"),
        F.array_remove(F.split(body, SPACE + "+"), "").alias("w"),
    )
    bits = sum((F.when(bad, F.lit(1 << LETTERS.index(k))).otherwise(0) for k, bad in text_failures(F.col("t"), F.col("w")).items()), F.lit(0))
    thin = seen.select("id", "part", digest(F.col("t")).alias("text"), F.octet_length("t").alias("bytes"), bits.alias("mask"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    flags = ["part", "mask", "good", "toxic"]
    rows = thin.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    same_row = rows.groupBy("text", "bytes", "id", *flags).agg(F.count(F.lit(1)).alias("c"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "c"))
    same_text = same_row.groupBy("text", "bytes", *flags).agg(F.sum("c").alias("n"), first.alias("first"))
    # at most (parts times four) rows per text; the smallest id over all of them
    least = same_text.groupBy("text", "bytes").agg(F.min(F.struct("first.none", "first.id")).alias("least"))
    both = same_text.join(least, ["text", "bytes"])
    passing = F.when(F.col("least.none"), F.col("n")).when(F.col("first.id") == F.col("least.id"), F.col("first.c")).otherwise(F.lit(0).cast("long"))
    both = both.withColumn("passing", passing)
    copy = 1 << LETTERS.index(COPY)
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )).alias("s")
    cells = both.select("part", "good", "toxic", split).select("part", "s.mask", "s.n", "good", "toxic")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _orders(spark, letters: str) -> DataFrame:
    """All orders of the filters, step by step, with the coalition before and after: a table of fixed size."""
    rows = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            rows.append((len(rows), "".join(order), step, before, before + bit, bit))
            before += bit
    return spark.createDataFrame(rows, "k int, filter_order string, step int, before int, after int, bit int").coalesce(1)


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every order and step of the filters for every part of ``counts`` (part, mask, n, good, toxic).

    The removal game of a part: v(S) is the number of documents that fail a filter of S.  Its
    Hart-Mas-Colell potential is P(empty) = 0, P(S) = (v(S) + sum of P(S without i)) / |S|,
    computed coalition by coalition (smaller ones have smaller numbers) and multiplied by n! so
    that it stays whole; the share of filter i is P(all) - P(all without i).  A step's counts are
    differences of v between the coalitions before and after it.
    """
    n, size = len(letters), 1 << len(letters)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most one per mask
    game = "transform(sequence(0, {last}), s -> aggregate(filter(cells, c -> (c.mask & s) > 0), 0L, (x, c) -> x + c.{of}))"
    games = cells.select(
        "part", F.expr("aggregate(cells, 0L, (x, c) -> x + c.n)").alias("all"),
        *[F.expr(game.format(last=size - 1, of=of)).alias(name) for of, name in (("n", "v"), ("good", "g"), ("toxic", "t"))],
    )
    one = ", ".join(str(1 << i) for i in range(n))
    potential = f"""aggregate(sequence(1, {size - 1}), array(0L), (p, s) -> concat(p, array(
        ({factorial(n)}L * v[s] + aggregate(filter(array({one}), b -> (s & b) > 0), 0L, (x, b) -> x + p[s - b])) div bit_count(s))))"""
    games = games.withColumn("p", F.expr(potential))
    steps = _orders(games.sparkSession, letters)
    wide = games.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) * n - 1)))).join(F.broadcast(steps), "k")
    full = size - 1
    return wide.selectExpr(
        "part", "filter_order", "step", "all - v[after] AS kept", "v[after] - v[before] AS removed", "v[bit] - (v[after] - v[before]) AS redundant",
        f"v[{full}] - v[{full} - bit] AS unique_fails", "g[after] - g[before] AS good_lost", "t[after] - t[before] AS toxic_lost",
        f"p[{full}] - p[{full} - bit] AS shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five filters: part, filter_order, step and seven counts, 600 rows a part.

    Null text is the empty text; the null part counts as ''.  A document fails E if a smaller id
    has the same text; rows without an id come after all others and are never the smaller one, so
    among themselves they pass.  Repeated rows count one by one.  Labels may hold an id more than
    once: it is good (toxic) if one of them says so; labels without an id are left out.  An empty
    table gives an empty table.
    """
    return interactions(stored(failure_counts(docs, labels, doc_id, text, part), "failures"))
