"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import with_row_number, with_running_sums
from ._shared import NOT_SPACE, by_size, numbered, own_columns, plain_text, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text: one mark per word is left, then the white space between them goes."""
    return F.length(F.translate(F.regexp_replace(text, NOT_SPACE + "+", "w"), " \t\n\x0b\f\r", "")).cast("long")


def _offset(name: Column, unnamed: Column, draw: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on source, draw and seed alone."""
    key = F.concat_ws("/", F.lit(str(seed)), draw.cast("string"), F.when(unnamed, "null").otherwise(F.concat(F.lit("="), name)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of every source: ``weights`` in turn share ``volume`` times all words, none above ``most`` times its own.

    ``sizes``: source (not null), unnamed (true for the null source), source_size.  What a source
    cannot take goes to the others by weight until none is above its limit.  In the end every
    source below its limit has the same target per weight, its level; with the sources in order of
    limit per weight, the level follows from what the sources before it take, so running sums
    replace the rounds.  Adds ``weight`` and ``target``.
    """
    ranked = with_row_number(sizes.withColumn("_all", F.lit(0)), ["_all"], ["unnamed", "source"], "_rank")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")).cast("double"))
    ranked = ranked.withColumn("_limit", F.lit(float(most)) * F.col("source_size")).withColumn("_ratio", F.col("_limit") / F.col("weight"))
    run = with_running_sums(ranked, ["_all"], ["_ratio", "_rank"], {"_c": F.col("_limit"), "_w": F.col("weight"), "_k": F.lit(1).cast("long")})
    run = stored(run, "targets")
    total = run.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    wanted = F.lit(min(volume, most) * float(total["s"] or 0))
    rest = F.lit(float(total["w"] or 0)) - (F.col("_w") - F.col("weight"))
    level = (wanted - (F.col("_c") - F.col("_limit"))) / rest
    found = run.filter(level <= F.col("_ratio")).agg(F.min_by(level, "_k")).first()[0]
    target = F.least(F.col("_limit"), F.lit(0.0 if found is None else found) * F.col("weight"))
    return run.select("source", "unnamed", "source_size", "weight", target.alias("target"))


def sampled_copies(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, volume: float = 1.5, most: float = 2.0, seed: int = 11, draws: int = 16
) -> DataFrame:
    """Copies of every row of ``rows`` (row: unique number, doc_id, source, size), by systematic sampling within its source.

    Each document of a source expects target / source size copies.  The rows of a source stand
    in order of size; their running sum of expected copies plus the source's random offset
    crosses an integer once per copy, so a row gets the whole number below or above its
    expectation, and never more than ``most``.  The order by size makes each stretch of equal
    sizes give its share.  A source with few long documents may still miss its target by about
    its longest one, so ``draws`` offsets are drawn by hash and the one whose words come
    nearest is used.

    Adds source_size, target, copies and taken (copies times size).
    """
    unnamed, name = F.col("source").isNull(), plain_text(F.col("source").cast("string"))
    keyed = rows.withColumns({"unnamed": unnamed, "source": name})
    sizes = keyed.groupBy("source", "unnamed").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, volume, most), "source-targets")
    small = by_size(targets, targets.count(), 256)
    keys = ["source", "unnamed"]
    placed = with_row_number(keyed, keys, [F.desc("size"), F.asc_nulls_last("doc_id"), "row"], "_place").join(small, keys)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = stored(placed.withColumn("_rate", rate), "placed")

    def copies(u: Column) -> Column:
        upto, before = F.col("_rate") * F.col("_place") + u, F.col("_rate") * (F.col("_place") - 1) + u
        return (F.floor(upto) - F.floor(before)).cast("long")

    offset = [_offset(F.col("source"), F.col("unnamed"), F.lit(j), seed) for j in range(draws)]
    # the offsets of a source are computed once, in the small table
    drawn = stored(targets.withColumn("_u", F.array(*offset)), "offsets")
    n = drawn.count()
    tried = placed.join(by_size(drawn.select(*keys, "_u"), n, 256 + 8 * draws), keys)
    words = [F.sum(copies(F.col("_u")[j]) * F.col("size")).alias(f"_t{j}") for j in range(draws)]
    miss = F.array(*[F.struct(F.abs(F.col(f"_t{j}") - F.col("target")).alias("miss"), F.lit(j).alias("draw")) for j in range(draws)])
    best = tried.groupBy(*keys, "target").agg(*words).select(*keys, F.array_min(miss)["draw"].alias("_draw"))
    chosen = stored(drawn.join(best, keys).select(*keys, F.element_at("_u", F.col("_draw") + 1).alias("_u")), "chosen")
    out = placed.join(by_size(chosen, n, 256), keys).withColumn("copies", copies(F.col("_u")))
    source = F.when(~F.col("unnamed"), F.col("source")).alias("source")
    return out.select("row", "doc_id", source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document with the copies that the mix takes of it, without its text.

    Returns doc_id, source, size (words of ``[^\\x20\\x09-\\x0D]+``), source_size, target,
    copies, taken; the options are those of ``sampled_copies``.  Null text has size 0; the null
    source is one of its own, after all others; rows without an id, rows that share one and
    repeated rows are sampled one by one; an empty table gives an empty table.  Sources without
    words have a target of 0 and take nothing.  Reruns agree.
    """
    row = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(plain_text(text)).alias("size"))
    rows = stored(row.withColumn("row", F.monotonically_increasing_id()), "sizes")
    return sampled_copies(rows, **options).drop("row")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: all columns of ``docs``, each document once per copy taken, and ``copy`` (from 0).

    A column of ``docs`` named ``copy`` is replaced.  Odd rows are treated as in ``sample_sources``.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "copy"])
    at = own_columns(docs, "copy") + "row"
    known = numbered(docs, doc_id, at)
    rows = known.select(F.col(at).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(plain_text(text)).alias("size"))
    taken = sampled_copies(stored(rows, "sizes"), **options).filter("copies > 0").select(F.col("row").alias(at), F.col("copies").alias(at + "n"))
    copy = F.explode(F.sequence(F.lit(0), (F.col(at + "n") - 1).cast("int"))).alias("copy")
    return known.join(taken, at).select(*docs.columns, copy)
