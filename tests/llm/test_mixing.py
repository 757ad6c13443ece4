"""Mixing sources: targets against rounds of resharing, copies against their bounds."""

from random import Random

import pytest
from pyspark.sql import functions as F

from pointloom.llm.mixing import mix_sources, sample_sources, source_targets, word_count

SCHEMA = "doc_id long, text string, source string"


def reshared(sizes, weights=(5, 2, 1)):
    """Share, cut at the limit, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets(spark):
    rnd = Random(5)
    for n in (1, 2, 3, 8, 40):
        sizes = {f"s{i}": rnd.choice([0, 1, 10, 1000, 30000]) + rnd.randrange(50) for i in range(n)}
        df = spark.createDataFrame([(s, False, v) for s, v in sizes.items()], "source string, unnamed boolean, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_word_count(spark):
    texts = ["", " ", "a", " a b ", "a\tb\nc\x0bd\x0ce\rf", "é x y", "w w  www", "  w"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [0, 0, 1, 2, 6, 2, 3, 2]


def test_copies(spark):
    rnd = Random(2)
    docs = [(i, "w " * int(rnd.paretovariate(1.2) * 5), rnd.choice(["a", "a", "a", "a", "b", "c", "", None])) for i in range(4000)]
    docs += [(7, None, "a"), (7, "x y", "a"), (7, "x y", "a"), (None, "x", "b"), (None, "x", "b"), (None, None, None), (5000, "long " * 60000, "c"), (9000, "", "none")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("copies", F.lit("x")).withColumn("size", F.lit(1)).withColumn("target", F.lit(0))
    got = sample_sources(df.repartition(7)).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = reshared(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(int(rate) <= r["copies"] <= min(2, int(rate) + 1) and r["taken"] == r["copies"] * r["size"] for r in mine)
        if sizes[s] and rate < 2:
            longest = max(r["size"] for r in mine)
            assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(longest / 4, 5)
    again = sample_sources(df.repartition(3, "doc_id")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_emits_each_copy(spark):
    docs = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(60)] + [(None, "x y z", "a"), (3, "x y z", "a")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("copy", F.lit("old")).withColumn("row", F.lit(1))
    mix = mix_sources(df)
    assert mix.columns == ["doc_id", "text", "source", "row", "copy"]
    got = mix.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    taken = sample_sources(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    assert sorted(map(str, got)) == sorted(map(str, taken))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sample_sources(df).collect() == [] and mix_sources(df).collect() == []
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in sample_sources(df).collect()] == [(0, 0.0, 0)] * 2
