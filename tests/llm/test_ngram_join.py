"""Shingle join against brute force."""

import pytest
from pyspark.sql import functions as F

from pointloom.llm import queries
from pointloom.llm.ngram_join import ngram_jaccard_join

from .brute import components, shingles


def brute(rows, k=5, percent=75):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = sets.get(i, frozenset()) | shingles(t, k)
    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    links = []
    for i in ids:
        shared = {}
        for s in sets[i]:
            for j in where[s]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        links += [(i, j) for j, c in shared.items() if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c)]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    got = {r[0]: (r[1], r[2]) for r in queries.QUERIES["op1_ngram_jaccard_join"](spark, root).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows)


@pytest.mark.parametrize("tile", [3, 1500])
def test_edges_and_tiles(spark, tile):
    import random

    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five"), (None, "a b c d e f")]
    at = 10
    for size in (2, 9, 30):  # chains of ever more changed words
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(60)]
        for _ in range(size):
            rows.append((at, " ".join(words)))
            at += 1
            words[rnd.randrange(60)] = f"v{at}"
    rows += [(at, rows[-1][1]), (at, "other text under the same number"), (9, rows[-1][1]), (9, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("ID", F.lit(1))
    out = ngram_jaccard_join(df, tile=tile)
    assert sorted(out.columns) == ["ID", "component_id", "doc_id", "n_shingles", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert all((r["n_shingles"], r["component_id"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (2, None)) for r in got)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
