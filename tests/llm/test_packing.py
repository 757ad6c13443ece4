"""Packing: nothing lost, nothing too long, few sequences."""

import zlib
from collections import defaultdict
from random import Random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import packing, queries


def check(got, docs, capacity, path, end_id=1):
    t = Tokenizer.from_file(path)
    want = []
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        for piece, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((i if i is not None else -1, piece, s, len(part), zlib.crc32(part.tobytes())))
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert rows == sorted(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(seqs), -(-total // capacity)


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    got = queries.QUERIES["op2_best_fit_packing"](spark, root).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    n, bound = check(got, docs, 4096, public_tokenizers.path("word_bpe_49k.json"))
    assert n <= bound + 1


def test_many_shards_and_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rnd = Random(9)
    docs = [(i, "wo " * rnd.randrange(0, 150)) for i in range(300)] + [(5, None), (5, "twice"), (5, "twice"), (None, "none"), (None, None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("length", F.lit("x")).withColumn("rid", F.lit(1))
    n, bound = check(packing.best_fit_packing(df, path, capacity=128).collect(), docs, 128, path)
    assert n <= bound * 1.02 + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_packing(df, public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_evolution_beats_best_fit():
    rnd = Random(2)
    sizes = []
    for _ in range(60):  # triples that fill a bin exactly
        a = rnd.randrange(250, 400)
        b = rnd.randrange(250, 400)
        sizes += [a, b, 1000 - a - b]
    plain = packing.Packing(sizes, 1000).best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    best = packing.evolve(sizes, 1000, 1, [], generations=200)
    assert sorted(i for b in best.bins for i in b) == list(range(len(sizes)))
    assert 60 <= len(best.bins) < len(plain.bins)
