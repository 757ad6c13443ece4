"""Language model: exact base scores, filter counts, and what scores are good for."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import lm, queries

from .brute import words


def brute(rows):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in rows]
    count = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for (i, t), h in zip(rows, held):
        toks = [*words(t), None]
        out.append((i, h, len(toks), sum(count[x] > 0 for x in toks), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in toks)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12, atol=1e-9)


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.QUERIES["op8_lm_score"](spark, root).collect()]
    same(got, brute([tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]))
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    per = lambda c, h: sum(g[c] for g in got if g[1] == h) / sum(g[2] for g in got if g[1] == h)
    assert per(6, False) > per(5, False)  # the bigram model fits what it has learnt
    assert per(6, True) > per(5, True) - 0.05


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "_PACK_BYTES", 300)  # many packs
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["the", "a", "Cat", "dog", f"w{i}", "é"]) for _ in range(rnd.randrange(40)))) for i in range(80)]
    rows += [(1, "again"), (1, "again"), (None, None), (None, "the the"), (200, "word " * 3000), (201, "\t\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("s")).withColumn("rid", F.lit(0))
    out = lm.lm_score(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "rid", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    same([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in out.collect()], brute(rows))


def test_empty_table(spark):
    assert lm.lm_score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(1, "all held out")], "doc_id long, text string")
    row = lm.lm_score(only, held=F.lit(True)).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0)


def test_filter_never_undercounts(spark):
    rnd = random.Random(1)
    texts = [" ".join(f"w{min(int(rnd.expovariate(0.02)), 900)}" for _ in range(200)) for _ in range(50)]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    toks, counts = lm._tokens([t.encode() for t in texts])
    for n in (1, 2):
        h = lm._grams(toks, counts, n)
        keys, times = np.unique(h[h != 0], return_counts=True)
        level = model.level(keys)
        want = lm.quantised(times, 2.0)
        assert (level >= want).all() and (level == want).mean() > 0.97
    strange = lm.mixed(np.arange(1, 5000, dtype=np.uint64))
    assert (model.level(strange) == 0).mean() > 0.97


def test_same_scores_as_the_broadcast_filter(spark, monkeypatch):
    monkeypatch.setattr(lm, "_PACK_BYTES", 20_000)
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randrange(2000)}" for _ in range(150))) for i in range(300)] + [(None, None), (7, ""), (7, "w1 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))
    for order in (1, 2, 3):
        model = lm.train(df.filter(~held), order=order)
        got = lm.lm_score(df, held=held, order=order).collect()
        toks, counts = lm._tokens([(r["text"] or "").encode() for r in got])
        want = np.add.reduceat(model.log_probabilities(toks, counts), np.cumsum(counts) - counts)
        assert np.allclose([r["score"] for r in got], want, rtol=1e-12) and {r["train_tokens"] for r in got} == {model.n_tokens}
        if order == 2:
            per = lambda h: sum(r["score"] for r in got if r["held_out"] == h) / sum(r["n_tokens"] for r in got if r["held_out"] == h)
            assert per(False) > per(True) + 0.5  # seen and unseen text stay apart
            assert lm.train(df, filter_bytes=512).filter is None
    assert lm.lm_score(df, held=F.lit(True)).filter("score is not null").count() == len(rows)
