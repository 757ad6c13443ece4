"""Repeated byte strings against a scan of all windows."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import queries
from pointloom.llm import suffix_dedup as sd


def brute(docs, width=100):
    """docs: (key, bytes) in order."""
    seen, out = set(), {}
    for key, body in docs:
        gone = np.zeros(len(body) + 1, np.int32)
        for s in range(len(body) - width + 1):
            w = body[s : s + width]
            if w in seen:
                gone[s] += 1
                gone[min(s + width, len(body))] -= 1
            seen.add(w)
        mask = np.cumsum(gone)[: len(body)] > 0
        kept = np.frombuffer(body, np.uint8)[~mask].tobytes()
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        out[key] = (len(body), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op4_suffix_dedup"](spark, root).collect()}
    rows = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == brute([(i, (t or "").encode()) for i, t in rows])


def _texts():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdé\0 ") for _ in range(n))
    shared = [word(n) for n in (99, 100, 101, 150, 400)]
    out = [None, "", "a" * 99, "a" * 100, "a" * 101, "b" * 1000, "ab" * 400, "xyz" * 300 + "!" + "xyz" * 300, "b" * 500]
    for i in range(60):
        out.append(word(rnd.randrange(200)) + rnd.choice(shared) + word(rnd.randrange(300)) + rnd.choice(shared)[: rnd.randrange(90, 400)] + word(9))
    return out + out[-5:] + [shared[4] * 3]


def test_edges(spark):
    texts = _texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_repeated_and_null_ids_and_clashing_names(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("qwertyuiop") for _ in range(300))
    rows = [(7, long), (7, long), (3, long[:200] + "tail"), (None, long + "x"), (7, "other"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("u")).withColumn("n_spans", F.lit(5))
    got = sd.suffix_dedup(df, with_text=True).collect()
    assert len(got) == len(rows)
    left = sorted((r["doc_id"] or -1, r["clean_text"], r["uid"]) for r in got)
    assert left == sorted([(3, long[:200] + "tail", "u"), (7, long[200:], "u"), (7, long[200:], "u"), (7, "other", "u"), (-1, "x", "u"), (-1, "", "u")])


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PIECE", 700)
    rnd = random.Random(2)
    body = bytes(rnd.randrange(97, 123) for _ in range(900))
    texts = [body * 3 + b"z", body[:500], b"k" * 5000]
    got = [(d, p, sorted(a["pos"] + o)) for d, p, a, o in ((ids[0], part[0][:5], sd._anchors(part, 100), off[0]) for ids, off, part in sd._pieces([1, 2, 3], texts, 100))]
    assert len(got) > 5
    rows, want = [], brute(list(enumerate(texts)))
    found = {i: set() for i in range(3)}
    for ids, offs, part in sd._pieces([0, 1, 2], texts, 100):
        a = sd._anchors(part, 100)
        for d, s in zip(a["rdoc"], a["rstart"]):
            found[ids[d]].add(int(s) + offs[d])
        rows += [(ids[d], int(p) + offs[d], int(p - h), int(p - lo), part[d][lo : h + 100]) for d, p, lo, h in zip(a["doc"], a["pos"], a["lo"], a["hi"])]
    rows.sort()
    r, off = sd.repeated_windows([x[4] for x in rows], np.array([x[2] for x in rows]), np.array([x[3] for x in rows]), 100)
    for i, o in zip(r, off):
        found[rows[i][0]].add(rows[i][1] - int(o))
    for i, starts in found.items():
        covered = set()
        for s in starts:
            covered |= set(range(s, s + 100))
        assert len(covered) == want[i][1]


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
