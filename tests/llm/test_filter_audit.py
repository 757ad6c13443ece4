"""The filter audit against orders run one by one."""

import re
from collections import Counter
from itertools import permutations
from random import Random

from pyspark.sql import functions as F

from pointloom.llm.filter_audit import filter_audit, interactions

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failing(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        bad += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (t in first and (i is None or first[t] < i))
        out.append(set(bad))
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = failing(docs)
    out = []
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                             sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_equals_brute_force(spark):
    rnd = Random(9)
    words = ["a", "b", "Cap", "x#", "word", "é", "I", "100%"]
    docs = []
    for i in range(240):
        n = rnd.choice([0, 1, 5, 199, 200, 201, 400])
        some = [rnd.choice(words[: rnd.randrange(1, 9)]) for _ in range(n)] if rnd.random() < 0.5 else [f"w{rnd.randrange(9 * n + 9)}" for _ in range(n)]
        docs.append((i, rnd.choice([" ", "\n", " "]).join(some), rnd.choice(["p", "p", "q", "", None])))
    docs += [(500 + i, docs[i % 5][1], "q") for i in range(80)] + [(3, docs[3][1], "p"), (3, docs[3][1], "q"), (-1, docs[6][1], "z"), (None, docs[7][1], "p"), (None, "only here", "p"), (None, "only here", "q")]
    docs += [(600, None, "p"), (601, None, None), (602, "LONG Text " * 40000, "r"), (602, "LONG Text " * 40000, "r")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (602, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumn("good", F.lit("x")).withColumn("mask", F.lit(3)).repartition(6)
    got = filter_audit(df, spark.createDataFrame(labels, LABELS).withColumn("source", F.lit("x")))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit(docs, labels).collect() == []
    one = [(1, "a b", "s")]
    assert sorted(map(tuple, filter_audit(spark.createDataFrame(one, DOCS), labels).collect())) == brute(one, [])


def test_other_number_of_filters(spark):
    """Three filters: shares of a removal game over masks 0 to 7."""
    rnd = Random(1)
    counts = [("p", m, rnd.randrange(50), 0, 0) for m in range(8)]
    got = interactions(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"), "XYZ").collect()
    v = lambda s: sum(c[2] for c in counts if c[1] & s)
    want = Counter()
    for order in permutations(range(3)):
        s = 0
        for i in order:
            want["XYZ"[i]] += v(s | 1 << i) - v(s)
            s |= 1 << i
    assert len(got) == 18 and {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got} == want
