"""Near-duplicate vectors against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import near_dup, queries

from .brute import components


def brute(rows, threshold=0.98):
    """rows: (id, vector, label); one result per row."""
    ok = []
    for i, (_, v, label) in enumerate(rows):
        x = np.array([np.nan if e is None else e for e in v], float) if v else np.zeros(1)
        if label is not None and v and np.isfinite(x).all() and x.any():
            ok.append((i, x / np.sqrt(x @ x), label))
    links = []
    for label in {x[2] for x in ok}:
        own = [x for x in ok if x[2] == label]
        for d in {len(x[1]) for x in own}:
            same = [x for x in own if len(x[1]) == d]
            m = np.array([x[1] for x in same])
            for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
                links.append((same[a][0], same[b][0]))
    comp = components(range(len(rows)), links)
    count = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    least = {}
    for i, (vid, _, _) in enumerate(rows):
        if vid is not None:
            least[comp[i]] = min(vid, least.get(comp[i], vid))
    return [(vid, int(count[i]), least.get(comp[i]), vid == least.get(comp[i])) for i, (vid, _, _) in enumerate(rows)]


def test_whole_table(spark):
    root = "/root/testdata/sf0.01"
    got = sorted(tuple(r)[:4] for r in queries.QUERIES["op5_embedding_near_dup"](spark, root).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == sorted(brute(rows))


def test_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 40)
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal(16)
    rows = [(i, (base + 0.05 * rnd.standard_normal(16)).tolist(), 1) for i in range(150)]
    rows += [(i, rnd.standard_normal(16).tolist(), i % 3) for i in range(200, 500)]
    rows += [(i, base.tolist(), 2) for i in range(600, 640)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 16, 1), (703, [None] + base.tolist()[1:], 1), (704, [float("nan")] * 16, 1), (705, [float("inf")] * 16, 1)]
    rows += [(706, base.tolist(), None), (707, base.tolist()[:8], 1), (708, (1e30 * base).tolist(), 1), (600, base.tolist(), 2), (None, base.tolist(), 2), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).withColumn("grp", F.lit("g")).withColumn("kept", F.lit(0))
    out = near_dup.embedding_near_dup(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in out], key=key)
    assert got == sorted([r[:3] for r in brute(rows)], key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_dup.embedding_near_dup(df).collect() == []


def test_links_between_groups_that_fill_their_lists(spark):
    rnd = np.random.default_rng(8)
    a, b = np.linalg.qr(rnd.standard_normal((16, 2)))[0].T
    far = 0.985 * a + np.sqrt(1 - 0.985**2) * b
    rows = [(i, ((a if i < 150 else far) + 0.001 * rnd.standard_normal(16)).tolist(), 1) for i in range(300)]
    rows += [(i, rnd.standard_normal(16).tolist(), i % 2 * 2) for i in range(400, 500)]  # no other vector of label 1 leads from group to group
    out = near_dup.embedding_near_dup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert got == sorted(brute(rows))
    assert got[200][1:3] == (299, 0) and {r["audit_recall"] for r in out} == {1.0}


def test_audit_counts_vectors_not_links(spark):
    turn = lambda w: [float(np.cos(w)), float(np.sin(w))]
    rows = [(i, turn(0.0001 * i)) for i in range(50)] + [(100, turn(2.0)), (101, turn(2.01))]
    vectors = spark.createDataFrame([(i, "2:1", 1, bytearray(np.array(v).tobytes())) for i, v in rows], "id long, grp string, mult long, vec binary")
    counts = spark.createDataFrame([(i, 49) for i in range(50)], "id long, n long")
    assert abs(near_dup._audit(vectors, counts, 0.98) - 50 / 52) < 1e-9
    assert near_dup._audit(vectors.filter("id in (0, 100)"), counts.filter("n < 0"), 0.98) is None
