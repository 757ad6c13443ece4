"""Neighbour pyramid, metric index and clique pieces against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import cliques, matching, spatial


def brute_nearest(q, t):
    out = {}
    for key, qid, *p in q:
        best = min((sum((a - b) ** 2 for a, b in zip(p, c)), tid) for k, tid, *c in t if k == key) if any(k == key for k, *_ in t) else None
        if best:
            out[key, qid] = best
    return out


@pytest.mark.parametrize("leaf,depth", [(64, 20), (4, 20), (3, 2)])
def test_nearest(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    monkeypatch.setattr(spatial, "DEPTH", depth)
    rng = np.random.default_rng(4)
    t = [(0, i, *p) for i, p in enumerate(rng.normal(size=(300, 3)).tolist())]  # one dense place
    t += [(0, 300 + i, *p) for i, p in enumerate(rng.uniform(-1e4, 1e4, (60, 3)).tolist())]
    t += [(0, 400 + i, 0.25, 0.25, 0.25) for i in range(20)]  # many in one spot
    t += [(1, i, float(i % 5), float(i // 5), 0.0) for i in range(25)]  # ties on a lattice
    t += [(2, 9, 1.0, 2.0, 3.0)]
    q = [(0, i, *p) for i, p in enumerate(rng.normal(size=(80, 3)).tolist())]
    q += [(0, 100 + i, *p) for i, p in enumerate(rng.uniform(-3e4, 3e4, (40, 3)).tolist())] + [(0, 200, 1e7, -1e7, 3.0), (0, 201, 0.25, 0.25, 0.25)]
    q += [(1, i, x, y, 0.0) for i, (x, y) in enumerate(itertools.product((0.0, 0.5, 1.5, 4.0), repeat=2))]
    q += [(2, 0, 0.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0)]  # the last key has no target
    left = spark.createDataFrame(q, "k int, qid long, x double, y double, z double")
    right = spark.createDataFrame([(*r, r[1] * 2) for r in t], "k int, tid long, x double, y double, z double, more long")
    got = {(r["k"], r["qid"]): (r["d2"], r["tid"], r["more"]) for r in spatial.nearest(left, right, ["k"], ["more"]).collect()}
    want = brute_nearest(q, t)
    assert got.keys() == want.keys()
    for key, (d2, tid) in want.items():
        assert got[key] == (pytest.approx(d2), tid, 2 * tid)


def test_nearest_empty(spark):
    left = spark.createDataFrame([], "k int, qid long, x double, y double, z double")
    right = spark.createDataFrame([], "k int, tid long, x double, y double, z double")
    assert spatial.nearest(left, right, ["k"]).collect() == []


@pytest.mark.parametrize("cell", [512, 9])
def test_mutual_nearest(spark, cell):
    rng = np.random.default_rng(6)
    sides = []
    for n in (150, 130):
        v = np.concatenate([c + rng.normal(0, 0.05, (n // 5, 33)) for c in rng.normal(size=(5, 33)) * 3])
        v[::11] = 0.0  # equal descriptors: ties by id
        sides.append([(g, i, row) for g in (0, 1) for i, row in enumerate((v + g * (np.arange(len(v))[:, None] % 3)).tolist())])
    sides[0].append((2, 0, [1.0] * 33))
    frames = [spark.createDataFrame(s, "g int, id long, desc array<double>") for s in sides]
    from pointloom.functions.scalar import descriptor_distance

    want = matching.mutual_top_k(*frames, ["g"], 4, descriptor_distance).select("g", "src_id", "tgt_id").collect()
    out = matching.mutual_nearest(*frames, ["g"], 4, cell)
    assert sorted(map(tuple, out.select("g", "src_id", "tgt_id").collect())) == sorted(map(tuple, want))
    balls, lists = matching.metric_cells(frames[0], ["g"], cell)
    assert balls.groupBy().sum("n").first()[0] == len(sides[0])
    assert max(len(r["members"]) for r in lists.collect()) <= 2 * cell
    if cell == 9:  # far clusters never meet
        near = matching._near_balls(balls, matching.metric_cells(frames[1], ["g"], cell)[0], ["g"], 4)
        assert near.count() < 0.8 * balls.join(matching.metric_cells(frames[1], ["g"], cell)[0].select("g"), "g").count()


def brute_largest(n, edges):
    adj = set(edges)
    for k in range(n, 1, -1):
        for c in itertools.combinations(range(n), k):
            if all(p in adj for p in itertools.combinations(c, 2)):
                return c


@pytest.mark.parametrize("piece", [12])
def test_clique_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(cliques, "PIECE", piece)
    rng = np.random.default_rng(piece)
    rows, want = [], {}
    for g in range(5):
        n = 11
        density = (0.3, 0.6, 0.9, 1.0, 0.5)[g % 5]
        edges = [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < density]
        if g == 4:
            edges = [(0, 5), (2, 3)]
        rows += [(g, i, j, int(rng.integers(0, 3))) for i, j in edges]
        want[g] = brute_largest(n, edges)
    e = spark.createDataFrame(rows, "g long, u long, v long, min_level int")
    got = {r["g"]: (r["size"], tuple(r["members"])) for r in cliques.max_clique(e, ["g"]).collect()}
    assert got == {g: (len(c), c) for g, c in want.items()}
    above = spark.createDataFrame([(g, len(c) - g % 2) for g, c in want.items()], "g long, bound int")
    assert {r["g"]: tuple(r["members"]) for r in cliques.max_clique(e, ["g"], above).collect()} == {g: c for g, c in want.items() if g % 2}
    levels = {(r["g"], r["level"]): tuple(r["members"]) for r in cliques.max_clique_levels(e, ["g"], 3).collect()}
    for g in range(5):
        kept = ()
        for level in range(3):
            found = brute_largest(11, [(i, j) for h, i, j, m in rows if h == g and m <= level])
            if found is None:
                assert (g, level) not in levels
                continue
            kept = found if len(found) > len(kept) else kept
            assert levels[g, level] == kept
    maximal = {(r["g"], tuple(r["members"])) for r in cliques.maximal_cliques(e, ["g"]).collect()}
    everything = set()
    for g in range(5):
        adj = {(i, j) for h, i, j, _ in rows if h == g}
        found = [c for k in range(3, 12) for c in itertools.combinations(range(11), k) if all(p in adj for p in itertools.combinations(c, 2))]
        everything |= {(g, c) for c in found if not any(set(c) < set(d) for d in found)}
    assert maximal == everything


def planted(rng, n, outliers):
    """Pairs of a clique of true matches, and of false matches that agree by chance."""
    good = n - int(n * outliers)
    i, j = np.triu_indices(n, 1)
    keep = ((i < good) & (j < good)) | (rng.random(len(i)) < 0.05)
    shuffled = rng.permutation(n)
    u, v = shuffled[i[keep]], shuffled[j[keep]]
    return np.minimum(u, v), np.maximum(u, v), sorted(shuffled[:good].tolist())


@pytest.mark.parametrize("n,outliers", [(64, 0.0), (256, 0.4), (512, 0.9), (1024, 0.2), (2048, 0.8)])
def test_large_graphs(n, outliers):
    u, v, good = planted(np.random.default_rng(n), n, outliers)
    found = cliques.largest_clique(u, v, 2)
    assert set(good) <= set(found) and len(found) <= len(good) + 2


def test_near_clique_larger_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(cliques, "PIECE", 2000)
    u, v, good = planted(np.random.default_rng(1), 150, 0.1)
    e = spark.createDataFrame(pd.DataFrame({"g": 1, "u": u, "v": v}))
    out = cliques.max_clique(e, ["g"]).first()
    assert list(out["members"]) == cliques.largest_clique(u, v, 2)
    assert set(good) <= set(out["members"])
