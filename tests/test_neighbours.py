"""Neighbours and components of many small groups and of large ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import components, descriptors, polar, rangeimage, spatial


def _exchanged(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _roots(n, edges):
    root = np.arange(n)
    for _ in range(n):
        old = root.copy()
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
        if (old == root).all():
            return root


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_components_by_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK_EDGES", chunk)
    rounds = []
    monkeypatch.setattr(components, "_signature", lambda e, f=components._signature: rounds.append(f(e)) or rounds[-1])
    rng = np.random.default_rng(3)
    want, edges, nodes = {}, [], []
    for g, (n, m) in enumerate(((40, 30), (12, 5), (6, 0), (30, 60))):
        pairs = rng.integers(0, n, (m, 2))
        root = _roots(n, pairs)
        want |= {(g, i): int(root[i]) for i in range(n)}
        edges += [(g, (int(u) % 3, int(u)), (int(v) % 3, int(v))) for u, v in pairs]
        nodes += [(g, (i % 3, i)) for i in range(n)]
    e = spark.createDataFrame(edges, "g int, u struct<a: int, b: int>, v struct<a: int, b: int>")
    d = spark.createDataFrame(nodes, "g int, id struct<a: int, b: int>")
    rows = components.connected_components(d, e, keys=["g"]).collect()
    got = {(r["g"], r["id"]["b"]): r["component"] for r in rows}
    assert len(rows) == len(nodes) and got.keys() == want.keys()
    members = {}
    for (g, i), root in want.items():
        members.setdefault((g, root), []).append((i % 3, i))
    assert all(tuple(got[g, i]) == min(members[g, root]) for (g, i), root in want.items())
    assert len(rounds) == 1 if chunk > 7 else len(rounds) > 1  # groups that fit a chunk take no rounds


@pytest.mark.parametrize("azimuth", [360.0, 180.0, 120.0, 60.0])
def test_curved_voxels_wrap_around(spark, azimuth):
    turns = round(360 / azimuth)
    rng = np.random.default_rng(4)
    cells = {(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 4, 40), rng.integers(0, 4, 40), rng.integers(0, turns, 40))}
    df = spark.createDataFrame([(1, *c) for c in cells] * 2, "cloud int, ring int, pitch_bin int, azimuth_bin int")
    out = polar.adjacent(df, ["cloud"], polar.PolarRule(azimuth=azimuth))
    assert _exchanged(out).count("Aggregate") == 0  # pairs are met once and not compared again
    got = sorted((tuple(r["u"]), tuple(r["v"])) for r in out.collect())
    want = sorted((u, v) for u in cells for v in cells if u < v and abs(u[0] - v[0]) <= 1 and abs(u[1] - v[1]) <= 1
                  and (u[2] - v[2]) % turns in (0, 1, turns - 1))
    assert got == want


@pytest.mark.parametrize("most", [512, 5])
def test_radius_pairs_of_small_and_large_keys(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "by_size", lambda sides, keys, f=spatial.by_size: f(sides, keys, most))
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"cloud": np.repeat([1, 2], [4, 60]), "id": np.arange(64), **{a: rng.uniform(0, 9, 64) for a in "xyz"}})
    df = spark.createDataFrame(p)
    out = spatial.radius_pairs(df, df, ["cloud"], 2.5, ["x"])
    if most == 512:
        assert "Generate" not in _exchanged(out)  # no copies for neighbouring cells
    rows = out.collect()
    q = p[["x", "y", "z"]].to_numpy()
    near = (((q[:, None] - q[None]) ** 2).sum(axis=2) <= 6.25) & (p["cloud"].to_numpy()[:, None] == p["cloud"].to_numpy()[None])
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(map(tuple, np.argwhere(near).tolist()))
    assert all(r["ax"] == q[r["a"], 0] and r["bx"] == q[r["b"], 0] for r in rows)


def test_pairs_bring_their_columns(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame(pd.DataFrame({"cloud": 1, "id": np.arange(30), **{a: rng.uniform(0, 9, 30) for a in ("x", "y", "z", "nx", "ny", "nz")}}))
    near = descriptors.oriented_pairs(p, ["cloud"], 3.0, [])
    assert _exchanged(near).count("Join") == 1  # no join back to the points


def test_row_links_copy_few_pixels(spark):
    rule = rangeimage.RangeImageRule(rows=4, cols=200, link_rows=2, link_cols=3, extension=3, link_gap=1.0)
    rng = np.random.default_rng(7)
    p = pd.DataFrame([(1, r, c, 1 + c // 9) for r in range(4) for c in range(200) if rng.random() < 0.6], columns=["cloud", "row", "col", "run"])
    p["x"], p["y"] = p["col"] * 0.3 + rng.uniform(-1, 1, len(p)), rng.uniform(0, 2, len(p))
    pix = spark.createDataFrame(p).select("cloud", F.col("row").cast("int"), F.col("col").cast("int"), F.col("run").cast("int"), "x", "y")
    got = {tuple(r)[1:] for r in rangeimage.link_rows(pix, rangeimage.runs(pix, ["cloud"]), ["cloud"], rule).collect()}
    ends = p.groupby(["row", "run"])["col"].agg(["min", "max"])
    want = set()
    for a in p.itertuples():
        for b in p.itertuples():
            if 1 <= a.row - b.row <= 2 and abs(a.col - b.col) <= 3 and np.hypot(a.x - b.x, a.y - b.y) < 1.0:
                s, t = ends.loc[(a.row, a.run)], ends.loc[(b.row, b.run)]
                if s["min"] <= t["max"] and t["min"] <= s["max"]:
                    want.add((a.row, a.run, b.row, b.run))
    inside = {x for x in got if ends.loc[x[:2]]["min"] <= ends.loc[x[2:]]["max"] and ends.loc[x[2:]]["min"] <= ends.loc[x[:2]]["max"]}
    assert inside == want and want


def _scene(seed, rows=4, cols=60, clouds=(1, 2)):
    """Pixels of clouds, some in runs, and their rule: links reach fewer columns than ends."""
    rng = np.random.default_rng(seed)
    p = pd.DataFrame([(g, r, c, 1 + c // 4) for g in clouds for r in range(rows) for c in range(cols) if rng.random() < 0.5], columns=["cloud", "row", "col", "run"])
    p["run"] = p.groupby(["cloud", "row"])["run"].rank(method="dense").astype(int)  # as counted along the row
    p["x"], p["y"] = p["col"] * 0.25 + rng.uniform(-1, 1, len(p)), rng.uniform(0, 2, len(p))
    return p, rangeimage.RangeImageRule(rows=rows, cols=cols, row_gap=0.7, link_rows=2, link_cols=2, extension=4, link_gap=0.6, skip=3)


def _pixels(spark, p):
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "cloud long, row int, col int, run int, x double, y double")
    return df.repartition(5, "cloud")


def _links(p, rule):
    """Links of runs by comparing all of them: in a row, and with the rows above."""
    ends = {k: g.sort_values("col") for k, g in p.groupby(["cloud", "row", "run"])}
    gap = lambda a, b: np.hypot(a["x"] - b["x"], a["y"] - b["y"])
    most = p.groupby(["cloud", "row"])["run"].max()
    same, cross = set(), set()
    for (g, r, a), pa in ends.items():
        for (h, s, b), pb in ends.items():
            if g != h:
                continue
            if r == s and 1 <= b - a <= rule.skip and most[g, r] > 2 and gap(pa.iloc[-1], pb.iloc[0]) < rule.row_gap:
                same.add((g, r, a, b))
            if 1 <= r - s <= rule.link_rows:
                (sa, ea), (sb, eb) = pa["col"].iloc[[0, -1]], pb["col"].iloc[[0, -1]]
                if eb < sa or ea < sb:
                    near = 0 < sa - eb <= rule.extension and gap(pa.iloc[0], pb.iloc[-1]) < rule.link_gap
                    near |= 0 < sb - ea <= rule.extension and gap(pa.iloc[-1], pb.iloc[0]) < rule.link_gap
                else:
                    near = any(abs(u["col"] - v["col"]) <= rule.link_cols and gap(u, v) < rule.link_gap for _, u in pa.iterrows() for _, v in pb.iterrows())
                if near:
                    cross.add((g, r, a, s, b))
    return same, cross


def test_links_of_runs_stay_where_their_cloud_lies(spark):
    p, rule = _scene(8)
    pix = _pixels(spark, pd.concat([p, p[p["cloud"] == 1].assign(cloud=None)]))
    rs = rangeimage.runs(pix, ["cloud"])
    same, cross = _links(p, rule)
    links = rangeimage.row_links(rs, ["cloud"], rule), rangeimage.link_rows(pix, rs, ["cloud"], rule)
    for df, want in zip(links, (same, cross)):
        rows = [tuple(r) for r in df.collect()]
        assert set(rows) == want and len(rows) == len(want) and want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # nothing but the pixels is exchanged
    apart = {(g, r, a, s, b) for g, r, a, s, b in cross if p[(p.cloud == g) & (p.row == s) & (p.run == b)]["col"].max() < p[(p.cloud == g) & (p.row == r) & (p.run == a)]["col"].min()}
    assert apart and apart < cross


def test_clusters_of_runs(spark):
    p, rule = _scene(9)
    same, cross = _links(p, rule)
    pix = _pixels(spark, pd.concat([p, p[p["cloud"] == 1].assign(cloud=None)]))
    got = rangeimage.cluster(pix, ["cloud"], rule)
    assert got.columns == ["cloud", "row", "run", "col", "x", "y", "cluster"]
    nodes = sorted(set(p[["cloud", "row", "run"]].itertuples(index=False, name=None)))
    at = {n: i for i, n in enumerate(nodes)}
    root = _roots(len(nodes), [(at[g, r, a], at[g, r, b]) for g, r, a, b in same] + [(at[g, r, a], at[g, s, b]) for g, r, a, s, b in cross])
    want = sorted((g, r, n, c, *nodes[root[at[g, r, n]]][1:]) for g, r, c, n in p[["cloud", "row", "col", "run"]].itertuples(index=False, name=None))
    assert sorted((x["cloud"], x["row"], x["run"], x["col"], *x["cluster"]) for x in got.collect()) == want
    assert 1 < len(set(root)) < len(nodes)


def test_points_move_once_to_their_pixels(spark, monkeypatch):
    rng = np.random.default_rng(10)
    xyz = rng.uniform(-20, 20, (300, 3))
    # cloud 0 and the points without a cloud are larger than a partition, half of cloud 0 lies in one pixel
    rows = [(None if i >= 200 else 0 if i < 120 else 1 + i // 20, i, *map(float, xyz[0 if i < 60 else i])) for i in range(300)]
    pts = spark.createDataFrame(rows, "g long, pid long, x double, y double, z double")
    rule = rangeimage.RangeImageRule(rows=9, cols=30, min_angle=-45.0, max_angle=45.0)

    def found():
        df = rangeimage.project(pts, ["g"], ["pid"], rule)
        return df._jdf.queryExecution().executedPlan().toString(), sorted(map(repr, df.collect()))

    plan, want = found()
    assert plan.count("REPARTITION_BY_NUM") == 1 and 0 < len(want) < 300
    monkeypatch.setattr(rangeimage.pairs, "PART_ROWS", 80)
    plan, got = found()
    assert plan.count("REPARTITION_BY_NUM") == 3 and got == want
