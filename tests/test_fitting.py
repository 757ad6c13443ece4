import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointloom.config import Config
from pointloom.functions.linalg import with_eigenvalues, with_eigenvector
from pointloom.operators import cliques, consensus, fitting, gaussian_fit
from pointloom.operators.running import with_running_sums
from pointloom.plans.registration import solve_decoupled, solve_from_correspondences

NAMES = ["sx", "sy", "sz", "tx", "ty", "tz"]


def random_rotation(rng, yaw_only=False):
    if yaw_only:
        a = rng.uniform(-3, 3)
        return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q if np.linalg.det(q) > 0 else -q


def scene(rng, n, outliers, noise=0.02, yaw_only=False):
    r, t = random_rotation(rng, yaw_only), rng.uniform(-10, 10, 3)
    src = rng.uniform(-30, 30, (n, 3))
    tgt = src @ r.T + t + rng.normal(0, noise, (n, 3))
    bad = rng.permutation(n)[: int(outliers * n)]
    tgt[bad] = rng.uniform(-40, 40, (len(bad), 3))
    return src, tgt, r, t


def table(spark, scenes):
    rows = []
    for k, (src, tgt, *_) in enumerate(scenes):
        rows += [(k, k + 100, i, *map(float, s), *map(float, t)) for i, (s, t) in enumerate(zip(src, tgt))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["src", "tgt", "corr_id", *NAMES]))


def errors(tf, r, t):
    m = np.array(tf).reshape(4, 4)
    cos = (np.trace(r.T @ m[:3, :3]) - 1) / 2
    return np.degrees(np.arccos(np.clip(cos, -1, 1))), np.linalg.norm(m[:3, 3] - t)


def check(out, scenes, rot=5.0, trans=2.0):
    found = {row["src"]: row["tf"] for row in out.collect()}
    for k, (_, _, r, t) in enumerate(scenes):
        a, b = errors(found[k], r, t)
        assert a < rot and b < trans, (k, a, b)


def test_plain_fit_is_exact(spark):
    rng = np.random.default_rng(1)
    scenes = [scene(rng, 30, 0.0, 0.0) for _ in range(3)]
    check(fitting.fit_pose(table(spark, scenes), ["src", "tgt"]), scenes, 1e-4, 1e-6)


def test_back_ends_recover_transforms(spark):
    rng = np.random.default_rng(2)
    scenes = [scene(rng, 50, f) for f in (0.2, 0.7)]
    corr = table(spark, scenes)
    for cfg in (
        Config(front_end="none", tf_solver="svd", noise_bounds=(0.2,)),
        Config(front_end="none", tf_solver="gnc", noise_bounds=(0.2,)),
        Config(front_end="none", back_end="ransac", ransac_iterations=1000),
        Config(front_end="none", back_end="cliques"),
    ):
        check(solve_from_correspondences(corr, cfg), scenes)


def test_yaw_solver(spark):
    rng = np.random.default_rng(3)
    scenes = [scene(rng, 60, 0.5, yaw_only=True)]
    cfg = Config(front_end="none", tf_solver="quatro", noise_bounds=(0.2,))
    check(solve_from_correspondences(table(spark, scenes), cfg), scenes)


def serial_gnc(a, b, bound):
    """Textbook loop on one group."""
    w, mu, last = np.ones(len(a)), None, np.inf
    for _ in range(100):
        u, _, vt = np.linalg.svd((a * w[:, None]).T @ b)
        d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
        r = vt.T @ d @ u.T
        r2 = ((b - a @ r.T) ** 2).sum(1)
        if mu is None:
            mu = 1 / (2 * r2.max() / bound**2 - 1)
            if mu <= 0:
                break
        cost = (w * r2).sum()
        hi, lo = (mu + 1) / mu * bound**2, mu / (mu + 1) * bound**2
        w = np.where(r2 >= hi, 0, np.where(r2 <= lo, 1, np.sqrt(bound**2 * mu * (mu + 1) / np.maximum(r2, 1e-300)) - mu))
        mu *= 1.4
        if abs(cost - last) < 1e-6:
            break
        last = cost
    return r, w


def test_graduated_rotation_matches_serial_loop(spark):
    rng = np.random.default_rng(4)
    src, tgt, r, _ = scene(rng, 40, 0.3)
    tgt = np.where((np.arange(40) % 3 == 0)[:, None], rng.uniform(-30, 30, (40, 3)), src @ r.T + rng.normal(0, 0.02, (40, 3)))
    poses, rows = fitting.gnc_fit(table(spark, [(src, tgt)]), ["src", "tgt"], 0.4)
    want, weights = serial_gnc(src, tgt, 0.4)
    got = np.array(poses.first()["tf"]).reshape(4, 4)[:3, :3]
    assert np.allclose(got, want, atol=1e-6)
    flags = {x["corr_id"]: x["inlier"] for x in rows.collect()}
    assert [flags[i] for i in range(40)] == list(weights >= 0.5)


def test_geman_mcclure_rotation(spark):
    rng = np.random.default_rng(5)
    src, _, r, _ = scene(rng, 50, 0.0)
    tgt = src @ r.T + rng.normal(0, 0.02, (50, 3))
    tgt[:10] = rng.uniform(-30, 30, (10, 3))
    rows = table(spark, [(src, tgt)])
    out = fitting.graduated_fit(rows, ["src", "tgt"], 1.0, fitting.larger_diameter(rows, ["src", "tgt"]))
    assert errors(out.first()["tf"], r, np.zeros(3))[0] < 1.0


def test_gaussian_refinement(spark):
    rng = np.random.default_rng(6)
    scenes = [scene(rng, 40, 0.2)]
    src, tgt, r, t = scenes[0]
    rows = table(spark, scenes)
    for side in "st":
        rows = rows.withColumns({side + c: F.lit(0.1 if c[0] == c[1] else 0.0) for c in ("xx", "xy", "xz", "yy", "yz", "zz")})
    near = np.eye(4)
    tilt = gaussian_fit.rotation_exp(np.array([[0.02, -0.03, 0.02]]))[0]
    near[:3, :3], near[:3, 3] = tilt @ r, t + 0.3
    start = spark.createDataFrame([(0, 100, [float(v) for v in near.ravel()])], "src long, tgt long, tf array<double>")
    for kind in ("point", "gaussian", "point_gaussian"):
        check(gaussian_fit.refine_pose(rows, start, ["src", "tgt"], kind), scenes, 0.5, 0.2)


def brute_cliques(n, edges):
    adj = {(min(a, b), max(a, b)) for a, b in edges}

    def ok(c):
        return all(p in adj for p in itertools.combinations(c, 2))

    found = [c for k in range(2, 8) for c in itertools.combinations(range(n), k) if ok(c)]
    maximal = [c for c in found if not any(set(c) < set(d) for d in found)]
    return found, maximal


def test_cliques_match_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, want_max, want_all = [], {}, set()
    for g in range(4):
        n = 13
        edges = [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        rows += [(g, i, j) for i, j in edges]
        found, maximal = brute_cliques(n, edges)
        size = max(map(len, found))
        want_max[g] = min(c for c in found if len(c) == size)
        want_all |= {(g, c) for c in maximal if len(c) >= 3}
    e = spark.createDataFrame(rows, "g long, u long, v long")
    got = {r["g"]: tuple(r["members"]) for r in cliques.max_clique(e, ["g"]).collect()}
    assert got == want_max
    assert {(r["g"], tuple(r["members"])) for r in cliques.maximal_cliques(e, ["g"]).collect()} == want_all


def test_tls_sweep_against_all_positions(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(3, 0.1, 40), rng.uniform(-20, 20, 60)])
    rows = spark.createDataFrame([(0, float(v)) for v in x], "g int, x double")
    got = consensus.tls_sweep(rows, ["g"], F.col("x"), F.lit(0.5)).first()

    def cost(at):
        inside = np.abs(x - at) <= 0.5 + 1e-12
        est = x[inside].mean()
        return ((x[inside] - est) ** 2).sum() + 0.5 * (~inside).sum()

    assert abs(got["estimate"] - 3) < 0.2
    assert got["cost"] <= min(cost(v) for v in x) + 1e-6


def test_running_sums_with_a_hot_group(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": np.where(rng.random(5000) < 0.4, 0, rng.integers(1, 50, 5000)), "o": rng.permutation(5000), "v": rng.integers(0, 9, 5000)})
    out = with_running_sums(spark.createDataFrame(pdf), ["g"], ["o"], {"c": F.col("v")}).toPandas().sort_values(["g", "o"])
    want = pdf.sort_values(["g", "o"]).groupby("g")["v"].cumsum()
    assert (out["c"].to_numpy() == want.to_numpy()).all()


def test_eigen_decomposition(spark):
    rng = np.random.default_rng(10)
    mats = [m @ m.T for m in rng.normal(size=(50, 3, 3))] + [np.zeros((3, 3)), np.diag([2.0, 2.0, 2.0]), np.diag([0.0, 0.0, 5.0])]
    rows = [(i, m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]) for i, m in enumerate(mats)]
    rows = [(r[0], *map(float, r[1:])) for r in rows]
    df = with_eigenvector(with_eigenvalues(spark.createDataFrame(rows, "i int, xx double, xy double, xz double, yy double, yz double, zz double")), "l0")
    for r in df.filter("nz * nz <= 1").collect():
        vals, vecs = np.linalg.eigh(mats[r["i"]])
        assert np.allclose([r["l0"], r["l1"], r["l2"]], vals, atol=1e-6 * (1 + vals[2]))
        n = np.array([r["nx"], r["ny"], r["nz"]])
        assert abs(np.linalg.norm(n) - 1) < 1e-6
        if r["i"] < 50 and vals[1] - vals[0] > 1e-2:
            assert abs(n @ vecs[:, 0]) > 1 - 1e-5


def test_decoupled_solver_with_scale(spark):
    rng = np.random.default_rng(11)
    src, tgt, r, t = scene(rng, 40, 0.3)
    out = solve_decoupled(table(spark, [(src, tgt)]), 0.2, estimate_scale=True).first()
    a, b = errors(out["tf"], r, t)
    assert a < 1.0 and b < 0.5 and abs(out["scale"] - 1.0) < 0.01
