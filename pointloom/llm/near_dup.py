"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._shared import numbered, own_columns, stored

#: Members of a block, or of one local join, that are compared at once.
BLOCK, JOIN, TILE = 1024, 64, 1000
#: Vectors of the audit: a bounded, documented sample that is compared with all vectors.
AUDIT = 256
#: Rounds of blocks and turns before a recall below the bound is an error.
ATTEMPTS = 12
_VECTOR = "nid bigint, grp string, vec binary"
_NEAR = "id bigint, nb bigint, sim double"


def _unit(batches):
    """Unit vectors as bytes; vectors without a direction are left out."""
    for batch in batches:
        out = []
        for nid, label, v in zip(*[batch.column(c).to_pylist() for c in ("nid", "label", "v")]):
            if label is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            x = x / top
            out.append((nid, f"{len(x)}:{label}", (x / np.sqrt(x @ x)).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary()))], ["nid", "grp", "vec"])


def _matrix(column, kind=np.float64) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1).astype(kind)


def _codes(tables: range):
    """Sides of random hyperplanes: (table, code) per vector, with as many planes as the group asks for."""

    def run(batches):
        for batch in batches:
            ids, grps, bits, vecs = (batch.column(c).to_pylist() for c in ("id", "grp", "bits", "vec"))
            out = []
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_dim.setdefault(len(v) // 8, []).append(i)
            for dim, rows in by_dim.items():
                x = np.frombuffer(b"".join(vecs[i] for i in rows), np.float64).reshape(len(rows), dim)
                for t in tables:
                    planes = np.random.default_rng(1000 + t).standard_normal((dim, 48))
                    side = x @ planes > 0
                    for i, s in zip(rows, side):
                        out.append((ids[i], grps[i], t, np.packbits(s[: bits[i]]).tobytes(), vecs[i]))
            if out:
                types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "grp", "t", "code", "vec"])

    return run


def _nearest(k: int):
    """The ``k`` most similar members for each member of a group."""

    def run(key, table):
        ids = np.array(table.column("id").to_pylist(), np.int64)
        if len(ids) < 2:
            return pa.table({"id": pa.array([], pa.int64()), "nb": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        x = _matrix(table.column("vec"), np.float32)
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        n = min(k, len(ids) - 1)
        best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
        values = np.take_along_axis(sim, best, 1).round(5).astype(np.float64)
        return pa.table({"id": np.repeat(ids, n), "nb": ids[best.ravel()], "sim": values.ravel()})

    return run


def _lists(near: DataFrame, sizes: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """(id, k, nbs): the best neighbours; a list full of links may be twice as long next time."""
    best = near.groupBy("id", "nb").agg(F.max("sim").alias("sim")).groupBy("id").agg(F.collect_list(F.struct("sim", "nb")).alias("l"))
    best = best.join(sizes, "id", "left").withColumn("k", F.coalesce("k", F.lit(k))) if sizes is not None else best.withColumn("k", F.lit(k))
    best = best.withColumn("nbs", F.slice(F.sort_array("l", asc=False), 1, F.col("k")))
    full = (F.size("nbs") == F.col("k")) & (F.element_at("nbs", -1)["sim"] >= threshold)
    return best.select("id", F.when(full, F.least(2 * F.col("k"), F.lit(JOIN))).otherwise(F.col("k")).alias("k"), "nbs")


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.explode("nbs").alias("e")).select("id", "e.nb", "e.sim")


def _blocks(vectors: DataFrame, tables: range, k: int) -> DataFrame:
    """First neighbours: the members of random-projection blocks, large blocks in random parts."""
    size = vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(48), F.ceil(F.log2(F.col("n") / 64)))).cast("int")
    coded = vectors.join(size.select("grp", bits.alias("bits")), "grp").select("id", "grp", "bits", "vec")
    coded = stored(coded.mapInArrow(_codes(tables), "id bigint, grp string, t int, code binary, vec binary"), "codes")
    parts = coded.groupBy("grp", "t", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    coded = coded.join(parts, ["grp", "t", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.col("parts")))
    return coded.groupBy("grp", "t", "code", "part").applyInArrow(_nearest(k), _NEAR)


def _descend(vectors: DataFrame, edges: DataFrame, k: int, turn: int) -> DataFrame:
    """Neighbours of neighbours: everything that lists a vector, or is listed by it, is compared.

    A vector with many neighbours compares them in parts, dealt anew each turn.
    """
    both = edges.select(F.col("nb").alias("center"), "id").unionByName(edges.select(F.col("id").alias("center"), F.col("nb").alias("id"))).distinct()
    parts = both.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / JOIN).alias("parts"))
    rows = both.join(parts, "center").withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts")))
    rows = rows.join(vectors.select("id", "vec"), "id").select("center", "part", "id", "vec")
    return rows.groupBy("center", "part").applyInArrow(_nearest(k), _NEAR)


def _tile_links(threshold: float):
    """Exact links between two tiles of a candidate component: counts, and edges that connect.

    Rows: (u, null, n) with the copies that u links to, and (u, v, null) for a spanning forest.
    """

    def run(key, table):
        side = np.array(table.column("side").to_pylist())
        ids, mult = (np.array(table.column(c).to_pylist(), np.int64) for c in ("id", "mult"))
        x = _matrix(table.column("vec"))
        own = key[1].as_py() == key[2].as_py()
        a = np.flatnonzero(side == 0)
        b = a if own else np.flatnonzero(side == 1)
        link = x[a] @ x[b].T >= threshold
        if own:
            np.fill_diagonal(link, False)
        u, v, n = ids[a].tolist(), [None] * len(a), (link @ mult[b]).tolist()
        if not own:
            u, v, n = u + ids[b].tolist(), v + [None] * len(b), n + (link.T @ mult[a]).tolist()
        root = {i: i for i in ids.tolist()}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for row, hits in zip(ids[a].tolist(), link):
            for other in ids[b][hits].tolist():
                p, q = find(row), find(other)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    u.append(row)
                    v.append(other)
                    n.append(None)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _leaders(reach: float):
    """Members of a tile such that each other one lies within the angle ``reach`` of one, and the largest angle."""

    def run(key, table):
        ids = table.column("id").to_pylist()
        vecs = table.column("vec").to_pylist()
        x, left, out = _matrix(table.column("vec")), np.arange(len(ids)), []
        while len(left):
            cos = x[left] @ x[left[0]]
            own = cos >= np.cos(reach)
            own[0] = True
            out.append((key[0].as_py(), key[1].as_py(), ids[left[0]], vecs[left[0]], float(np.arccos(np.clip(cos[own].min(), -1, 1)))))
            left = left[~own]
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["grp", "component", "id", "vec", "radius"])

    return run


def _close_balls(threshold: float):
    """Pairs of components of which two balls around leaders may hold a link."""

    def run(key, table):
        side = np.array(table.column("side").to_pylist())
        comp, radius = np.array(table.column("component").to_pylist(), np.int64), np.array(table.column("radius").to_pylist())
        x = _matrix(table.column("vec"))
        a = np.flatnonzero(side == 0)
        b = a if key[1].as_py() == key[2].as_py() else np.flatnonzero(side == 1)
        angle = np.arccos(np.clip(x[a] @ x[b].T, -1, 1))
        close = (angle <= np.arccos(threshold) + radius[a][:, None] + radius[b] + 1e-6) & (comp[a][:, None] != comp[b])
        i, j = np.nonzero(close)
        pairs = np.unique(np.stack([comp[a][i], comp[b][j]], 1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return run


def _between(vectors: DataFrame, lists: DataFrame, comp: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u, v): components that may be linked by vectors whose lists are full of links.

    A list with room holds all links found for its vector.  Full lists may have lost those to
    other components, so all balls of such vectors are compared by the triangle inequality.
    """
    full = lists.filter((F.size("nbs") >= k) & (F.element_at("nbs", -1)["sim"] >= threshold - 1e-4)).select("id")
    wide = full.join(comp, "id").join(vectors.select("id", "grp", "vec"), "id")
    wide = wide.join(wide.select("grp", "component").distinct().groupBy("grp").count().filter("count > 1").select("grp"), "grp", "left_semi")
    tiles = wide.groupBy("grp", "component").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    wide = wide.join(tiles, ["grp", "component"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).select("grp", "component", "tile", "id", "vec")
    schema = "grp string, component bigint, id bigint, vec binary, radius double"
    balls = stored(wide.groupBy("grp", "component", "tile").applyInArrow(_leaders(np.arccos(threshold) / 2), schema), "balls")
    tiles = balls.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    balls = balls.join(tiles, "grp").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = balls.select("grp", "component", "tile", "vec", "radius", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    rows = rows.select(
        "grp", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), (F.col("tile") > F.col("o")).cast("int").alias("side"), "component", "vec", "radius"
    )
    return stored(rows.groupBy("grp", "i", "j").applyInArrow(_close_balls(threshold), "u bigint, v bigint"), "close")


def _exact(vectors: DataFrame, lists: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) links of each class and (u, v) edges, both exact inside the components of the lists.

    Components that ``_between`` finds close are counted as one; only true links connect.
    """
    near = _edges(lists).filter(F.col("sim") >= threshold - 1e-4).select(F.col("id").alias("u"), F.col("nb").alias("v"))
    near = stored(near, "near")
    nodes = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    comp = stored(connected_components(nodes, near).select("id", "component"), "components")
    close = _between(vectors, lists, comp, k, threshold)
    if not close.isEmpty():
        near = stored(near.unionByName(close), "near")
        comp = stored(connected_components(nodes, near).select("id", "component"), "components")
    tiles = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = comp.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).join(vectors, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    rows = placed.select("component", "tile", "id", "mult", "vec", other)
    rows = rows.select(
        "component", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), (F.col("tile") > F.col("o")).cast("int").alias("side"), "id", "mult", "vec"
    )
    found = stored(rows.groupBy("component", "i", "j").applyInArrow(_tile_links(threshold), "u bigint, v bigint, n bigint"), "links")
    counts = found.filter("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    return counts, found.filter("v is not null").select("u", "v")


def _audit(vectors: DataFrame, counts: DataFrame, threshold: float) -> float | None:
    """Mean share of its true links that were found for a vector that has links; None if the sample has none.

    Half of the bounded sample are vectors with links found, half without, each counted for as
    many as its half stands for.
    """
    known = vectors.join(counts, "id", "left").withColumn("linked", F.coalesce(F.col("n") > 0, F.lit(False)))
    there = {r["linked"]: r["count"] for r in known.groupBy("linked").count().collect()}
    asked = [r for half in (True, False) for r in known.filter(F.col("linked") == half).orderBy(F.xxhash64("id")).limit(AUDIT // 2).collect()]
    queries: dict[str, tuple[list[int], list]] = {}
    for r in asked:
        ids, vecs = queries.setdefault(r["grp"], ([], []))
        ids.append(r["id"])
        vecs.append(np.frombuffer(bytes(r["vec"]), np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast({g: (np.array(i), np.array(v)) for g, (i, v) in queries.items()})

    def run(batches):
        for batch in batches:
            total: dict[int, int] = {}
            ids, grps, mult, vecs = (batch.column(c).to_pylist() for c in ("id", "grp", "mult", "vec"))
            for g in set(grps) & set(shared.value):
                rows = [i for i, x in enumerate(grps) if x == g]
                x = np.frombuffer(b"".join(vecs[i] for i in rows), np.float64).reshape(len(rows), -1)
                own, q = shared.value[g]
                link = (q @ x.T >= threshold) & (own[:, None] != np.array([ids[i] for i in rows])[None, :])
                for i, n in zip(own.tolist(), (link @ np.array([mult[i] for i in rows])).tolist()):
                    total[i] = total.get(i, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])

    truth = {r["id"]: r["n"] for r in vectors.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    stands = {half: n / min(n, AUDIT // 2) for half, n in there.items()}
    share = [(stands[r["linked"]], min(1.0, (r["n"] or 0) / truth[r["id"]])) for r in asked if truth.get(r["id"])]
    return sum(w * x for w, x in share) / sum(w for w, _ in share) if share else None


def embedding_near_dup(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    k: int = 8,
    tables: int = 6,
    turns: int = 8,
    recall: float = 0.97,
) -> DataFrame:
    """Add n_links, component_id, kept and audit_recall: vectors of one label with a cosine of ``threshold``.

    1. Equal vectors of a label are one class with a count.
    2. Random-projection blocks give each class its first ``k`` neighbours.
    3. NN-descent: neighbours of neighbours are compared turn by turn until hardly a list
       changes; a list full of links doubles (to 64).
    4. Edges at the threshold connect components; components with full lists that balls around
       their members cannot keep apart are taken together.  Inside each, all members are compared
       exactly, in double precision and tile by tile, so ``n_links`` does not depend on list lengths.
    5. A bounded sample is compared with all vectors.  Below the wanted ``recall`` more blocks and
       turns follow, and after ``ATTEMPTS`` an error; ``audit_recall`` says what was reached (null
       if the sample has no links).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
    null label link with nothing; vectors of unequal length do not either.  ``component_id`` is the
    smallest vec_id reachable (null for rows without one that are alone), ``kept`` whether it is the
    row's own.  Rows with null or repeated ids are vectors of their own.  Columns of ``df`` with the
    new names are replaced; an empty table gives an empty table.
    """
    new = ("n_links", "component_id", "kept", "audit_recall")
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    p = own_columns(df, *new)
    df = numbered(df, vec_id, f"{p}n")
    raw = df.select(F.col(f"{p}n").alias("nid"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
    units = stored(raw.mapInArrow(_unit, _VECTOR), "vectors")
    vectors = stored(units.groupBy("grp", "vec").agg(F.min("nid").alias("id"), F.count(F.lit(1)).alias("mult")), "classes")
    total = vectors.count()

    lists, seeds, reached = None, 0, 0.0
    for _ in range(ATTEMPTS):
        near = _blocks(vectors, range(seeds, seeds + tables), k)
        seeds += tables
        if lists is not None:
            near = near.unionByName(_edges(lists))
        lists = stored(_lists(near, None if lists is None else lists.select("id", "k"), k, threshold), "lists")
        for turn in range(turns):
            edges = _edges(lists)
            merged = edges.unionByName(_descend(vectors, edges, k if turn % 2 else 2 * k, turn))
            after = stored(_lists(merged, lists.select("id", "k"), k, threshold), "lists")
            fresh = _edges(after).join(edges.select("id", "nb"), ["id", "nb"], "left_anti").filter(F.col("sim") >= 0.5 * threshold).count()
            lists = after
            if fresh <= 0.001 * total * k:
                break
        counts, links = _exact(vectors, lists, k, threshold)
        reached = _audit(vectors, counts, threshold)
        if reached is None or reached >= recall:
            break
    else:
        raise RuntimeError(f"recall {reached:.4f} is below {recall} after {ATTEMPTS} attempts")

    found = connected_components(vectors.select("id"), links) if not links.isEmpty() else vectors.select("id", F.col("id").alias("component"))
    info = vectors.join(found, "id").join(counts, "id", "left").select("grp", "vec", "mult", "component", F.coalesce("n", F.lit(0)).alias("n"))
    info = units.join(info, ["grp", "vec"]).select(F.col("nid").alias(f"{p}n"), (F.col("n") + F.col("mult") - 1).alias("n_links"), F.col("component").alias(f"{p}c"))
    out = df.join(info, f"{p}n", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    out = out.withColumn(f"{p}c", F.coalesce(f"{p}c", -1 - F.col(f"{p}n")))
    least = out.groupBy(f"{p}c").agg(F.min(F.col(vec_id)).cast("long").alias("component_id"))
    out = out.join(least, f"{p}c").withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.col("component_id").isNull()))
    return out.withColumn("audit_recall", F.lit(reached).cast("double")).drop(f"{p}n", f"{p}c")
