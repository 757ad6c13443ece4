"""Maximum and maximal cliques.

Maximum cliques are searched in pieces of bounded size.  A group whose edges fit one piece
is one; a larger group first gets a greedy lower bound, loses every vertex with too few
neighbours for it, and is then opened vertex by vertex: with edges pointed from low to high
(degree, id), each clique lies among the later neighbours of its lowest vertex, so the
triangles of a vertex are the edges of its piece.  Pieces that are still too large are opened
again by their second vertex, and so on; no row or task ever holds more than one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .compatibility import degrees, oriented, triangles
from .voxels import top_k

#: Edges of a piece that one task searches.
PIECE = 1 << 20
#: Neighbours of a seed vertex that the greedy bound of a large group looks at.
SEED_WIDTH = 2048


def neighbourhoods(edges: DataFrame, keys: list[str], earlier: bool = False) -> DataFrame:
    """Per vertex: later neighbours, the edges among them, and on request the edges
    from earlier neighbours to later ones (used to reject non-maximal cliques)."""
    o = cut_lineage(oriented(edges.select(*keys, "u", "v"), keys))
    later = o.groupBy(*keys, F.col("lo.i").alias("apex")).agg(F.collect_list("hi.i").alias("later"))
    t = triangles(edges.select(*keys, "u", "v"), keys)
    link = F.struct(F.col("b").alias("p"), F.col("c").alias("q"))
    inner = t.groupBy(*keys, F.col("a").alias("apex")).agg(F.collect_list(link).alias("links"))
    out = later.join(inner, [*keys, "apex"], "left")
    if earlier:
        link = F.struct(F.col("a").alias("p"), F.col("c").alias("q"))
        outer = t.groupBy(*keys, F.col("b").alias("apex")).agg(F.collect_list(link).alias("outer"))
        out = out.join(outer, [*keys, "apex"], "left")
    return out


def _adjacency(later, links) -> tuple[list[int], list[int]]:
    ids = sorted(int(i) for i in later)
    at = {v: k for k, v in enumerate(ids)}
    masks = [0] * len(ids)
    for link in links if links is not None else ():
        p, q = at[link["p"]], at[link["q"]]
        masks[p] |= 1 << q
        masks[q] |= 1 << p
    return ids, masks


class _Graph:
    """A small graph as bit sets, vertices in ascending id order."""

    def __init__(self, u: np.ndarray, v: np.ndarray, at_least: int):
        """Vertices that cannot be in a clique of ``at_least`` are peeled off first."""
        ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = flat[: len(u)], flat[len(u) :]
        while len(u):
            degree = np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
            keep = degree >= at_least - 1
            inside = keep[u] & keep[v]
            if inside.all():
                break
            u, v = u[inside], v[inside]
        used = np.unique(np.concatenate([u, v]))
        self.ids = ids[used].tolist()
        at = np.full(len(ids), -1)
        at[used] = np.arange(len(used))
        self.ends = at[u], at[v]
        self.degree = np.bincount(np.concatenate(self.ends), minlength=len(used)) if len(used) else np.empty(0, np.int64)

    def masks(self, some: np.ndarray | None = None) -> list[int]:
        """Neighbours of each vertex as bits; of the subgraph on ``some`` sorted vertices if given."""
        (u, v), n = self.ends, len(self.ids)
        if some is not None:
            place = np.full(n, -1)
            place[some] = np.arange(len(some))
            inside = (place[u] >= 0) & (place[v] >= 0)
            u, v, n = place[u[inside]], place[v[inside]], len(some)
        width = -(-n // 8)
        out: list[int] = []
        first, second = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        for i in range(0, n, 1024):  # some rows at a time: the bits of all are n * n / 8 bytes
            lo, hi = np.searchsorted(first, [i, min(n, i + 1024)])
            rows = np.zeros((min(n, i + 1024) - i, width * 8), np.uint8)
            rows[first[lo:hi] - i, second[lo:hi]] = 1
            packed = np.packbits(rows, axis=1, bitorder="little")
            out += [int.from_bytes(r.tobytes(), "little") for r in packed]
        return out


def _greedy(masks: list[int], starts: int = 8) -> int:
    """Size of a clique found by taking vertices in order of degree, from several starts."""
    by_degree = sorted(range(len(masks)), key=lambda i: (-masks[i].bit_count(), i))
    most = 0
    for first in by_degree[:starts]:
        cand, size = masks[first], 1
        for v in by_degree:
            if cand >> v & 1:
                cand &= masks[v]
                size += 1
                if size + cand.bit_count() <= most:
                    break
        most = max(most, size)
    return most


def _colours(cand: int, masks: list[int], enough: int) -> int:
    """Colours that a greedy colouring of ``cand`` takes; stops once there are ``enough``."""
    colours = 0
    while cand and colours < enough:
        colours += 1
        free = cand
        while free:
            low = free & -free
            cand ^= low
            free = (free ^ low) & ~masks[low.bit_length() - 1]
    return colours


def _first_largest(masks: list[int], at_least: int) -> int:
    """Largest clique of at least ``at_least`` vertices as bits (0 if none); of equal ones the smallest.

    Vertices are tried in order, so the first clique of a size is the smallest one.  Vertices
    next to all other candidates belong to every largest clique and are taken at once, which
    leaves little to search in a graph that is nearly a clique.
    """
    best, need = 0, max(at_least, 1)
    stack = [(0, (1 << len(masks)) - 1)]
    while stack:
        chosen, cand = stack.pop()
        size = chosen.bit_count()
        if size + cand.bit_count() < need:
            continue
        least, busy = need - size - 1, True
        while busy:  # candidates with too few neighbours among the candidates go
            busy = False
            for v in _bits(cand):
                near = (masks[v] & cand).bit_count()
                if near < least:
                    cand ^= 1 << v
                    busy = True
                elif near + 1 == cand.bit_count() and not busy:
                    chosen |= 1 << v
                    cand ^= 1 << v
                    size, least = size + 1, least - 1
        if not cand:
            if size >= need:
                best, need = chosen, size + 1
            continue
        if size + cand.bit_count() < need or size + _colours(cand, masks, need - size) < need:
            continue
        low = cand & -cand
        stack.append((chosen, cand ^ low))
        stack.append((chosen | low, cand & masks[low.bit_length() - 1]))
    return best


def largest_clique(u: np.ndarray, v: np.ndarray, at_least: int) -> list[int] | None:
    """Largest clique of the graph with edges ``u - v`` if it has ``at_least`` vertices; of equal ones the smallest ids."""
    g = _Graph(u, v, at_least)
    if not g.ids:
        return None
    if len(g.ids) <= 4 * SEED_WIDTH:
        masks = g.masks()
        found = _first_largest(masks, max(at_least, _greedy(masks)))
        return [g.ids[i] for i in _bits(found)] or None
    # many vertices, so few neighbours each: one search per vertex among those after it in order of degree
    best: list[int] | None = None
    rank = np.lexsort((np.arange(len(g.ids)), g.degree)).argsort()
    lo = np.where(rank[g.ends[0]] < rank[g.ends[1]], *g.ends)
    hi = np.where(rank[g.ends[0]] < rank[g.ends[1]], g.ends[1], g.ends[0])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    edge = np.searchsorted(lo, np.arange(len(g.ids) + 1))
    part = _Graph.__new__(_Graph)
    for a in range(len(g.ids)):
        later = np.sort(hi[edge[a] : edge[a + 1]])
        if len(later) + 1 < at_least:
            continue
        spans = [hi[edge[b] : edge[b + 1]] for b in later]
        part.ids = [g.ids[b] for b in later]
        part.ends = np.repeat(later, [len(x) for x in spans]), np.concatenate(spans)
        inside = np.isin(part.ends[1], later)
        part.ends = tuple(np.searchsorted(later, e[inside]) for e in part.ends)
        masks = part.masks()
        found = _first_largest(masks, max(at_least - 1, 1))
        if found:
            clique = sorted([g.ids[a], *(part.ids[i] for i in _bits(found))])
            if best is None or (-len(clique), clique) < (-len(best), best):
                best, at_least = clique, len(clique)
    return best


def _members(keys: list[str], schema: pa.Schema, cliques: list[list[int]], head: pa.Table) -> pa.Table:
    """The key values of a group, once per clique."""
    columns = [pa.array([head.column(k)[0].as_py()] * len(cliques), schema.field(k).type) for k in keys]
    return pa.Table.from_arrays([*columns, pa.array(cliques, pa.list_(pa.int64()))], [*keys, "members"])


def _solve(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        prefix = table.column("s")[0].as_py()
        bound = table.column("bound")[0].as_py() or 1
        found = largest_clique(table.column("u").to_numpy(), table.column("v").to_numpy(), max(bound - len(prefix), 2))
        cliques = [] if found is None else [sorted([*prefix, *found])]
        return _members(keys, table.schema, cliques, table)

    return run


def _count(e: DataFrame, by: list[str]) -> DataFrame:
    return cut_lineage(e.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))


def _peeled(e: DataFrame, keys: list[str]) -> DataFrame:
    """Drop edges of vertices that have too few neighbours for a clique of ``bound`` with the prefix."""
    by = [*keys, "s"]
    while True:
        weak = degrees(e, by).join(e.select(*by, "bound").distinct(), by).filter(F.col("degree") < F.col("bound") - F.size("s") - 1).select(*by, "id")
        weak = cut_lineage(weak)
        if weak.isEmpty():
            return e
        for end in "uv":
            e = e.join(weak.withColumnRenamed("id", end), [*by, end], "left_anti")
        e = cut_lineage(e)


def _without_universal(e: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Move vertices next to all others of their piece to its prefix; also the clique they make with one more."""
    by = [*keys, "s"]
    deg = cut_lineage(degrees(e, by))
    size = deg.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    all_near = F.col("degree") == F.col("_all") - 1
    kinds = deg.join(size, by).groupBy(*by).agg(F.collect_list(F.when(all_near, F.col("id"))).alias("_uni"), F.min(F.when(~all_near, F.col("id"))).alias("_one"))
    kinds = kinds.join(e.groupBy(*by).agg(F.max("bound").alias("bound")), by)
    kinds = cut_lineage(kinds.withColumn("_s", F.concat("s", "_uni")))
    one = F.when(F.col("_one").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_one"))
    clique = kinds.select(*keys, F.array_sort(F.concat("_s", one)).alias("members"), "bound").filter(F.size("members") >= F.col("bound")).drop("bound")
    uni = kinds.select(*by, F.explode("_uni").alias("id"))
    for end in "uv":
        e = e.join(uni.withColumnRenamed("id", end), [*by, end], "left_anti")
    moved = e.join(kinds.select(*by, "_s"), by).drop("s").withColumnRenamed("_s", "s")
    return cut_lineage(moved), clique


def _seed_bound(e: DataFrame, keys: list[str]) -> DataFrame:
    """A clique size of every group: greedy search among the best connected neighbours of its best connected vertices."""
    deg = cut_lineage(degrees(e, keys))
    seeds = deg.groupBy(*keys).agg(F.max(F.struct("degree", "id")).alias("_s")).select(*keys, F.col("_s.id").alias("seed"))
    both = e.select(*keys, "u", "v").union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(seeds, keys).filter(F.col("u") == F.col("seed")).select(*keys, F.col("v").alias("id")).join(deg, [*keys, "id"])
    near = top_k(near, keys, SEED_WIDTH, [F.desc("degree"), "id"]).select(*keys, "id")
    inside = e.join(near.withColumnRenamed("id", "u"), [*keys, "u"], "left_semi").join(near.withColumnRenamed("id", "v"), [*keys, "v"], "left_semi")

    def run(table: pa.Table) -> pa.Table:
        size = _greedy(_Graph(table.column("u").to_numpy(), table.column("v").to_numpy(), 2).masks()) + 1
        columns = [pa.array([table.column(k)[0].as_py()], table.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*columns, pa.array([size], pa.int64())], [*keys, "bound"])

    return inside.groupBy(*keys).applyInArrow(run, _schema(e, keys, "bound long"))


def max_clique(edges: DataFrame, keys: list[str], above: DataFrame | None = None) -> DataFrame:
    """Exact maximum clique per group: ``size`` and sorted ``members``.

    Of equal cliques the lexicographically smallest is returned.  With ``above`` (keys, bound)
    only cliques of more than ``bound`` vertices are looked for, and groups without one are
    left out.  See the head of the module for the pieces.
    """
    by = [*keys, "s"]
    e = edges.select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e = e.withColumn("s", F.array().cast("array<bigint>"))
    floor = F.lit(2).cast("long")
    if above is not None:
        e = e.join(above.select(*keys, (F.col("bound") + 1).cast("long").alias("_floor")), keys, "left")
        floor = F.greatest(floor, F.coalesce("_floor", floor))
    e = e.withColumn("bound", floor).drop("_floor")
    schema, done = _schema(e, keys, "members array<long>"), []
    sizes = _count(e, by)
    most = sizes.agg(F.max("_n")).first()[0] or 0
    first = True
    while most > PIECE:
        e = cut_lineage(e.join(sizes, by))
        done.append(e.filter(F.col("_n") <= PIECE).drop("_n").groupBy(*by).applyInArrow(_solve(keys), schema))
        e = e.filter(F.col("_n") > PIECE).drop("_n")
        if first:
            e = cut_lineage(e.join(_seed_bound(e, keys).withColumnRenamed("bound", "_g"), keys, "left"))
            e = e.withColumn("bound", F.greatest("bound", F.coalesce("_g", "bound"))).drop("_g")
            first = False
        e, whole = _without_universal(_peeled(e, keys), keys)
        done.append(whole)
        e = cut_lineage(e.join(_count(e, by), by))
        done.append(e.filter(F.col("_n") <= PIECE).drop("_n").groupBy(*by).applyInArrow(_solve(keys), schema))
        e = e.filter(F.col("_n") > PIECE).drop("_n")
        # a clique of the prefix and one edge has no triangle to be found by: the smallest one stands here
        edge = e.groupBy(*by, "bound").agg(F.min(F.struct("u", "v")).alias("_e")).filter(F.size("s") + 2 >= F.col("bound"))
        done.append(edge.select(*keys, F.array_sort(F.concat("s", F.array("_e.u", "_e.v"))).alias("members")))
        bounds = cut_lineage(e.select(*by, "bound").distinct())
        opened = triangles(e.select(*by, "u", "v"), by).join(bounds, by)
        ends = F.least("b", "c").alias("u"), F.greatest("b", "c").alias("v")
        e = cut_lineage(opened.select(*keys, *ends, F.concat("s", F.array("a")).alias("s"), "bound"))
        sizes = _count(e, by)
        most = sizes.agg(F.max("_n")).first()[0] or 0
    found = e.groupBy(*by).applyInArrow(_solve(keys), schema)
    for part in done:
        found = found.unionByName(part)
    best = found.groupBy(*keys).agg(F.min(F.struct((-F.size("members")).alias("neg"), "members")).alias("_b"))
    return best.select(*keys, (-F.col("_b.neg")).alias("size"), F.col("_b.members").alias("members"))


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _solve_levels(keys: list[str], levels: int):
    def run(table: pa.Table) -> pa.Table:
        u, v, low = (table.column(c).to_numpy() for c in ("u", "v", "min_level"))
        sizes, members, numbers = [], [], []
        best: list[int] = []
        for level in range(int(low.min()), levels):
            now = low <= level
            if not numbers or (low == level).any():
                best = largest_clique(u[now], v[now], max(len(best) + 1, 2)) or best
            numbers.append(level)
            sizes.append(len(best))
            members.append(best)
        columns = [pa.array([table.column(k)[0].as_py()] * len(sizes), table.schema.field(k).type) for k in keys]
        columns += [pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(members, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, [*keys, "level", "size", "members"])

    return run


def max_clique_levels(edges: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Maximum clique of every pyramid level.

    ``edges`` carry the first level they belong to (``min_level``), so levels are nested, and
    the size at one level is the bound at the next: only larger cliques are looked for, and a
    level without one keeps the earlier members.  Groups that fit one piece run through their
    levels in one task; the others level by level in pieces.
    """
    e = edges.select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "min_level")
    sizes = _count(e, keys)
    schema = _schema(e, keys, "level int, size int, members array<long>")
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= PIECE:
        return e.groupBy(*keys).applyInArrow(_solve_levels(keys, levels), schema)
    e = cut_lineage(e.join(sizes, keys))
    out = e.filter(F.col("_n") <= PIECE).drop("_n").groupBy(*keys).applyInArrow(_solve_levels(keys, levels), schema)
    large, known = e.filter(F.col("_n") > PIECE).drop("_n"), None
    for level in range(levels):
        found = max_clique(large.filter(F.col("min_level") <= level), keys, None if known is None else known.select(*keys, F.col("size").alias("bound")))
        if known is not None:
            found = known.select(*keys, "size", "members").unionByName(found).groupBy(*keys).agg(F.max_by("members", "size").alias("members"))
            found = found.select(*keys, F.size("members").alias("size"), "members")
        known = cut_lineage(found)
        out = out.unionByName(known.select(*keys, F.lit(level).alias("level"), F.col("size").cast("int").alias("size"), "members"))
    return out


def _search_maximal(minimum: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            keys = [c for c in pdf.columns if c not in ("apex", "later", "links", "outer")]
            for row in pdf.itertuples(index=False):
                ids, masks = _adjacency(row.later, row.links)
                at = {v: k for k, v in enumerate(ids)}
                outside: dict[int, int] = {}
                for link in row.outer if row.outer is not None else ():
                    outside[link["p"]] = outside.get(link["p"], 0) | 1 << at[link["q"]]
                base = tuple(getattr(row, k) for k in keys)
                for clique in _maximal(masks, list(outside.values())):
                    members = sorted([int(row.apex), *(ids[i] for i in _bits(clique))])
                    if len(members) >= minimum:
                        rows.append((*base, members))
            yield pd.DataFrame(rows, columns=[*keys, "members"])

    return run


def _maximal(masks: list[int], outside: list[int]) -> Iterator[int]:
    """Maximal cliques inside the neighbourhood that no earlier vertex extends."""
    stack = [(0, (1 << len(masks)) - 1, 0)]
    while stack:
        chosen, cand, done = stack.pop()
        if not cand and not done:
            if chosen and not any(chosen & ~m == 0 for m in outside):
                yield chosen
            continue
        both = cand | done
        pivot = max(_bits(both), key=lambda i: bin(masks[i] & cand).count("1")) if both else None
        rest = cand if pivot is None else cand & ~masks[pivot]
        for v in _bits(rest):
            bit = 1 << v
            stack.append((chosen | bit, cand & masks[v], done & masks[v]))
            cand &= ~bit
            done |= bit


def _solve_maximal(keys: list[str], minimum: int):
    def run(table: pa.Table) -> pa.Table:
        g = _Graph(table.column("u").to_numpy(), table.column("v").to_numpy(), minimum)
        n = len(g.ids)
        first, second = np.concatenate(g.ends), np.concatenate(g.ends[::-1])
        order = np.lexsort((second, first))
        second = second[order]
        edge = np.searchsorted(first[order], np.arange(n + 1))
        near = [second[edge[i] : edge[i + 1]] for i in range(n)]
        rank = np.lexsort((np.arange(n), g.degree)).argsort()
        cliques = []
        for a in range(n):
            later, before = near[a][rank[near[a]] > rank[a]], near[a][rank[near[a]] < rank[a]]
            if len(later) + 1 < minimum:
                continue

            def bits(x: int, among=later) -> int:
                inside = np.isin(among, near[x], assume_unique=True)
                return int.from_bytes(np.packbits(inside, bitorder="little").tobytes(), "little")

            outside = {m for m in map(bits, before) if m}
            for found in _maximal([bits(b) for b in later], list(outside)):
                if found.bit_count() + 1 >= minimum:
                    cliques.append(sorted([g.ids[a], *(g.ids[later[i]] for i in _bits(found))]))
        return _members(keys, table.schema, cliques, table)

    return run


def maximal_cliques(edges: DataFrame, keys: list[str], minimum: int = 3) -> DataFrame:
    """All maximal cliques of at least ``minimum`` vertices, each once.

    A group whose edges fit one piece is searched in one task, vertex by vertex among the
    neighbours after it in order of degree; the vertices of a larger group are dealt to tasks
    with their neighbourhoods.
    """
    if minimum < 3:
        raise ValueError("cliques below three vertices carry no pose")
    e = edges.select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    sizes = _count(e, keys)
    schema = _schema(e, keys, "members array<long>")
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= PIECE:
        return e.groupBy(*keys).applyInArrow(_solve_maximal(keys, minimum), schema)
    e = cut_lineage(e.join(sizes, keys))
    small = e.filter(F.col("_n") <= PIECE).drop("_n").groupBy(*keys).applyInArrow(_solve_maximal(keys, minimum), schema)
    hoods = neighbourhoods(e.filter(F.col("_n") > PIECE).drop("_n"), keys, earlier=True)
    return small.unionByName(hoods.mapInPandas(_search_maximal(minimum), schema))


def best_cliques_per_node(cliques: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keep every clique that is the heaviest one of some member.

    A clique's weight is the sum of its edge weights; ties go to the smaller members.
    """
    pairs = F.expr(
        "flatten(transform(members, (p, i) -> transform(slice(members, i + 2, size(members)),"
        " q -> named_struct('u', p, 'v', q))))"
    )
    weight = (
        cliques.select(*keys, "members", F.explode(pairs).alias("_e")).select(*keys, "members", "_e.*")
        .join(edges.select(*keys, "u", "v", "w"), [*keys, "u", "v"])
        .groupBy(*keys, "members").agg(F.sum("w").alias("weight"))
    )
    per = weight.select(*keys, F.explode("members").alias("corr_id"), "members", "weight")
    best = per.groupBy(*keys, "corr_id").agg(F.min(F.struct((-F.round("weight", 9)).alias("neg"), "members")).alias("_b"))
    return best.select(*keys, F.col("_b.members").alias("members"), (-F.col("_b.neg")).alias("weight")).distinct()
