"""Connected components and core pruning as repeated joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


#: Edges contracted at once inside one task.
CHUNK_EDGES = 1 << 16


def _leaves(column: pa.Array) -> list[np.ndarray]:
    """Plain columns in the order in which a column of any orderable type compares, nulls first."""
    valid = np.asarray(column.is_valid())
    mask = [] if valid.all() else [valid]
    if pa.types.is_struct(column.type):
        return mask + [leaf for field in column.flatten() for leaf in _leaves(field)]
    kept = column.drop_null().to_numpy(zero_copy_only=False)
    ranks = np.zeros(len(column), dtype=np.int64)
    ranks[valid] = np.unique(kept, return_inverse=True)[1]
    return [*mask, ranks]


def _contracted(table: pa.Table) -> pa.Table:
    """Smallest node ``v`` that the edges of the table connect with each other node ``u``."""
    names = [c for c in table.column_names if c not in ("u", "v", "_open", "_chunk")]
    both = pa.concat_tables([table.select([*names, end]).rename_columns([*names, "id"]) for end in "uv"]).combine_chunks()
    nodes = np.zeros(both.num_rows, dtype=np.int64)
    for name in both.column_names:
        for leaf in _leaves(both[name].chunk(0)):
            nodes = np.unique(nodes * (int(leaf.max()) + 1) + leaf, return_inverse=True)[1]
    first = np.unique(nodes, return_index=True)[1]
    root = np.arange(len(first))
    u, v = nodes[: table.num_rows], nodes[table.num_rows :]
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    low = np.flatnonzero(root != np.arange(len(root)))
    own, other = both.take(first[low]), both["id"].take(first[root[low]])
    rest = {n: table[n].take(np.zeros(len(low), dtype=np.int64)) for n in ("_open", "_chunk")}
    return pa.table({**{n: own[n] for n in names}, "u": own["id"], "v": other, **rest})


def _contract(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stars that connect the same nodes as ``edges``: those of finished groups, and all others.

    Groups that fit a chunk share chunks and are finished in one; the edges of a larger
    group are dealt over several, and its stars are still to be joined with each other.
    """
    count = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = count.agg(F.sum("_n"), F.max("_n")).first()
    chunks = F.lit(-(-(total or 0) // CHUNK_EDGES) or 1).cast("long")
    spot = F.pmod(F.xxhash64(*keys), chunks) if keys else F.lit(0).cast("long")
    if (most or 0) <= CHUNK_EDGES:
        dealt = edges.withColumns({"_open": F.lit(False), "_chunk": spot})
    else:
        dealt = edges.join(count, keys) if keys else edges.withColumn("_n", F.lit(total))
        large = F.col("_n") > CHUNK_EDGES
        part = F.pmod(F.xxhash64("u", "v", *keys), F.ceil(F.col("_n") / CHUNK_EDGES))
        dealt = dealt.withColumns({"_open": large, "_chunk": F.when(large, F.pmod(part + spot, chunks)).otherwise(spot)}).drop("_n")
    stars = cut_lineage(dealt.groupBy("_open", "_chunk").applyInArrow(_contracted, dealt.schema))
    return (stars.filter(c).select(*keys, "u", "v") for c in ("not _open", "_open"))


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50, keys: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """Smallest member of each node's component.

    ``nodes`` has ``id``, ``edges`` has ``u`` and ``v`` (any orderable type), both have
    ``keys``: no edge leaves a group.  A node may have several rows; each keeps its columns ``carry``.  Bounded chunks of edges are contracted to stars
    first, which finishes all groups that fit a chunk.  What is left takes rounds that
    alternate a large and a small star contraction, which needs about log(n) rounds and
    never builds a node's neighbour list: both steps are a ``min`` and a join.
    """
    keys = list(keys)
    ends = F.array("u", "v")  # gives both one type
    found, e = _contract(cut_lineage(edges.filter(F.col("u") != F.col("v")).select(*keys, ends[0].alias("u"), ends[1].alias("v"))), keys)
    e = cut_lineage(e.distinct())
    before = _signature(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.select(*keys, "u", "v").union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = down.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = down.join(root, [*keys, "u"]).filter(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(root.select(*keys, "u", F.col("m").alias("v"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle; raise max_rounds")
    found = found.union(e).groupBy(*keys, F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select(*keys, "id", *carry).join(found, [*keys, "id"], "left").select(*keys, "id", *carry, F.coalesce("component", "id").alias("component"))


def k_core(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Drop vertices with fewer than ``k`` neighbours until none is left."""
    e = cut_lineage(edges)
    count = e.count()
    while True:  # every round but the last drops an edge
        ends = e.select(*keys, F.explode(F.array("u", "v")).alias("id"))
        keep = ends.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= k)
        e2 = e.join(keep.select(*keys, F.col("id").alias("u")), [*keys, "u"], "left_semi")
        e2 = e2.join(keep.select(*keys, F.col("id").alias("v")), [*keys, "v"], "left_semi")
        e = cut_lineage(e2)
        left = e.count()
        if left == count:
            return e
        count = left


def sized(labels: DataFrame, keys: list[str], minimum: int, maximum: int | None = None) -> DataFrame:
    """Clusters with a size inside the given bounds."""
    size = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    ok = F.col("size") >= minimum
    return size.filter(ok if maximum is None else ok & (F.col("size") <= maximum))
