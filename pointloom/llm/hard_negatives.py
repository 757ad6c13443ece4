"""Hard negatives of anchor vectors: exact integer scores by Strassen's recursion over tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import by_size, stored

#: Below this inner or outer size a product is computed directly.
_LEAF = 16
_LONG = np.iinfo(np.int64)


def _padded(m: np.ndarray, rows: int, cols: int) -> np.ndarray:
    if m.shape == (rows, cols):
        return m
    out = np.zeros((rows, cols), m.dtype)
    out[: m.shape[0], : m.shape[1]] = m
    return out


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    i, j, k = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = _strassen(a11 + a22, b11 + b22, levels - 1)
    p2 = _strassen(a21 + a22, b11, levels - 1)
    p3 = _strassen(a11, b12 - b22, levels - 1)
    p4 = _strassen(a22, b21 - b11, levels - 1)
    p5 = _strassen(a11 + a12, b22, levels - 1)
    p6 = _strassen(a21 - a11, b11 + b12, levels - 1)
    p7 = _strassen(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * i, 2 * j), a.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = _LEAF) -> np.ndarray:
    """``a @ b`` of integer matrices: halves in all three sizes, seven products instead of eight.

    Sizes are padded with zeros to a multiple of the number of halves.  Sums wrap modulo 2**64
    like the products, so the result is exact whenever the true entries fit a long; matrices
    of Python integers (object type) have no bound.
    """
    (m, k), n = a.shape, b.shape[1]
    levels, small = 0, min(m, k, n)
    while small > leaf:
        small, levels = -(-small // 2), levels + 1
    step = 1 << levels
    up = lambda x: -(-x // step) * step
    with np.errstate(over="ignore"):
        return _strassen(_padded(a, up(m), up(k)), _padded(b, up(k), up(n)), levels)[:m, :n]


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), x as double; shorter vectors end in zeros.

    Type int64 if every score of such rows surely fits a long, else object (Python integers).
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(np.clip(scale * flat, -1e300, 1e300))
    if np.abs(out).max(initial=0) ** 2 * max(out.shape[1], 1) < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object).reshape(out.shape)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All scores of rows of ``a`` with rows of ``b``, held to the range of a long."""
    k = max(a.shape[1], b.shape[1])
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    s = strassen(_padded(a, len(a), k), _padded(b, len(b), k).T)
    return s if s.dtype == np.int64 else np.clip(s, _LONG.min, _LONG.max).astype(np.int64)


class Heaps:
    """The best ``k`` of each row: higher score, then smaller id.  Two of them merge into one."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), _LONG.min)
        self.at = np.full((rows, k), -1)

    def add(self, score: np.ndarray, usable: np.ndarray, at: np.ndarray, order: np.ndarray) -> None:
        """Merge the usable ones of a block; ``at`` are its columns' numbers, ``order[at]`` their place by id."""
        low = self.score.min(axis=1)  # a full heap takes nothing below its least
        for r in np.flatnonzero((usable & (score >= low[:, None])).any(axis=1)):
            hit = np.flatnonzero(usable[r] & (score[r] >= low[r]))
            if len(hit) > 4 * self.k:  # only the k-th best score and what is equal or above
                cut = np.partition(score[r, hit], len(hit) - self.k)[len(hit) - self.k]
                hit = hit[score[r, hit] >= cut]
            old = self.at[r] >= 0
            s = np.concatenate([self.score[r, old], score[r, hit]])
            a = np.concatenate([self.at[r, old], at[hit]])
            best = np.lexsort((order[a], -s.astype(object) if (s == _LONG.min).any() else -s))[: self.k]
            self.score[r, : len(best)], self.at[r, : len(best)] = s[best], a[best]


def _blocks(n: int, size: int):
    for i in range(0, n, size):
        yield i, min(n, i + size)


def _by_id(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((rows, ids))] = np.arange(len(ids))
    return order


def _search(scale: int, positives: int, negatives: int, low: int, high: int, windows: bool):
    """The best rows for the anchors of one group: positives, or negatives inside the windows of the positives."""

    def run(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role"))
        a, b = (table.filter(pa.array(role == x)) for x in (0, 1))
        out: list[list] = [[] for _ in range(6)]
        if len(a) and len(b):
            va, vb = whole_numbers(a.column("vector"), scale), whole_numbers(b.column("vector"), scale)
            rows_a, rows_b = np.asarray(a.column("row")), np.asarray(b.column("row"))
            ids_a, ids_b = np.asarray(a.column("id")), np.asarray(b.column("id"))
            label_a, label_b = np.asarray(a.column("label")), np.asarray(b.column("label"))
            order = _by_id(ids_b, rows_b)
            for i, j in _blocks(len(a), 256):
                if windows:
                    found = a.column("found").slice(i, j - i).to_pylist()
                    most = max(len(f) for f in found)
                    # whole-number ends of low * positive <= 100 * negative <= high * positive
                    ends = [[(-(-low * f[k]["score"] // 100), high * f[k]["score"] // 100) if k < len(f) else (1, 0) for f in found] for k in range(most)]
                    ends = [np.clip(np.array(e, object), _LONG.min, _LONG.max).astype(np.int64) for e in ends]
                    heaps = [Heaps(j - i, negatives) for _ in range(most)]
                else:
                    heaps = [Heaps(j - i, positives)]
                for c, d in _blocks(len(b), 4096):
                    s = scores_of(va[i:j], vb[c:d])
                    same = label_a[i:j, None] == label_b[None, c:d]
                    at = np.arange(c, d)
                    if windows:
                        for e, heap in zip(ends, heaps):
                            heap.add(s, ~same & (s >= e[:, :1]) & (s <= e[:, 1:]), at, order)
                    else:
                        heaps[0].add(s, same & (rows_a[i:j, None] != rows_b[None, c:d]), at, order)
                for k, heap in enumerate(heaps):
                    r, place = np.nonzero(heap.at >= 0)
                    at = heap.at[r, place]
                    for column, values in zip(out, (rows_a[i:j][r], ids_a[i:j][r], np.full(len(r), k), rows_b[at], ids_b[at], heap.score[r, place])):
                        column.append(values)
        names = ("anchor_row", "anchor_id", "k", "row", "id", "score")
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for n, c in zip(names, out)})

    return run


_FOUND = "anchor_row bigint, anchor_id bigint, k bigint, row bigint, id bigint, score bigint"


def _tiled(anchors: DataFrame, rows: DataFrame, on: Column, anchor_rows: int, tile_rows: int) -> DataFrame:
    """Anchors and rows, dealt so that each anchor meets each row of its ``on`` in one group of bounded size."""
    a, b = anchors.withColumn("on", on), rows.withColumn("on", on)
    na = a.groupBy("on").agg(F.ceil(F.count(F.lit(1)) / anchor_rows).cast("int").alias("na"))
    nb = b.groupBy("on").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("nb"))
    sizes = stored(na.join(nb, "on"), "tiles")
    sizes = by_size(sizes, sizes.count())
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    a = a.join(sizes, "on").withColumns({"role": F.lit(0), "ta": deal("na"), "tb": spread("nb")})
    b = b.join(sizes, "on").withColumns({"role": F.lit(1), "tb": deal("nb"), "ta": spread("na")})
    return a.drop("na", "nb").unionByName(b.drop("na", "nb"), allowMissingColumns=True)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_rows: int = 8192, tile_rows: int = 4096,
) -> DataFrame:
    """Hard negatives for every anchor and each of its positives.

    Scores are inner products of floor(``scale`` * component).  Positives of an anchor are the
    first ``positives`` other rows of its label, its negatives for a positive the first
    ``negatives`` rows of other labels with low% <= negative / positive score <= high%; first
    means higher score, then smaller id.  Every anchor meets every row, tile by tile: groups of at most about
    ``anchor_rows`` anchors and ``tile_rows`` rows, once within labels for the positives, once
    over all rows for the negatives.  Each group multiplies its tiles and keeps a few per
    anchor, and those merge; a hot label is only more tiles.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows without id, label or vector, or with a null or non-finite component, take no part.
    Vectors of different length count as ended with zeros.  Scores beyond the range of a long
    are held to its ends.  Rows that share an id are rows of their own (of two equal ones
    either may be the one returned).  An anchor without positives, or a positive without
    negatives, has no rows; an empty table gives an empty table.
    """
    x = F.col(vector)
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    used = rows.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False))).filter(F.col(row_id).isNotNull() & F.col(label).isNotNull() & fine)
    used = used.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vector"), "_anchor")
    used = stored(used.withColumn("row", F.monotonically_increasing_id()), "vectors")  # stored: row numbers must not change
    anchors, used = used.filter("_anchor").drop("_anchor"), used.drop("_anchor")

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        """Merge the heaps of all groups: at most ``k`` rows per key and group come in."""
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    given = (scale, positives, negatives, low, high)
    groups = _tiled(anchors, used, F.col("label"), anchor_rows, tile_rows).groupBy("on", "ta", "tb")
    near = best(groups.applyInArrow(_search(*given, windows=False), _FOUND), ["anchor_row"], positives)
    place = F.sort_array(F.collect_list(F.struct("rank", "row", "id", "score"))).alias("found")  # at most ``positives``
    near = stored(near.groupBy(F.col("anchor_row").alias("row")).agg(place), "positives")
    ready = stored(anchors.join(near, "row"), "anchors")
    groups = _tiled(ready, used, F.lit(0), anchor_rows, tile_rows).groupBy("on", "ta", "tb")
    hard = best(groups.applyInArrow(_search(*given, windows=True), _FOUND), ["anchor_row", "k"], negatives)
    out = hard.join(near.select(F.col("row").alias("anchor_row"), "found"), "anchor_row")
    p = F.get("found", F.col("k").cast("int"))
    return out.select(
        "anchor_id", p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        p["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
