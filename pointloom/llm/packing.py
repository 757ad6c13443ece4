"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import chain
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored
from .tokens import encoder

#: Pieces per shard; a shard is packed by one task.
SHARD = 4000
_PIECES = "rid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, packed in zip(ids, chain.from_iterable(encode.slices(texts))):
                packed += end
                for piece, start in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[start : start + 4 * capacity]
                    out.append((rid, doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    rid += 1
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


class Packing:
    """Bins of items: one individual of the population."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []

    def fill(self, b: list[int]) -> int:
        return sum(self.sizes[i] for i in b)

    def best_fit(self, items: list[int]) -> Packing:
        """Place ``items`` in turn, each where the least room is left over."""
        room = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(self.bins))
        for i in items:
            s = self.sizes[i]
            at = bisect_left(room, (s, -1))
            if at < len(room):
                r, k = room.pop(at)
                self.bins[k].append(i)
                insort(room, (r - s, k))
            else:
                self.bins.append([i])
                insort(room, (self.capacity - s, len(self.bins) - 1))
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones: free room in one place can be used."""
        return -len(self.bins), sum((self.fill(b) / self.capacity) ** 2 for b in self.bins)

    def crossed(self, other: Packing, rnd: Random) -> Packing:
        """Inject well-filled bins of ``other``, drop bins with duplicates, place what they held anew."""
        good = sorted(other.bins, key=self.fill, reverse=True)[: max(1, len(other.bins) // 2)]
        taken = [b for b in good if rnd.random() < 0.5] or good[:1]
        inside = {i for b in taken for i in b}
        stay = [b for b in self.bins if inside.isdisjoint(b)]
        homeless = [i for b in self.bins if not inside.isdisjoint(b) for i in b if i not in inside]
        homeless.sort(key=self.sizes.__getitem__, reverse=True)
        return Packing(self.sizes, self.capacity, [list(b) for b in stay + taken]).best_fit(homeless)

    def mutated(self, rnd: Random) -> Packing:
        """Empty the worst bins and a few others, and place their items by best fit."""
        order = sorted(range(len(self.bins)), key=lambda k: self.fill(self.bins[k]))
        out = set(order[:3]) | {rnd.randrange(len(self.bins)) for _ in range(3)}
        homeless = [i for k in out for i in self.bins[k]]
        homeless.sort(key=lambda i: self.sizes[i] * rnd.uniform(0.7, 1.3), reverse=True)
        return Packing(self.sizes, self.capacity, [list(b) for k, b in enumerate(self.bins) if k not in out]).best_fit(homeless)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], population: int = 6, generations: int = 15) -> Packing:
    """The best packing found; stops early at the lower bound, which is optimal."""
    rnd, bound = Random(seed), -(-sum(sizes) // capacity)
    people = [Packing(sizes, capacity, [list(b) for b in e]) for e in elites]
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    noise = 0.0 if seed % 8 == 0 else 0.1
    while len(people) < population:
        people.append(Packing(sizes, capacity).best_fit(sorted(order, key=lambda i: -sizes[i] * rnd.uniform(1 - noise, 1 + noise))))
        if len(people[-1].bins) <= bound:
            return people[-1]
        noise += 0.1
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= bound:
            break
        a, b = rnd.sample(people[: max(2, population // 2)], 2)
        people[-1] = a.crossed(b, rnd).mutated(rnd)
        people.sort(key=Packing.fitness, reverse=True)
    return people[0]


_SOLUTION = "shard bigint, island int, rid bigint, length bigint, bin int, n_bins int, bound int, score double"


def _island(capacity: int, epoch: int):
    """One island of one shard: evolve from its own elite and the neighbour's, if there are any."""

    def run(key, table):
        shard, island = key[0].as_py(), key[1].as_py()
        cols = {c: table.column(c).to_pylist() for c in ("rid", "length", "bin", "origin")}
        order = sorted(range(len(cols["rid"])), key=lambda k: (cols["origin"][k], cols["rid"][k]))
        rids = [cols["rid"][k] for k in order if cols["origin"][k] == cols["origin"][order[0]]]
        sizes = [cols["length"][k] for k in order[: len(rids)]]
        elites = []
        if epoch:
            for at in range(0, len(order), len(rids)):
                bins: dict[int, list[int]] = {}
                for i, k in enumerate(order[at : at + len(rids)]):
                    bins.setdefault(cols["bin"][k], []).append(i)
                elites.append(list(bins.values()))
        best = evolve(sizes, capacity, (shard * 31 + epoch) * 8 + island, elites)
        where = {i: b for b, items in enumerate(best.bins) for i in items}
        n, score = len(rids), best.fitness()[1]
        return pa.table(
            {
                "shard": pa.array([shard] * n, pa.int64()),
                "island": pa.array([island] * n, pa.int32()),
                "rid": pa.array(rids, pa.int64()),
                "length": pa.array(sizes, pa.int64()),
                "bin": pa.array([where[i] for i in range(n)], pa.int32()),
                "n_bins": pa.array([len(best.bins)] * n, pa.int32()),
                "bound": pa.array([-(-sum(sizes) // capacity)] * n, pa.int32()),
                "score": pa.array([score] * n, pa.float64()),
            }
        )

    return run


def _pack_level(items: DataFrame, shards: int, capacity: int, islands: int) -> DataFrame:
    """(shard, rid, length, bin) of the best packing of each shard of ``items`` (rid, length)."""
    placed = items.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    every = placed.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    every = every.select("shard", "island", "rid", "length", F.lit(None).cast("int").alias("bin"), F.lit(0).alias("origin"))
    first = stored(every.groupBy("shard", "island").applyInArrow(_island(capacity, 0), _SOLUTION), "islands")
    best = first.groupBy("shard").agg(F.min("n_bins").alias("least"))
    todo = first.join(best, "shard").filter("least > bound")
    own = todo.withColumn("origin", F.col("island"))
    guests = own.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))  # elites move on along the ring
    columns = ["shard", "island", "rid", "length", "bin", "origin"]
    second = own.select(*columns).unionByName(guests.select(*columns)).groupBy("shard", "island").applyInArrow(_island(capacity, 1), _SOLUTION)
    both = stored(first.withColumn("epoch", F.lit(0)).unionByName(second.withColumn("epoch", F.lit(1))), "islands")
    rank = F.struct(-F.col("n_bins"), "score", "epoch", "island")
    win = both.groupBy("shard").agg(F.max(rank).alias("win")).select("shard", F.col("win.epoch").alias("epoch"), F.col("win.island").alias("island"))
    return both.join(win, ["shard", "epoch", "island"]).select("shard", "rid", "length", "bin")


def best_fit_packing(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    islands: int = 3,
    open_below: float = 0.97,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    A document is its ids by the given tokenizer file and then ``end_id``; longer ones are cut
    into pieces of ``capacity`` tokens.  Returns per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    Pieces are dealt by hash into shards of about 4000.  On each shard some islands evolve a
    population of packings: a crossover injects whole well-filled bins, removes bins that hold
    duplicates and best-fits the displaced pieces; the elite of each island then moves to the
    next one for a second epoch, unless the shard has already reached its lower bound.  Bins
    filled below ``open_below`` are packed again together with those of other shards, level by
    level, until the rest is a single shard.

    Null text is the empty document (its end id alone).  Null and repeated ids and repeated
    rows are packed row by row.  Other columns are left out; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(rows.mapInArrow(_cut(tokenizer, end_id, capacity), _PIECES), "pieces")
    rest = pieces.filter(F.col("length") < capacity).select("rid", "length")
    done = []
    count, level = rest.count(), 0
    while count:
        shards = -(-count // SHARD)
        bins = _pack_level(rest, shards, capacity, islands)
        fills = bins.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        bins = stored(bins.join(fills, ["shard", "bin"]).withColumn("level", F.lit(level)), "bins")
        if shards == 1:
            done.append(bins)
            break
        done.append(bins.filter(F.col("fill") >= open_below * capacity))
        rest = bins.filter(F.col("fill") < open_below * capacity).select("rid", "length")
        left = rest.count()
        if 2 * left > count:  # nothing to gain from other shards: keep what is there
            done[-1] = bins
            break
        count, level = left, level + 1
    placed = None
    for one in done:
        one = one.select("rid", "level", "shard", "bin", "length")
        placed = one if placed is None else placed.unionByName(one)
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long"))
    if placed is None:
        return full.drop("rid")
    number = F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft(F.col("shard"), 16) + F.col("bin")  # a shard has fewer than 2 ** 16 bins
    placed = placed.withColumn("sequence_id", number)
    order = Window.partitionBy("sequence_id").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    return pieces.join(placed.select("rid", "sequence_id", "offset"), "rid").unionByName(full).drop("rid")
