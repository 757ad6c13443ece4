"""N-gram Jaccard self-join of documents by T-occurrence search.

Two documents link when their sets of word shingles reach a Jaccard similarity.  A pair that
links shares at least ``T = ceil(threshold * n)`` shingles, ``n`` being either set's size, so
a document whose shingles mostly occur nowhere else can be put aside at once:

1. *Copies.*  Documents with equal sets (128-bit sums of the hashes) form one class, and
   only its smallest id goes on.
2. *Repeats.*  Tasks pack their shingles by hash range; each range counts which of them come
   from two documents or more.  A document with fewer than T such shingles has no partner.
3. *Blocks.*  Over the rest, inverted lists get exact lengths.  Of a document's lists, the
   T - 1 longest are its long lists; any partner is on one of the remaining short lists.
   Documents that share a short list are candidates, and connected candidates form a block.
4. *DivideSkip.*  Within a block every query merges its short lists, keeps documents that
   occur often enough there, and probes the long lists by binary search.  Large blocks are cut
   into tiles; pairs that are already connected are not searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._shared import as_text, by_size, mixed, own_columns, runs_of, shingle_sets, small_batches, stored

_NONE = np.uint32(0xFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    """Shingle sets of a column of text lists: the union of a list's sets."""
    lists = column.to_pylist()
    flat = [as_text(t) for texts in lists for t in texts]
    sets = shingle_sets(flat, k)
    if len(flat) == len(lists):
        return sets
    out, at = [], 0
    for texts in lists:
        own = sets[at : at + len(texts)]
        out.append(np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64))
        at += len(texts)
    return out


def _blocks(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    texts = batch.column("texts")
    sizes = [sum(len(t or "") for t in x.as_py()) for x in texts]
    for i, j in runs_of([range(s) for s in sizes], most_bytes):
        yield batch.slice(i, j - i)


def _set_keys(k: int):
    def run(batches):
        for whole in batches:
            for batch in _blocks(whole):
                sets = _sets_of(batch.column("texts"), k)
                with np.errstate(over="ignore"):
                    a = [int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                    b = [int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    ["id", "n", "f1", "f2"],
                )

    return run


_PACKED = "range int, pack bigint, ids binary, idx binary, toks binary"
_COUNTED = "pack bigint, ids binary, counts binary"


def _pack(k: int, ranges: int):
    """Shingles of many documents by hash range: 32 bits of the hash and a local document number.

    A shingle of two documents of the same pack is known to repeat; it is counted here and
    sent once without a document, so a shingle that very many documents share adds one entry
    per pack.  Rows with an empty ``toks`` carry these counts.
    """

    def run(batches):
        for whole in batches:
            for batch in _blocks(whole):
                sets = _sets_of(batch.column("texts"), k)
                ids = np.array(batch.column("id").to_pylist(), np.int64)
                toks = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                if not len(toks):
                    continue
                idx = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                order = np.argsort(toks, kind="stable")
                toks, idx = toks[order], idx[order]
                first = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]])
                times = np.diff(np.r_[first, len(toks)])
                local = np.bincount(idx, np.repeat(times > 1, times), len(sets)).astype(np.int64)
                toks, idx = toks[first], np.where(times > 1, _NONE, idx[first])
                where = ((toks >> _HALF) * np.uint64(ranges)) >> _HALF
                cut = np.searchsorted(where, np.arange(ranges + 1, dtype=np.uint64))
                pack = int(ids[0])  # where counts meet again
                out = [(pack % ranges, pack, ids.tobytes(), local.tobytes(), b"")]
                for r in np.flatnonzero(np.diff(cut)):
                    t, d = toks[cut[r] : cut[r + 1]], idx[cut[r] : cut[r + 1]]
                    own, at = np.unique(d[d != _NONE], return_inverse=True)
                    place = np.full(len(d), 0xFFFF, np.uint16)  # packs stay below 60,000 documents
                    place[d != _NONE] = at
                    out.append((int(r), pack, ids[own].tobytes(), place.tobytes(), (t & _LOW).astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    ["range", "pack", "ids", "idx", "toks"],
                )

    return run


def _count_repeats(batches):
    """Per pack its documents' shingles that this hash range has from other documents too."""
    got: dict[int, list] = {}
    for batch in batches:
        through = []
        for r, pack, ids, idx, toks in zip(*[c.to_pylist() for c in batch.columns]):
            if toks:
                got.setdefault(r, []).append((pack, ids, np.frombuffer(idx, np.uint16), np.frombuffer(toks, np.uint32)))
            else:
                through.append((pack, ids, idx))
        if through:
            yield _counted(through)
    while got:
        parts = got.popitem()[1]
        toks = np.concatenate([p[3] for p in parts])
        start = np.cumsum([0, *[len(p[1]) // 8 for p in parts]])
        place = np.concatenate([np.where(p[2] == 0xFFFF, -1, p[2].astype(np.int64) + s) for p, s in zip(parts, start)])
        order = np.argsort(toks, kind="stable")
        toks, place = toks[order], place[order]
        same = toks[1:] == toks[:-1]
        hit = place[(np.r_[same, False] | np.r_[False, same]) & (place >= 0)]
        counts = np.bincount(hit, minlength=start[-1]).astype(np.int64)
        yield _counted([(p[0], p[1], counts[i:j].tobytes()) for p, i, j in zip(parts, start[:-1], start[1:])])


def _counted(rows) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["pack", "ids", "counts"])


def _sum_counts(batches):
    """(id, r) over the hash ranges of the packs in this partition."""
    ids, counts = [], []

    def summed():
        own, at = np.unique(np.concatenate(ids), return_inverse=True)
        return own, np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)

    for batch in batches:
        ids += [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
        counts += [np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist()]
        if sum(map(len, ids)) > 1 << 21:
            own, n = summed()
            ids, counts = [own], [n]
    if ids:
        own, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["id", "r"])


def _explode_sets(k: int):
    def run(batches):
        for whole in batches:
            for batch in _blocks(whole):
                sets = _sets_of(batch.column("texts"), k)
                ids = np.array(batch.column("id").to_pylist(), np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, sizes)),
                        pa.array(np.repeat(sizes, sizes)),
                        pa.array(np.concatenate(sets).astype(np.int64) if sets else np.empty(0, np.int64)),
                    ],
                    ["id", "n", "tok"],
                )

    return run


def needed(n, percent: int):
    """T: shared shingles without which no set of any size reaches the threshold."""
    return (n * percent + 99) // 100


class Lists:
    """Inverted lists over the sets of one tile, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        toks = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        docs = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(toks, kind="stable")  # stable: every list is in document order
        self.docs = docs[order]
        toks = toks[order]
        first = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]]) if len(toks) else np.empty(0, np.int64)
        self.keys, self.start = toks[first], np.r_[first, len(toks)].astype(np.int64)

    def search(self, query: np.ndarray, open_docs: np.ndarray) -> np.ndarray:
        """Documents among ``open_docs`` (a mask) that link with ``query``, exactly."""
        n = len(query)
        t = needed(n, self.percent)
        at = np.searchsorted(self.keys, query)
        at = at[(at < len(self.keys))]
        at = at[np.isin(self.keys[at], query, assume_unique=True)]
        if len(at) < t or not t:
            return np.empty(0, np.int64)
        length = self.start[at + 1] - self.start[at]
        by_length = np.argsort(length, kind="stable")
        # long lists are set aside while the merge of the others still has to find some hits
        n_long = min(t - 1, int(t / (1 + 0.1 * np.log2(1 + length.max()))))
        short, long = at[by_length[: len(at) - n_long]], at[by_length[len(at) - n_long :]]
        merged = np.sort(np.concatenate([self.docs[self.start[i] : self.start[i + 1]] for i in short]), kind="stable")
        first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        docs, count = merged[first], np.diff(np.r_[first, len(merged)])
        size = self.sizes[docs]
        fits = (count >= t - n_long) & open_docs[docs] & (100 * np.minimum(size, n) >= self.percent * np.maximum(size, n))
        docs, count = docs[fits], count[fits]
        for done, i in enumerate(long):
            if not len(docs):
                break
            one = self.docs[self.start[i] : self.start[i + 1]]
            spot = np.minimum(np.searchsorted(one, docs), len(one) - 1)
            count = count + (one[spot] == docs)
            alive = count + (n_long - done - 1) >= t
            docs, count = docs[alive], count[alive]
        return docs[100 * count >= self.percent * (n + self.sizes[docs] - count)]


def tile_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what belongs together; links inside a known component are left out.

    A document is searched once, with all open documents.  The search ends when all documents
    not yet searched are in one component: no link between two components is then unseen.
    """
    lists = Lists(sets, percent)
    label = np.arange(len(sets))
    waiting = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    while waiting.any():
        left = np.flatnonzero(waiting)
        comps, counts = np.unique(label[left], return_counts=True)
        if len(comps) == 1 and out:
            break
        outside = left[label[left] != comps[counts.argmax()]] if len(comps) > 1 else left
        stop = len(outside)
        for x in outside[:stop].tolist():
            waiting[x] = False
            hits = lists.search(sets[x], label != label[x])
            for c in np.unique(label[hits]).tolist():
                if c != label[x]:
                    out.append((x, int(hits[label[hits] == c][0])))
                    label[label == c] = label[x]
            if len(hits):
                break  # labels have changed: choose anew what still has to be searched
        else:
            if len(comps) == 1:
                break
    return out


def _search_tiles(k: int, percent: int):
    """For each (block) inside a bin: edges (u, v) that connect its documents."""

    def run(key, table):
        ids = np.array(table.column("id").to_pylist(), np.int64)
        blocks = np.array(table.column("block").to_pylist(), np.int64)
        sets = _sets_of(table.column("texts").combine_chunks(), k)
        order = np.lexsort((ids, blocks))
        cut = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0, True])
        u, v = [], []
        for i, j in zip(cut[:-1], cut[1:]):
            own = order[i:j]
            for a, b in tile_links([sets[x] for x in own], percent):
                u.append(ids[own[a]])
                v.append(ids[own[b]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _search_across(k: int, percent: int):
    """Queries of one chunk against one tile: an edge to each component that a query links with."""

    def run(key, table):
        ids = np.array(table.column("id").to_pylist(), np.int64)
        label = np.array(table.column("label").to_pylist(), np.int64)
        asks = np.array(table.column("asks").to_pylist(), bool)
        sets = _sets_of(table.column("texts").combine_chunks(), k)
        inside = np.flatnonzero(~asks)
        lists = Lists([sets[i] for i in inside], percent)
        u, v = [], []
        for x in np.flatnonzero(asks).tolist():
            hits = lists.search(sets[x], label[inside] != label[x])
            for c in np.unique(label[inside][hits]).tolist():
                u.append(ids[x])
                v.append(ids[inside][hits[label[inside][hits] == c][0]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _grouped(df: DataFrame, keys: list[str], fn) -> DataFrame:
    return df.groupBy(*keys).applyInArrow(fn, "u bigint, v bigint")


def _candidate_blocks(tokens: DataFrame, percent: int) -> DataFrame:
    """(id, block) of documents that share one of their short lists, directly or over others."""
    length = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = tokens.join(length, "tok").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("l"))
    n_short = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    short = lists.withColumn("s", (n_short - (F.col("n") - F.size("l"))).cast("int")).filter("s > 0")
    entries = stored(short.select("id", F.explode(F.slice("l", 1, F.col("s"))).alias("e")).select("id", "e.tok"), "short-lists")
    lead = entries.groupBy("tok").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("df")).filter("df > 1")
    edges = entries.join(lead, "tok").filter(F.col("id") != F.col("lead")).select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    edges = stored(edges, "candidates")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return connected_components(nodes, edges).select("id", F.col("component").alias("block"))


def ngram_jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, tile: int = 1500
) -> DataFrame:
    """Add ``n_shingles`` and ``component_id``: the smallest id reachable over links.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a set has the
    distinct runs of ``k`` words, or the whole sequence for a text with fewer.  Two documents
    link when ``100 * |intersection| >= percent * |union|``.

    Null, empty and blank texts have an empty set and link with nothing.  Rows with a null id
    keep their count and get a null component.  Rows that share an id are one document, whose
    set is the union of theirs.  ``doc_id`` must hold integers.  Columns of ``docs`` named like
    the two new ones are replaced; an empty table gives an empty table.  Links are decided
    with 64-bit hashes of shingles and equal sets with 128-bit sums.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_shingles", "component_id")])
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    base = own.filter("id is not null")
    counts = base.agg(F.count(F.lit(1)).alias("a"), F.countDistinct("id").alias("c")).first()
    if counts["a"] == counts["c"]:
        base = base.select("id", F.array("t").alias("texts"))
    else:
        base = base.groupBy("id").agg(F.collect_set(F.coalesce("t", F.lit(""))).alias("texts"))

    sets = stored(base.mapInArrow(_set_keys(k), "id bigint, n bigint, f1 bigint, f2 bigint"), "sets")
    heads = sets.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    copies = sets.join(heads.filter("copies > 1"), ["n", "f1", "f2"]).filter("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))

    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 4_000_000), 1)
    packs = base.mapInArrow(_pack(k, parts), _PACKED).repartitionById(parts, F.col("range"))
    counted = packs.mapInArrow(_count_repeats, _COUNTED).repartition(parts, "pack")
    repeats = counted.mapInArrow(_sum_counts, "id bigint, r bigint").groupBy("id").agg(F.sum("r").alias("r"))
    alive = sets.join(repeats, "id").filter(100 * F.col("r") >= percent * F.col("n"))
    alive = stored(alive.join(heads.select(F.col("head").alias("id"), "n", "f1", "f2"), ["id", "n", "f1", "f2"], "left_semi").select("id"), "alive")

    def texts_of(ids: DataFrame, rows: int) -> DataFrame:
        return base.join(by_size(ids, rows), "id")

    tokens = stored(texts_of(alive, alive.count()).mapInArrow(_explode_sets(k), "id bigint, n bigint, tok bigint"), "tokens")
    blocks = stored(_candidate_blocks(tokens, percent), "blocks")
    size = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    n_blocked = blocks.count()
    bins = max(1, n_blocked // 500)
    tiles = F.ceil(F.col("size") / tile).cast("long")
    placed = blocks.join(size, "block").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    placed = stored(placed, "placed")
    full = texts_of(placed, n_blocked)
    small_bin = F.when(F.col("size") <= tile // 2, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.lit(-1))
    by_bin = full.withColumn("bin", small_bin).withColumn("own", F.when(F.col("bin") < 0, F.col("block")).otherwise(-1))
    links = stored(_grouped(by_bin.select("id", "block", "texts", "bin", "own", "tile"), ["bin", "own", "tile"], _search_tiles(k, percent)), "links")

    wide = placed.filter("tiles > 1")
    if not wide.isEmpty():
        links = links.unionByName(_across_tiles(wide, full.filter("tiles > 1"), links, tile, k, percent))

    edges = copies.unionByName(links)
    found = connected_components(sets.select("id"), edges) if not edges.isEmpty() else sets.select("id", F.col("id").alias("component"))
    p = own_columns(docs, "n_shingles", "component_id")
    info = sets.select("id", F.col("n").alias("n_shingles")).join(found, "id")
    info = info.select(F.col("id").alias(f"{p}id"), "n_shingles", F.col("component").alias("component_id"))
    with_id = docs.filter(F.col(doc_id).isNotNull())
    out = with_id.join(info, F.col(doc_id).cast("long") == F.col(f"{p}id")).drop(f"{p}id")
    bare = docs.filter(F.col(doc_id).isNull())
    if counts["a"] == docs.count():
        return out
    sized = bare.withColumn(f"{p}n", F.array(F.col(text))).withColumn("n_shingles", _size_of(k)(F.col(f"{p}n"))).drop(f"{p}n")
    return out.unionByName(sized.withColumn("component_id", F.lit(None).cast("long")))


def _size_of(k: int):
    @F.arrow_udf("bigint")
    def n_shingles(texts: pa.Array) -> pa.Array:
        return pa.array([len(s) for s in _sets_of(texts, k)], pa.int64())

    return n_shingles


def _across_tiles(wide: DataFrame, full: DataFrame, links: DataFrame, tile: int, k: int, percent: int) -> DataFrame:
    """Links between the tiles of large blocks.

    Components inside tiles first meet through their heads, which joins nearly all of them.
    What then lies outside a block's largest component is searched against every tile, so each
    pair of documents in different components is compared, in tasks of bounded size.
    """
    comp = connected_components(wide.select("id"), links.join(wide.select(F.col("id").alias("u")), "u", "left_semi"))
    heads = wide.join(comp, "id").filter("id = component").select("id")
    meet = full.join(heads, "id", "left_semi")
    n = F.ceil(F.count(F.lit(1)) / tile).cast("long")
    split = heads.join(wide.select("id", "block"), "id").groupBy("block").agg(n.alias("parts"))
    meet = meet.join(split, "block").withColumn("tile", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
    met = stored(_grouped(meet.select("id", "block", "texts", "tile"), ["block", "tile"], _search_tiles(k, percent)), "links")
    both = links.unionByName(met)
    label = connected_components(wide.select("id"), both.join(wide.select(F.col("id").alias("u")), "u", "left_semi"))
    label = stored(wide.join(label.select("id", F.col("component").alias("label")), "id"), "labels")
    sizes = label.groupBy("block", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("block").agg(F.max(F.struct("k", "label"))["label"].alias("main"))
    outside = label.join(main, "block").filter("label <> main")
    chunks = outside.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("chunks"))
    texts = full.select("id", "texts")
    # every tile takes part once per chunk of queries of its block, every query once per tile
    held = label.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    asked = outside.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cols = ["id", "block", "label", "tile", "chunk"]
    rows = held.select(*cols, F.lit(False).alias("asks")).unionByName(asked.select(*cols, F.lit(True).alias("asks"))).join(texts, "id")
    return met.unionByName(stored(_grouped(rows, ["block", "tile", "chunk"], _search_across(k, percent)), "links"))
