"""Removal of repeated byte strings, found by column-wise construction of suffix orders.

A 100-byte window goes when the same bytes start earlier, in a smaller document or further
left in the same one.  Sorting all suffixes of a corpus at once would move every byte a
hundred times, so windows are first dealt by content:

1. *Copies.*  Of documents with equal text all but the first are repeats as a whole.
2. *Anchors.*  Each window has one anchor: the 32-byte gram with the smallest hash among its
   69 grams, the leftmost of equals.  Equal windows have equal anchors at equal offsets.
   Anchors are packed by hash range and counted; a window whose anchor occurs once is unique.
3. *Columns.*  Around each repeated anchor stands a context of at most 168 bytes.  The
   contexts of one hash range form a collection of short documents, aligned at the anchor.  Its
   suffix order is built column by column from the right: every round inserts one symbol per
   document, by a stable sort of the Burrows-Wheeler column, and updates the common prefixes of
   neighbours.  Columns lie in a sequential temporary file.  Once a round has reached the
   anchor, neighbours with 100 common bytes are equal windows, and all but the first go.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import with_row_number
from ._shared import _power_table, as_text, by_size, digest, mixed, own_columns, plain_text, runs_of, small_batches, stored

GRAM = 32
_BITS = 24
_MASK = np.uint64((1 << _BITS) - 1)
_PIECE = 1 << 20
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def _anchors(texts: list[bytes], width: int) -> dict[str, np.ndarray]:
    """Anchor runs of the windows of some texts, and windows that repeat at a short period.

    A run is a stretch of windows with one anchor: document ``doc``, anchor ``pos``, window
    starts ``lo`` to ``hi`` (all offsets inside the document), hash ``h``.  Periodic text has
    an anchor per period with equal grams; windows equal to the one a period before are
    returned as ``rdoc``, ``rstart`` and only what is left of their run goes on.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    off = np.cumsum(sizes) - sizes
    none = {k: np.empty(0, np.int64) for k in ("doc", "pos", "lo", "hi", "rdoc", "rstart")} | {"h": np.empty(0, np.uint64)}
    big = np.flatnonzero(sizes >= width)
    if not len(big):
        return none
    with np.errstate(over="ignore"):
        power, inverse = _power_table(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        n = len(raw) - GRAM + 1
        grams = mixed((sums[GRAM:] - sums[:n]) * inverse[:n])
    low = (grams & ~_MASK) | np.arange(n, dtype=np.uint64)
    span, reach = 1, width - GRAM + 1
    while 2 * span <= reach:  # smallest key of ever longer stretches of grams
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    step = np.zeros(len(raw) + 1, np.int32)
    step[off[big]] += 1
    step[off[big] + sizes[big] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(step)[: len(low)])  # starts of windows inside one document
    anchor = (low[at] & _MASK).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(at) != 1)])
    last = np.r_[first[1:], len(at)] - 1
    pos, lo, hi = anchor[first], at[first], at[last]
    doc = np.searchsorted(off, lo, "right") - 1
    while len(big) != len(sizes) and (sizes[doc] == 0).any():  # empty texts share an offset with the next one
        doc = np.where(sizes[doc] == 0, doc - 1, doc)
    h = grams[pos]
    near = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) + 1
    rdoc = rstart = np.empty(0, np.int64)
    keep = np.ones(len(pos), bool)
    if len(near):
        count = hi[near] - lo[near] + 1
        run = np.repeat(near, count)
        s = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + lo[run]
        p = pos[run] - pos[run - 1]
        ok = s - p >= off[doc[run]]
        with np.errstate(over="ignore"):
            code = lambda i: (sums[i + width] - sums[i]) * inverse[i]
            ok[ok] = code(s[ok]) == code((s - p)[ok])
        rdoc, rstart = doc[run[ok]], s[ok] - off[doc[run[ok]]]
        rest = ~ok
        new_lo, new_hi = np.full(len(pos), np.iinfo(np.int64).max), np.full(len(pos), -1)
        np.minimum.at(new_lo, run[rest], s[rest])
        np.maximum.at(new_hi, run[rest], s[rest])
        lo[near], hi[near] = new_lo[near], new_hi[near]
        keep[near] = hi[near] >= 0
    # anchors have small hashes by choice: mixed again, so that they spread over the hash ranges
    pos, lo, hi, doc, h = pos[keep], lo[keep], hi[keep], doc[keep], mixed(h[keep] ^ np.uint64(0x5851F42D4C957F2D))
    return {"doc": doc, "pos": pos - off[doc], "lo": lo - off[doc], "hi": hi - off[doc], "h": h, "rdoc": rdoc, "rstart": rstart}


def _pieces(uids: list[int], texts: list[bytes], width: int):
    """(document numbers, offsets, texts) of bounded size; a long text comes in overlapping pieces."""
    for i, j in runs_of(texts, _PIECE, 50_000):
        if j - i > 1 or len(texts[i]) <= 2 * _PIECE:
            yield uids[i:j], [0] * (j - i), texts[i:j]
            continue
        for at in range(0, max(1, len(texts[i]) - width + 1), _PIECE):
            yield [uids[i]], [at], [texts[i][at : at + _PIECE + width - 1]]


def _intervals(doc: np.ndarray, start: np.ndarray):
    """Per document the stretches of consecutive starts: (document, packed int64 pairs)."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(start) > 1)])
    pairs = np.stack([start[head], start[np.r_[head[1:], len(doc)] - 1]], 1).astype(np.int64)
    owner = doc[head]
    cut = np.flatnonzero(np.r_[True, np.diff(owner) != 0, True])
    for i, j in zip(cut[:-1], cut[1:]):
        yield int(owner[i]), pairs[i:j].tobytes()


def _positions(doc: np.ndarray, pos: np.ndarray):
    """Per document its positions, packed as 32-bit integers (a row holds less than 4 GB)."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order].astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, np.diff(doc) != 0, True])
    for i, j in zip(cut[:-1], cut[1:]):
        yield int(doc[i]), pos[i:j].tobytes()


#: Packs on their way to a hash range, and what passes through: 1 candidates, 2 repeats.
_PACK = "range int, what int, ids binary, idx binary, pos binary, toks binary"
_FOUND = "what int, uid bigint, data binary"


def _rows(rows, names, types) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _pack_batch(rows) -> pa.RecordBatch:
    return _rows(rows, ["range", "what", "ids", "idx", "pos", "toks"], (pa.int32(), pa.int32(), *[pa.binary()] * 4))


def _found_batch(rows) -> pa.RecordBatch:
    return _rows(rows, ["what", "uid", "data"], (pa.int32(), pa.int64(), pa.binary()))


def _pack_anchors(width: int, ranges: int):
    def run(batches):
        for batch in batches:
            uids, texts = batch.column("uid").to_pylist(), [as_text(t) for t in batch.column("text").to_pylist()]
            for ids, offs, part in _pieces(uids, texts, width):
                a = _anchors(part, width)
                ids, offs = np.array(ids, np.int64), np.array(offs, np.int64)
                out = [(int(u % ranges), 2, np.int64(u).tobytes(), b"", d, b"") for u, d in _intervals(ids[a["rdoc"]], a["rstart"] + offs[a["rdoc"]])]
                pos = a["pos"] + offs[a["doc"]]
                order = np.argsort(a["h"], kind="stable")
                h, doc, pos = a["h"][order], a["doc"][order], pos[order]
                if len(h):
                    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                    times = np.diff(np.r_[first, len(h)])
                    many = np.repeat(times > 1, times)  # known to repeat: candidates at once, and one entry for the others
                    out += [(int(u % ranges), 1, np.int64(u).tobytes(), b"", d, b"") for u, d in _positions(ids[doc[many]], pos[many])]
                    where = ((h[first] >> _HALF) * np.uint64(ranges)) >> _HALF
                    cut = np.searchsorted(where, np.arange(ranges + 1, dtype=np.uint64))
                    for r in np.flatnonzero(np.diff(cut)):
                        one = first[cut[r] : cut[r + 1]]
                        alone = times[cut[r] : cut[r + 1]] == 1
                        own, at = np.unique(doc[one[alone]], return_inverse=True)
                        place = np.full(len(one), 0xFFFF, np.uint16)
                        place[alone] = at
                        toks = (h[one] & _LOW).astype(np.uint32)
                        out.append((int(r), 0, ids[own].tobytes(), place.tobytes(), pos[one].astype(np.int64).tobytes(), toks.tobytes()))
                if out:
                    yield _pack_batch(out)

    return run


def _repeated_anchors(batches):
    got: dict[int, list] = {}
    for batch in batches:
        through = []
        for r, what, ids, idx, pos, toks in zip(*[c.to_pylist() for c in batch.columns]):
            if what:
                through.append((what, int(np.frombuffer(ids, np.int64)[0]), pos))
            else:
                got.setdefault(r, []).append((ids, idx, pos, toks))
        if through:
            yield _found_batch(through)
    while got:
        parts = got.popitem()[1]
        toks = np.concatenate([np.frombuffer(p[3], np.uint32) for p in parts])
        pos = np.concatenate([np.frombuffer(p[2], np.int64) for p in parts])
        uid = []
        for ids, idx, _, _ in parts:
            place = np.frombuffer(idx, np.uint16)
            uid.append(np.append(np.frombuffer(ids, np.int64), -1)[np.where(place == 0xFFFF, len(ids) // 8, place)])
        known = np.concatenate([np.frombuffer(p[1], np.uint16) == 0xFFFF for p in parts])
        uid = np.concatenate(uid)
        order = np.argsort(toks, kind="stable")
        same = toks[order][1:] == toks[order][:-1]
        again = order[np.r_[same, False] | np.r_[False, same]]
        again = again[~known[again]]
        rows = [(1, u, d) for u, d in _positions(uid[again], pos[again])]
        if rows:
            yield _found_batch(rows)


_CONTEXT = "range int, what int, ids binary, pos binary, lo binary, hi binary, data binary"


def _pack_contexts(width: int, ranges: int):
    """Contexts of the candidate anchors, packed by hash range.

    Contexts that are equal as a whole leave only their first occurrence; the windows of the
    others are repeats.  So a passage that very many documents share costs one row per pack.
    """

    def run(batches):
        for batch in batches:
            order = np.argsort(np.array(batch.column("uid").to_pylist(), np.int64), kind="stable")
            batch = batch.take(pa.array(order))
            uids, texts = batch.column("uid").to_pylist(), [as_text(t) for t in batch.column("text").to_pylist()]
            wanted = {u: np.unique(np.frombuffer(b"".join(d), np.uint32).astype(np.int64)) for u, d in zip(uids, batch.column("data").to_pylist())}
            for ids, offs, part in _pieces(uids, texts, width):
                a = _anchors(part, width)
                lists = [wanted[u] - o for u, o in zip(ids, offs)]
                code = lambda d, p: (d.astype(np.int64) << 40) + p
                want = np.concatenate([code(np.full(len(x), i), x) for i, x in enumerate(lists)]) if lists else np.empty(0, np.int64)
                hit = np.flatnonzero(np.isin(code(a["doc"], a["pos"]), want))
                seen: set = set()
                groups: dict[int, list] = {}
                rdoc, rlo, rhi = [], [], []
                where = ((a["h"][hit] >> _HALF) * np.uint64(ranges)) >> _HALF
                for r, d, p, lo, hi in zip(*[x.tolist() for x in (where, a["doc"][hit], a["pos"][hit], a["lo"][hit], a["hi"][hit])]):
                    text = part[d][lo : hi + width]
                    key = (p - lo, text)
                    if key in seen:
                        rdoc.append(d)
                        rlo.append(lo)
                        rhi.append(hi)
                    else:
                        seen.add(key)
                        groups.setdefault(r, []).append((ids[d], p + offs[d], p - hi, p - lo, text))
                out = []
                for r, rows in groups.items():
                    u, p, lo, hi, data = zip(*rows)
                    out.append((r, 0, np.array(u, np.int64).tobytes(), np.array(p, np.int64).tobytes(), np.array(lo, np.uint8).tobytes(), np.array(hi, np.uint8).tobytes(), b"".join(data)))
                if rdoc:
                    count = np.array(rhi) - np.array(rlo) + 1
                    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(rlo, count)
                    owner = np.repeat(np.array(rdoc), count)
                    for u, d in _intervals(np.array(ids, np.int64)[owner], start + np.array(offs, np.int64)[owner]):
                        out.append((u % ranges, 2, np.int64(u).tobytes(), b"", b"", b"", d))
                if out:
                    yield _rows(out, ["range", "what", "ids", "pos", "lo", "hi", "data"], (pa.int32(), pa.int32(), *[pa.binary()] * 5))

    return run


class _RangeMin:
    """Smallest of a stretch of small numbers, by doubling."""

    def __init__(self, values: np.ndarray, longest: int):
        self.table = [values]
        while 2 ** len(self.table) <= longest:
            last, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last, np.append(last[half:], np.zeros(min(half, len(last)), last.dtype))))
        self.flat = np.concatenate(self.table)
        self.n = len(values)

    def __call__(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        level = np.frexp(length.astype(np.float64))[1] - 1
        base = level.astype(np.int64) * self.n
        return np.minimum(self.flat[base + first], self.flat[base + first + length - (1 << level.astype(np.int64))])


def repeated_windows(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each window that an earlier row has at the same offset.

    Row i holds the bytes from ``hi[i]`` before its anchor to ``width - lo[i]`` after it, and
    owns the windows that start ``lo[i]`` to ``hi[i]`` bytes before the anchor; rows come in
    order.  Columns go to a temporary file and are read back one per round.
    """
    m, left = len(contexts), width - GRAM
    cols = left + width
    found_row, found_off = [], []
    with tempfile.TemporaryFile() as columns:
        for at in range(0, m, 1 << 16):  # transposed block by block
            block = np.zeros((min(1 << 16, m - at), cols), np.uint16)
            for i in range(len(block)):
                c = np.frombuffer(contexts[at + i], np.uint8)
                s = left - int(hi[at + i])
                block[i, s : s + len(c)] = c
                block[i, s : s + len(c)] += 1  # 0 is the end mark
            for c in range(cols):
                columns.seek(2 * (c * m + at))
                columns.write(np.ascontiguousarray(block[:, c]).tobytes())
        order, lcp, position = np.arange(m), np.zeros(m, np.uint8), np.arange(m)
        for c in range(cols - 1, -1, -1):
            columns.seek(2 * c * m)
            bwt = np.frombuffer(columns.read(2 * m), np.uint16)[order]
            perm = np.argsort(bwt, kind="stable")
            symbol = bwt[perm]
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
            new = np.zeros(m, np.uint8)
            if len(same):
                before, length = perm[same], perm[same + 1] - perm[same]
                new[same + 1] = 1 + _RangeMin(lcp, int(length.max()))(before + 1, length)
            order, lcp = order[perm], new
            if c > left:
                continue
            offset = left - c
            mine = (lo[order] <= offset) & (offset <= hi[order])
            head = np.flatnonzero(lcp < width)
            first = np.minimum.reduceat(np.where(mine, position[order], m), head)
            group = np.cumsum(lcp < width) - 1
            late = order[mine & (order != first[group])]
            found_row.append(late)
            found_off.append(np.full(len(late), offset))
    return np.concatenate(found_row), np.concatenate(found_off)


def _search_columns(width: int):
    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            through = []
            for r, what, ids, pos, lo, hi, data in zip(*[c.to_pylist() for c in batch.columns]):
                if what:
                    through.append((2, int(np.frombuffer(ids, np.int64)[0]), data))
                else:
                    got.setdefault(r, []).append((ids, pos, lo, hi, data))
            if through:
                yield _found_batch(through)
        while got:
            parts = got.popitem()[1]
            uid, pos = (np.concatenate([np.frombuffer(p[i], np.int64) for p in parts]) for i in (0, 1))
            lo, hi = (np.concatenate([np.frombuffer(p[i], np.uint8) for p in parts]).astype(np.int64) for i in (2, 3))
            size = hi - lo + width
            data = b"".join(p[4] for p in parts)
            start = np.cumsum(size) - size
            order = np.lexsort((pos, uid))
            texts = [data[s : s + n] for s, n in zip(start[order].tolist(), size[order].tolist())]
            row, offset = repeated_windows(texts, lo[order], hi[order], width)
            row = order[row]
            rows = [(2, u, d) for u, d in _intervals(uid[row], pos[row] - offset)]
            if rows:
                yield _found_batch(rows)

    return run


def _remove(width: int, columns: list[str], text: str, copy: str, data: str, with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for body, whole, packed in zip(*[batch.column(c).to_pylist() for c in (text, copy, data)]):
                body = as_text(body)
                pairs = np.frombuffer(b"".join(packed or ()), np.int64).reshape(-1, 2)
                if whole and len(body) >= width:
                    pairs = np.array([[0, len(body) - width]])
                kept, spans, end = [], 0, 0
                for a, b in sorted(map(tuple, pairs.tolist())):
                    if a > end or not spans:
                        kept.append(body[end:a])
                        spans += 1
                    end = max(end, b + width)
                kept.append(body[end:])
                left = b"".join(kept)
                clean = left.decode("utf-8", "ignore") if with_text else None
                out.append((len(body), len(body) - len(left), spans, hashlib.sha256(left).hexdigest(), clean))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            new = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], [*columns, *_NEW])

    return run


_NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "clean_text")


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 100, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts earlier.

    Earlier: in a document with a smaller id, or further left in the same one.  Strings are
    judged on the input.  Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` (of the remaining bytes) and ``clean_text`` (only filled for ``with_text``: the
    remaining bytes without parts of characters).  Columns of ``docs`` with these names are replaced.

    Null text is empty.  Null ids come after all others.  Rows with equal id and text are one
    document; rows with equal id and other text are ordered by the text's hash.  Texts shorter
    than ``width`` stay.  An empty table gives an empty table.
    """
    if not GRAM < width <= 128:
        raise ValueError(f"width must be {GRAM + 1} to 128")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in _NEW])
    p = own_columns(docs, *_NEW)
    ids = docs.agg(F.count(F.lit(1)).alias("a"), F.countDistinct(doc_id).alias("b")).first()
    if ids["a"] == ids["b"]:
        keyed = docs.withColumn(f"{p}u", F.col(doc_id).cast("long"))
    else:
        named = docs.withColumn(f"{p}i", F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))).withColumn(f"{p}d", F.hex(digest(plain_text(text))))
        order = named.select(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), f"{p}i", f"{p}d").distinct()
        order = with_row_number(order.withColumn("all", F.lit(0)), ["all"], ["none", "id", f"{p}d"], f"{p}u").select(f"{p}i", f"{p}d", f"{p}u")
        keyed = named.join(stored(order, "numbers"), [f"{p}i", f"{p}d"]).drop(f"{p}i", f"{p}d")
    base = keyed.select(F.col(f"{p}u").alias("uid"), plain_text(text).alias("text"))

    hashed = base.select("uid", digest(F.col("text")).alias("d"))
    heads = hashed.groupBy("d").agg(F.min("uid").alias("head"), F.max("uid").alias("last")).filter("head < last")
    copies = stored(hashed.join(heads, "d").filter("uid <> head").select("uid").distinct(), "copies")
    n_copies = copies.count()
    firsts = base.join(by_size(copies, n_copies), "uid", "left_anti")
    if ids["a"] != ids["b"]:
        firsts = firsts.distinct()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about 30 bytes of text per anchor, 32 bytes per anchor on its way
    ranges = max(parts, n_bytes // (64 << 20), 1)
    packs = firsts.mapInArrow(_pack_anchors(width, ranges), _PACK).repartitionById(ranges, F.col("range"))
    anchors = stored(packs.mapInArrow(_repeated_anchors, _FOUND), "anchors")
    wanted = anchors.filter("what = 1").groupBy("uid").agg(F.collect_list("data").alias("data"))
    n_wanted = anchors.filter("what = 1").agg(F.sum(F.octet_length("data") + 32)).first()[0] or 0
    bins = max(parts, n_wanted // (4 * 100_000), 1)
    contexts = firsts.join(by_size(wanted, n_wanted, 1), "uid").mapInArrow(_pack_contexts(width, bins), _CONTEXT)
    found = contexts.repartitionById(bins, F.col("range")).mapInArrow(_search_columns(width), _FOUND)
    flags = stored(anchors.filter("what = 2").unionByName(found), "repeats").groupBy("uid").agg(F.collect_list("data").alias("data"))
    flags = flags.join(copies.withColumn("copy", F.lit(True)), "uid", "full")
    flags = stored(flags.select("uid", F.coalesce("copy", F.lit(False)).alias("copy"), "data"), "flags")
    size = flags.agg(F.sum(48 + F.coalesce(F.aggregate("data", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)))).first()[0] or 0

    names = {c: f"{p}{c}" for c in ("uid", "copy", "data")}
    marked = keyed.withColumnRenamed(f"{p}u", names["uid"]).join(by_size(flags.withColumnsRenamed(names), size, 1), names["uid"], "left")
    plain = marked.withColumn(f"{p}t", plain_text(text))
    schema = T.StructType(list(docs.schema.fields))
    for c in _NEW:
        schema = schema.add(c, T.StringType() if c in ("kept_sha256", "clean_text") else T.LongType())
    return plain.mapInArrow(_remove(width, docs.columns, f"{p}t", names["copy"], names["data"], with_text), schema)
