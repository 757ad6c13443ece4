"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts are kept on a logarithmic scale: an n-gram with quantised count q is stored as the q
pairs (n-gram, 1) to (n-gram, q).  A reader probes (n-gram, 1), (n-gram, 2), ... until one is
missing; a false positive can only raise a count.  The filter is built in segments by hash
range, with about twelve bits per stored level whatever the corpus.

``lm_score`` has one plan for all sizes: packs of documents send their distinct n-grams with
their training counts to the hash ranges; the task of a range counts, builds its segment, probes
it for every n-gram asked and sends the levels back to the packs, with exact counts of tokens.
``train`` collects the segments of a filter within a bound into a model that can be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import as_text, mixed, numbered, own_columns, plain_text, runs_of, small_batches, stored, word_hashes

END = np.uint64(0x45D9F3B3335B369)  # stands for the end of a text
_HALF = np.uint64(32)
_PACK = "range int, what int, a binary, b binary, c binary, d binary"
_PROBES = 1 << 18  # n-grams whose bit positions are computed at once
_SHORT = np.uint64((1 << 40) - 1)  # what the filter sees of a hash besides its range: a chance match in a range of 10 ** 7 entries has odds of 1 to 10 ** 5
_ANY = np.uint64(1 << 63)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by ``END``, and tokens per text."""
    words, counts = word_hashes(texts)
    out = np.empty(len(words) + len(texts), np.uint64)
    ends = np.cumsum(counts + 1) - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    return out, counts + 1


def _grams(tokens: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` tokens up to each position; 0 where the text has fewer before it."""
    if order == 1:
        return tokens
    with np.errstate(over="ignore"):
        h = np.full(len(tokens), np.uint64(order))
        for back in range(order - 1, -1, -1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([np.zeros(back, np.uint64), tokens[: len(tokens) - back]])
        h = mixed(h) | np.uint64(1)
    first = np.cumsum(counts) - counts
    for k in range(order - 1):
        short = first[counts > k] + k
        h[short] = 0
    return h


def _shortened(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _lengthened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> _HALF) * np.uint64(ranges)) >> _HALF


def _rows(rows) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["range", "what", "a", "b", "c", "d"])


def _count_packs(order: int, ranges: int):
    """Counts per pack of documents by hash range: what = order of the n-grams, a = hashes (shortened but for tokens), b = counts."""

    def run(batches):
        for batch in batches:
            texts = [as_text(t) for t in batch.column("text").to_pylist()]
            for i, j in runs_of(texts, 4 << 20):
                tokens, counts = _token_runs(texts[i:j])
                out = []
                for n in range(1, order + 1):
                    h = _grams(tokens, counts, n)
                    keys, times = np.unique(h[h != 0], return_counts=True)
                    cut = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1, dtype=np.uint64))
                    for r in np.flatnonzero(np.diff(cut)):
                        own = keys[cut[r] : cut[r + 1]]
                        out.append((int(r), n, own.tobytes() if n == 1 else _shortened(own), times[cut[r] : cut[r + 1]].astype(np.uint32).tobytes(), b"", b""))
                if out:
                    yield _rows(out)

    return run


def _token_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_tokens(texts[i:j]) for i, j in runs_of(texts)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def quantised(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def expected(level: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (base ** (level - 1) + np.maximum(base ** (level - 1), base**level - 1)) / 2, 0.0)


def _bits(h: np.ndarray, level: int, k: int, size) -> np.ndarray:
    """The ``k`` bit positions of (n-gram, level) in a segment of ``size`` bits; one row per hash function."""
    with np.errstate(over="ignore"):
        a = mixed((h & _SHORT) + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
        b = mixed(a) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) >> np.uint64(1)) % size for i in range(k)])


def _segment(keys: np.ndarray, level: np.ndarray, bits_per_entry: int = 12) -> tuple[np.ndarray, int, int]:
    """Bytes of the filter of one range, number of hash functions, stored levels."""
    entries = int(level.sum())
    size = max(512, -(-entries * bits_per_entry // 8) * 8)
    k = min(8, max(1, round(0.693 * size / max(1, entries))))
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= q]
        for at in range(0, len(own), _PROBES):
            bits[_bits(own[at : at + _PROBES], q, k, np.uint64(size))] = 1
    return np.packbits(bits, bitorder="little"), k, entries


def _count_ranges(base: float, bits_per_entry: int = 12):
    """Per range: the filter segment (what 0: a = bytes, b = number of hash functions, entries) and token totals (what 1)."""

    def run(batches):
        got: dict[int, dict[int, list]] = {}
        for batch in batches:
            for r, n, keys, times, _, _ in zip(*[c.to_pylist() for c in batch.columns]):
                got.setdefault(r, {}).setdefault(n, []).append((keys, times))
        while got:
            r, by_order = got.popitem()
            grams, counts, out = [], [], []
            for n, parts in by_order.items():
                keys = np.concatenate([np.frombuffer(p[0], np.uint64) if n == 1 else _lengthened(p[0]) for p in parts])
                times = np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]).astype(np.int64)
                sort = np.argsort(keys, kind="stable")
                keys, times = keys[sort], times[sort]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, times = keys[first], np.add.reduceat(times, first)
                if n == 1:
                    out.append((r, 1, np.array([times.sum(), len(keys)], np.int64).tobytes(), b"", b"", b""))
                grams.append(keys)
                counts.append(times)
            bits, k, entries = _segment(np.concatenate(grams), quantised(np.concatenate(counts), base), bits_per_entry)
            info = np.array([k, entries, 8 * len(bits)], np.int64)
            out.append((r, 0, bits.tobytes(), info.tobytes(), b"", b""))
            yield _rows(out)

    return run


@dataclass
class Filter:
    """Segments of the filter by hash range."""

    ranges: int
    segments: np.ndarray
    start: np.ndarray
    size: np.ndarray
    k: np.ndarray

    def level(self, h: np.ndarray) -> np.ndarray:
        """Quantised counts by membership probes, level by level for those that are still found."""
        out = np.zeros(len(h), np.int64)
        for at in range(0, len(h), _PROBES):
            out[at : at + _PROBES] = self._level(h[at : at + _PROBES])
        return out

    def _level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        r = _range_of(h, self.ranges).astype(np.int64)
        alive = np.flatnonzero((h != 0) & (self.size[r] > 0))
        level = 1
        while len(alive):
            seg, hit = r[alive], np.ones(len(alive), bool)
            pos = _bits(h[alive], level, int(self.k.max()), self.size[seg].astype(np.uint64))
            for i, p in enumerate(pos):
                bit = self.start[seg] * 8 + p.astype(np.int64)
                hit &= (((self.segments[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1) == 1) | (self.k[seg] <= i)
            alive = alive[hit]
            out[alive] = level
            level += 1
        return out


def log_probabilities(levels: list[np.ndarray], counts: np.ndarray, base: float, weight: float, n_tokens: int, n_types: int) -> np.ndarray:
    """log10 of the smoothed probability of each token after the ones before it.

    ``levels`` holds, order by order, the level of the n-gram that ends at each token.  An order is
    mixed with the next lower one as with ``weight`` pseudo-counts; the lowest is add-one over the
    known types and one unknown.
    """
    below = expected(levels[0], base)
    p = (below + 1) / (n_tokens + n_types + 1)
    first = np.cumsum(counts) - counts
    for level in levels[1:]:
        context = np.concatenate([[0.0], below[:-1]])
        context[first] = 0.0
        here = np.minimum(expected(level, base), context)  # an n-gram is never more frequent than its context
        p = (here + weight * p) / (context + weight)
        below = here
    return np.log10(p)


@dataclass
class Model:
    """Totals, and the filter if it is small enough to be broadcast."""

    order: int
    base: float
    weight: float
    ranges: int
    n_tokens: int
    n_types: int
    entries: int
    filter: Filter | None

    def level(self, h: np.ndarray) -> np.ndarray:
        if self.filter is None:
            raise ValueError("the filter lies with its hash ranges")
        return self.filter.level(h)

    def log_probabilities(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        levels = [self.level(_grams(tokens, counts, n)) for n in range(1, self.order + 1)]
        return log_probabilities(levels, counts, self.base, self.weight, self.n_tokens, self.n_types)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document stays out of training: a hash of its id; null ids are trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _ranges(rows: DataFrame) -> int:
    """Hash ranges: one per 64 MB of text, or as many as there are shuffle partitions."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))


def train(docs: DataFrame, text: str = "text", order: int = 2, base: float = 2.0, weight: float = 5.0, filter_bytes: int = 64 << 20) -> Model:
    """Count the n-grams of all rows of ``docs`` and build the filter.

    Every n-gram up to ``order`` is counted, none is cut off.  The filter takes about twelve
    bits per stored level; one larger than ``filter_bytes`` is not part of the model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(plain_text(text).alias("text"))
    ranges = _ranges(rows)
    packs = rows.mapInArrow(_count_packs(order, ranges), _PACK).repartitionById(ranges, F.col("range"))
    parts = stored(packs.mapInArrow(_count_ranges(base), _PACK), "counts")
    start, sizes, ks = np.zeros(ranges, np.int64), np.zeros(ranges, np.int64), np.ones(ranges, np.int64)
    total = types = entries = at = 0
    # a few numbers per range
    for r in parts.select("range", "what", F.when(F.col("what") > 0, F.col("a")).alias("a"), "b").orderBy("range", "what").collect():
        if r["what"] == 0:
            k, n, bits = np.frombuffer(r["b"], np.int64)
            start[r["range"]], sizes[r["range"]], ks[r["range"]] = at, bits, k
            at += int(bits) // 8
            entries += int(n)
        else:
            a, b = np.frombuffer(r["a"], np.int64)
            total, types = total + int(a), types + int(b)
    held = None
    if at <= filter_bytes:
        segments = [np.frombuffer(r["a"], np.uint8) for r in parts.filter("what = 0").select("range", "a").orderBy("range").collect()]
        held = Filter(ranges, np.concatenate(segments) if segments else np.zeros(1, np.uint8), start, sizes, ks)
    return Model(order, base, weight, ranges, total, types, entries, held)


_TEXTS = "pack bigint, ids binary, sizes binary, data binary"
_ASKED = "range int, pack bigint, n int, grams binary, times binary"
_ANSWER = "range int, pack bigint, n int, levels binary, exact binary, total bigint, types bigint"
_PACK_BYTES = 8 << 20


def _batch(rows, names: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _text_packs(batches):
    """Packs of documents, named by their first number; ids = numbers with the training flag in the last bit."""

    def packed(ids, texts):
        sizes = np.array([len(t) for t in texts], np.int64)
        data = pa.compress(b"".join(texts), "zstd", asbytes=True)
        return _batch([(ids[0] >> 1, np.array(ids, np.int64).tobytes(), sizes.tobytes(), data)], _TEXTS)

    ids, texts, size = [], [], 0
    for batch in batches:
        for rid, train, text in zip(*[batch.column(c).to_pylist() for c in ("rid", "train", "text")]):
            t = as_text(text)
            if ids and size + len(t) > _PACK_BYTES:
                yield packed(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(rid << 1 | train)
            texts.append(t)
            size += len(t)
    if ids:
        yield packed(ids, texts)


def _unpacked(sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a pack of documents."""
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    raw = pa.decompress(data, decompressed_size=ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""
    return _token_runs([raw[i:j] for i, j in zip([0, *ends], ends)])


def _ask(order: int, ranges: int):
    """Distinct n-grams of each pack with their times in its training documents, by hash range."""

    def run(batches):
        for batch in batches:
            for pack, ids, sizes, data in zip(*[batch.column(c).to_pylist() for c in ("pack", "ids", "sizes", "data")]):
                tokens, counts = _unpacked(sizes, data)
                train = np.repeat(np.frombuffer(ids, np.int64) & 1, counts).astype(bool)
                out = []
                for n in range(1, order + 1):
                    h = _grams(tokens, counts, n)
                    keys = np.unique(h[h != 0])
                    learnt, seen = np.unique(h[train & (h != 0)], return_counts=True)
                    times = np.zeros(len(keys), np.uint32)
                    times[np.searchsorted(keys, learnt)] = seen
                    cut = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1, dtype=np.uint64))
                    for r in np.flatnonzero(np.diff(cut)):
                        own = keys[cut[r] : cut[r + 1]]
                        out.append((int(r), pack, n, own.tobytes() if n == 1 else _shortened(own), times[cut[r] : cut[r + 1]].tobytes()))
                if out:
                    yield _batch(out, _ASKED)

    return run


def _answer(base: float):
    """Levels of the n-grams of each pack, probed in the segment that their range builds from all packs.

    Tokens (n = 1) also get their exact counts; a row of n = 0 has the totals of the range.
    """

    def run(batches):
        got: dict[int, dict[int, list]] = {}
        for batch in batches:
            for r, pack, n, grams, times in zip(*[c.to_pylist() for c in batch.columns]):
                got.setdefault(r, {}).setdefault(n, []).append((pack, grams, times))
        while got:
            r, by_order = got.popitem()
            found, total, types = {}, 0, 0
            for n, parts in by_order.items():
                joined = b"".join(p[1] for p in parts)
                keys, place = np.unique(np.frombuffer(joined, np.uint64) if n == 1 else _lengthened(joined), return_inverse=True)
                times = np.frombuffer(b"".join(p[2] for p in parts), np.uint32)
                count = np.bincount(place, times, len(keys)).astype(np.int64)
                if n == 1:
                    total, types = int(count.sum()), int((count > 0).sum())
                found[n] = keys, place.astype(np.int32), count
            keys, count = (np.concatenate([f[i] for f in found.values()]) for i in (0, 2))
            bits, k, _ = _segment(keys[count > 0], quantised(count[count > 0], base))
            segment = Filter(1, bits, np.zeros(1, np.int64), np.array([8 * len(bits)]), np.array([k]))
            yield _batch([(r, None, 0, None, None, total, types)], _ANSWER)
            for n, (keys, place, count) in found.items():
                level = segment.level(keys | _ANY).astype(np.uint16)
                ends = np.cumsum([len(p[2]) // 4 for p in by_order[n]]).tolist()
                rows = []
                for (pack, _, _), i, j in zip(by_order[n], [0, *ends], ends):
                    exact = count[place[i:j]].tobytes() if n == 1 else None
                    rows.append((r, pack, n, level[place[i:j]].tobytes(), exact, None, None))
                for i in range(0, len(rows), 100):
                    yield _batch(rows[i : i + 100], _ANSWER)

    return run


_SCORE = "rid bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(order: int, base: float, weight: float, n_tokens: int, n_types: int):
    """Scores of the documents of packs that bring the answers to their n-grams, in order of n and range."""

    def run(batches):
        for batch in batches:
            for ids, sizes, data, answers in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "data", "answers")]):
                tokens, counts = _unpacked(sizes, data)
                levels = []
                for n in range(1, order + 1):
                    h = _grams(tokens, counts, n)
                    known = np.flatnonzero(h)
                    place = np.unique(h[known], return_inverse=True)[1]
                    level = np.zeros(len(h), np.int64)
                    level[known] = np.frombuffer(b"".join(a["levels"] for a in answers if a["n"] == n), np.uint16)[place]
                    levels.append(level)
                    if n == 1:
                        exact = np.frombuffer(b"".join(a["exact"] for a in answers if a["n"] == 1), np.int64)[place]
                first = np.cumsum(counts) - counts
                score = np.add.reduceat(log_probabilities(levels, counts, base, weight, n_tokens, n_types), first)
                basic = np.add.reduceat(np.log10(exact + 1) - np.log10(n_tokens + n_types + 1), first)
                known = np.add.reduceat((exact > 0).astype(np.int64), first)
                columns = (np.frombuffer(ids, np.int64) >> 1, counts.astype(np.int64), known, basic, score)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _SCORE.split(", ")])

    return run


def lm_score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    held: Column | None = None,
    order: int = 2,
    base: float = 2.0,
    weight: float = 5.0,
) -> DataFrame:
    """Score every document by a model learnt from those that are not held out.

    ``held`` says which rows stay out of training (default: see ``held_out``).  Tokens are runs
    of bytes other than ASCII white space with A-Z in lower case, then one end.  Adds held_out,
    n_tokens, n_known, train_tokens, base_score (exact add-one unigram log10 probability) and
    score (the model's).  Columns of ``docs`` with these names are replaced.

    Levels and exact counts of tokens come back to packs of documents from their hash ranges, so
    nothing that grows with the corpus is broadcast or collected.

    Null text is one end token.  Rows with null ids are trained on.  Repeated ids and rows are
    scored row by row and counted as often as they come.  An empty table gives an empty table;
    with nothing to train on N and V are 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    p = own_columns(docs, *new)
    docs = docs.withColumn(f"{p}h", held_out(F.col(doc_id)) if held is None else held)
    docs = numbered(docs, doc_id, f"{p}r")
    rows = docs.select(F.col(f"{p}r").alias("rid"), (~F.col(f"{p}h")).alias("train"), plain_text(text).alias("text"))
    texts = stored(rows.mapInArrow(_text_packs, _TEXTS), "texts")
    ranges = _ranges(rows)
    asked = texts.mapInArrow(_ask(order, ranges), _ASKED).repartitionById(ranges, F.col("range"))
    answers = stored(asked.mapInArrow(_answer(base), _ANSWER), "answers")
    sums = answers.filter("n = 0").agg(F.sum("total").alias("total"), F.sum("types").alias("types")).first()
    total, types = sums["total"] or 0, sums["types"] or 0
    back = answers.filter("n > 0").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("n", "range", "levels", "exact"))).alias("answers"))
    scores = texts.join(back, "pack").select("ids", "sizes", "data", "answers").mapInArrow(_score(order, base, weight, total, types), _SCORE)
    out = docs.withColumn("held_out", F.col(f"{p}h")).withColumn("train_tokens", F.lit(total).cast("long"))
    return out.join(scores.withColumnRenamed("rid", f"{p}r"), f"{p}r").drop(f"{p}r", f"{p}h")
