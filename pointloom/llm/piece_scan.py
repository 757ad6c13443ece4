"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

The lattice of a text has its vocabulary pieces as edges.  A path's weight is the sum of the
scores of its pieces, and minus infinity where two neighbours may not follow each other: in a
BPE model two pieces may be neighbours only if merging the two alone gives just them, and the
one path all of whose neighbours may is the encoding.  (A unigram model has no such rule.)

A chunk's transfer matrix has, for each state at its left and right boundary, the best weight
between them; a state is the last piece that starts before the boundary.  A chunk with a place
that no piece crosses has a matrix that is a column plus a row, and is kept as those two.  Matrices
multiply in the max-plus semiring, which is associative, so they are combined in groups, level by level.
Going down again fixes the states at all boundaries, and each chunk traces its own path.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import numbered, own_columns, plain_text, small_batches, stored

#: Matrices that are multiplied by one task.
GROUP = 64
#: Stretches up to this length are merged directly and remembered.
LONG = 64
#: Stretches that a worker remembers; more start it anew.
MOST = 200_000
NO = -np.inf
BLANK = "\u2581"


@dataclass
class Meeting:
    """The matrix ``column[:, None] + row[None, :]``: all its paths go through one place."""

    column: np.ndarray
    row: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.column[i] + self.row

    def into(self, j: int) -> np.ndarray:
        return self.column + self.row[j]


@dataclass
class Dense:
    """A matrix in full."""

    all: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.all[i]

    def into(self, j: int) -> np.ndarray:
        return self.all[:, j]


def after(v: np.ndarray, m: Meeting | Dense) -> np.ndarray:
    """Best weights behind ``m``, from those before it."""
    if isinstance(m, Meeting):
        return (v + m.column).max() + m.row
    return (v[:, None] + m.all).max(0) if len(v) else np.full(m.all.shape[1], NO)


def times(a: Meeting | Dense, b: Meeting | Dense) -> Meeting | Dense:
    """Max-plus product; a column plus a row as soon as one factor is."""
    if isinstance(a, Meeting):
        return Meeting(a.column, after(a.row, b))
    if isinstance(b, Meeting):
        return Meeting((a.all + b.column[None, :]).max(1), b.row)
    return Dense((a.all[:, :, None] + b.all[None, :, :]).max(1) if a.all.shape[1] else np.full((a.all.shape[0], b.all.shape[1]), NO))


class Pieces:
    """Vocabulary of a model as the lattice needs it."""

    def __init__(self, score: dict[str, float], bpe: bool):
        self.score, self.bpe = score, bpe
        self.longest = max(map(len, score), default=1)
        self.inside = {p[i : i + 2] for p in score for i in range(len(p) - 1)}
        self._letter = {c: i + 1 for i, c in enumerate(sorted({c for pair in self.inside for c in pair}))}
        codes = np.array([0, *map(ord, self._letter)], np.int64)  # 0 stands for letters of no pair
        self._codes = codes
        self._crossed = np.zeros((len(codes), len(codes)), bool)
        for a, b in self.inside:
            self._crossed[self._letter[a], self._letter[b]] = True
        self.unknown = min(score.values(), default=0.0) - 10.0
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[list[str], float]] = {}

    def free(self, text: str, lo: int, hi: int) -> list[int]:
        """Places in [lo, hi] that no piece crosses."""
        left = max(lo - 1, 0)
        chars = np.frombuffer(text[left : hi + 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self._codes, chars).clip(max=len(self._codes) - 1)
        letters = np.where(self._codes[at] == chars, at, 0)
        places = (np.flatnonzero(~self._crossed[letters[:-1], letters[1:]]) + left + 1).tolist()
        return [0, *places] + [len(text)] * (hi == len(text) > 0) if lo == 0 else places + [len(text)] * (hi == len(text))

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        known, get = list(text), self.score.get
        gain = [get(a + b, NO) for a, b in zip(known, known[1:])]
        while gain:
            best = max(gain)
            if best == NO:
                break
            i = gain.index(best)
            known[i] += known.pop(i + 1)
            del gain[i]
            if i < len(gain):
                gain[i] = get(known[i] + known[i + 1], NO)
            if i:
                gain[i - 1] = get(known[i - 1] + known[i], NO)
        return known

    def follows(self, a: str, b: str) -> bool:
        if not self.bpe or a[-1] + b[0] not in self.inside:
            return True
        ok = self._pairs.get((a, b))
        if ok is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            ok = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def at(self, text: str, i: int) -> list[str]:
        """Pieces that start at ``i``; a single character always is one."""
        out, n = [text[i]], 1
        while n < self.longest and i + n < len(text) and text[i + n - 1 : i + n + 1] in self.inside:
            n += 1
            if text[i : i + n] in self.score:
                out.append(text[i : i + n])
        return out

    def weight(self, p: str) -> float:
        return self.score.get(p, self.unknown)

    def states(self, text: str, b: int, first: int = 0) -> list[tuple[int, int]]:
        """(start, end) of the pieces that start before ``b`` and end at or behind it, in order."""
        if b == 0 and first == 0:
            return [(0, 0)]
        return [(s, s + len(p)) for s in range(max(0, b - self.longest), b) for p in self.at(text, s) if s + len(p) >= b]

    def lattice(self, text: str, lo: int, hi: int, entries: list, exits: list | None = None, exact: tuple | None = None):
        """Forward pass over the pieces that start in [lo, hi), from states at ``lo`` to states at ``hi``.

        With ``exits`` returns the weights; with a single entry and ``exact``, an exit state, the
        pieces of the best path to it.
        """
        n = len(entries)
        ends: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for i, (s, e) in enumerate(entries):
            v = np.full(n, NO)
            v[i] = 0.0
            ends.setdefault(e, {})[s, e] = v
        for pos in range(lo, hi):
            before = ends.get(pos)
            if not before:
                continue
            for p in self.at(text, pos):
                best, tail = None, (pos, pos + len(p))
                for (s, e), v in before.items():
                    if s == e or self.follows(text[s:e], p):
                        if best is None:
                            best, back[tail] = v, (s, e)
                        elif n == 1:
                            if v[0] > best[0]:
                                best, back[tail] = v, (s, e)
                        else:
                            best = np.maximum(best, v)
                if best is not None:
                    ends.setdefault(tail[1], {})[tail] = best + self.weight(p)
            ends.pop(pos - 1, None)  # nothing that starts later touches it
        if exact is None:
            return np.stack([ends.get(e, {}).get((s, e), np.full(n, NO)) for s, e in exits], 1) if exits else np.empty((n, 0))
        out, at = [], exact
        while at != entries[0]:
            out.append(text[at[0] : at[1]])
            at = back[at]
        return out[::-1]

    def best(self, word: str) -> tuple[list[str], float]:
        """The best path of a stretch whose two ends no piece crosses, and its weight."""
        known = self._words.get(word)
        if known is None:
            if self.bpe and len(word) <= LONG:
                path = self.merged(word)
            else:
                exits = [s for s in self.states(word, len(word)) if s[1] == len(word)]
                last = exits[int(self.lattice(word, 0, len(word), [(0, 0)], exits)[0].argmax())]
                path = self.lattice(word, 0, len(word), [(0, 0)], exact=last)
            known = path, sum(map(self.weight, path))
            if len(word) <= LONG:
                if len(self._words) >= MOST:
                    self._words.clear()
                self._words[word] = known
        return known

    def run(self, text: str, lo: int, hi: int, last: bool, exact: tuple | None = None):
        """Transfer matrix of the chunk [lo, hi); with (entry state, exit state) its pieces between them.

        Between places that no piece crosses all entry states have become one, so only what
        lies before the first and behind the last such place needs the lattice.
        """
        entries = [exact[0]] if exact else self.states(text, lo)
        exits = [s for s in self.states(text, hi) if not last or s[1] == len(text)]
        free = self.free(text, lo, hi)
        if len(free) < 2:
            return Dense(self.lattice(text, lo, hi, entries, exits)) if exact is None else self.lattice(text, lo, hi, entries, exact=exact[1])
        first, end = free[0], free[-1]
        middle = [self.best(text[a:b]) for a, b in zip(free, free[1:])]
        turn = (end - len(middle[-1][0][-1]), end)
        meet = self.states(text, first) if first > lo else []
        left = self.lattice(text, lo, first, entries, meet) if first > lo else np.zeros((len(entries), 1))
        if exact:
            out = self.lattice(text, lo, first, entries, exact=meet[int(left[0].argmax())]) if first > lo else []
            return out + [p for path, _ in middle for p in path] + (self.lattice(text, end, hi, [turn], exact=exact[1]) if end < hi else [])
        weight = sum(w for _, w in middle)
        right = self.lattice(text, end, hi, [turn], exits)[0] if end < hi else np.array([0.0 if s == turn else NO for s in exits])
        return Meeting(left.max(1) + weight, right)


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.sp, self.sp.get_piece_size()
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.pieces = Pieces({p: sp.get_score(i) for p, i in self.ids.items()}, spec.trainer_spec.model_type == 2)
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.unk = sp.unk_id()
        #: Nothing is rewritten but blanks, so pieces joined are the text behind one blank.
        norm = spec.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        plain = plain and self.byte is not None and not spec.HasField("denormalizer_spec") and not spec.trainer_spec.treat_whitespace_as_suffix
        #: Bytes of each piece, and pieces that lose just their blank at the start of a text.
        self.text: dict[int, bytes] = {}
        if plain:
            for p, i in self.ids.items():
                self.text[i] = p.replace(BLANK, " ").encode()
            for b, i in enumerate(self.byte):
                self.text[i] = bytes([b])
        self.heads = {i for p, i in self.ids.items() if plain and p[0] == BLANK and len(p) > 1 and p[1] != BLANK}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts by the library, packed."""
        return [array("i", ids).tobytes() for ids in self.sp.encode(texts, num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        """The library's text; joined from a table where that is plain."""
        if ids and ids[0] in self.heads:
            try:
                return b"".join([self.text[i] for i in ids])[1:].decode()
            except (KeyError, UnicodeDecodeError):  # control, unknown and no pieces, loose bytes
                pass
        return self.sp.decode(ids)

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            elif not (out and out[-1] == self.unk):
                out.append(self.unk)
        return out


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _encoded(path: str, text: Column) -> Column:
    """Ids of texts of moderate length, by the library."""

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        m, texts, out, at, size = model(path), [t or "" for t in column.to_pylist()], [], 0, 0
        for i, t in enumerate(texts):  # bounded slices
            size += len(t)
            if size > 1 << 21 or i == len(texts) - 1:
                out += m.encode(texts[at : i + 1])
                at, size = i + 1, 0
        cut = np.cumsum([0, *[len(b) // 4 for b in out]], dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(out), "<i4")))

    # Spark would otherwise put the call into each expression that reads the ids, and encode once for each
    return ids_of.asNondeterministic()(text)


_CHUNK = "rid bigint, c int, n int, lo int, hi int, text string"


def _chunks(path: str, size: int):
    """Chunks of normalised giant texts, each with a margin of one piece on both sides."""

    def run(batches):
        m = model(path)
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
                whole = m.sp.normalize(text)
                n, margin = max(1, -(-len(whole) // size)), 2 * m.pieces.longest
                for c in range(n):
                    lo, hi = c * size, min(len(whole), (c + 1) * size)
                    left = 0 if c == 0 else max(0, lo - margin)
                    part = whole[left : hi if c == n - 1 else hi + margin]
                    row = [rid, c, n, lo - left, hi - left, part]
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in _CHUNK.split(", ")])

    return run


_MATRIX = "rid bigint, c int, n int, rows int, m binary, row binary"


def _matrix_rows(rid: int, c: int, n: int, m: Meeting | Dense) -> pa.Table:
    first = m.column if isinstance(m, Meeting) else m.all
    row = m.row.tobytes() if isinstance(m, Meeting) else None
    data = [rid, c, n, first.shape[0], np.ascontiguousarray(first).tobytes(), row]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([v], t) for v, t in zip(data, types)], ["rid", "c", "n", "rows", "m", "row"])


def _matrix(rows: int, data: bytes, row: bytes | None) -> Meeting | Dense:
    first = np.frombuffer(data, np.float64)
    return Dense(first.reshape(rows, -1)) if row is None else Meeting(first, np.frombuffer(row, np.float64))


def _matrices(path: str):
    def run(batches):
        pieces = model(path).pieces
        for batch in batches:
            for rid, c, n, lo, hi, text in zip(*[x.to_pylist() for x in batch.columns]):
                yield from _matrix_rows(rid, c, n, pieces.run(text, lo, hi, c == n - 1)).to_batches()

    return run


def _ordered(table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["c"])


def _product(key, table):
    rows = _ordered(table)
    out = _matrix(rows[0]["rows"], rows[0]["m"], rows[0]["row"])
    for r in rows[1:]:
        out = times(out, _matrix(r["rows"], r["m"], r["row"]))
    return _matrix_rows(key[0].as_py(), key[1].as_py(), -(-rows[0]["n"] // GROUP), out)


def _best_end(batches):
    """The best last piece of each text, by the matrix of the whole text."""
    for batch in batches:
        last = [int(_matrix(*x)[0].argmax()) for x in zip(*[batch.column(c).to_pylist() for c in ("rows", "m", "row")])]
        data = [batch.column("rid"), batch.column("c"), pa.array([0] * len(last), pa.int32()), pa.array(last, pa.int32())]
        yield pa.RecordBatch.from_arrays(data, ["rid", "c", "first", "last"])


def _states_below(key, table):
    """States at the inner boundaries of a group whose outer ones are known."""
    rows = _ordered(table)
    first, last = rows[0]["first"], rows[0]["last"]
    ms = [_matrix(r["rows"], r["m"], r["row"]) for r in rows]
    forward = [ms[0][first]]
    for m in ms[1:]:
        forward.append(after(forward[-1], m))
    at = [last]
    for m, f in zip(ms[:0:-1], forward[-2::-1]):
        at.append(int((f + m.into(at[-1])).argmax()))
    at = at[::-1]
    firsts = [first, *at[:-1]]
    data = [[r["rid"] for r in rows], [r["c"] for r in rows], firsts, at]
    return pa.table([pa.array(v, t) for v, t in zip(data, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["rid", "c", "first", "last"])


def _trace(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            names = ("rid", "c", "n", "lo", "hi", "text", "first", "last")
            for rid, c, n, lo, hi, text, first, last in zip(*[batch.column(x).to_pylist() for x in names]):
                entry = m.pieces.states(text, lo)[first]
                exits = [s for s in m.pieces.states(text, hi) if c < n - 1 or s[1] == len(text)]
                found = m.pieces.run(text, lo, hi, c == n - 1, (entry, exits[last]))
                data = [[rid], [c], [m.numbers(found)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, (pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["rid", "c", "ids"])

    return run


def _scan(giant: DataFrame, path: str, chunk: int) -> DataFrame:
    """(rid, ids) of giant texts."""
    parts = int(giant.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = stored(giant.mapInArrow(_chunks(path, chunk), _CHUNK).repartition(parts, "rid", "c"), "chunks")
    levels = [stored(chunks.mapInArrow(_matrices(path), _MATRIX), "matrices")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        group = F.floor(F.col("c") / GROUP).cast("int").alias("g")
        levels.append(stored(levels[-1].groupBy("rid", group).applyInArrow(_product, _MATRIX), "matrices"))
    states = levels[-1].mapInArrow(_best_end, "rid bigint, c int, first int, last int")
    for level in levels[-2::-1]:
        above = states.select("rid", F.col("c").alias("g"), "first", "last")
        below = level.withColumn("g", F.floor(F.col("c") / GROUP).cast("int")).join(above, ["rid", "g"])
        states = stored(below.groupBy("rid", "g").applyInArrow(_states_below, "rid bigint, c int, first int, last int"), "states")
    traced = chunks.join(states, ["rid", "c"]).mapInArrow(_trace(path), "rid bigint, c int, ids array<int>")
    lists = traced.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("c", "ids"))).alias("l"))
    return lists.select("rid", F.flatten(F.transform("l", lambda x: x["ids"])).alias("ids"))


def encode_pieces(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", giant_chars: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """Add ``ids``: the SentencePiece encoding of each whole text.

    Texts of up to ``giant_chars`` characters are encoded by the library; longer ones by the scan
    over chunks, with the same result.  Null and empty texts give an empty list.  Rows with null or
    repeated ids are encoded row by row; a column ``ids`` of ``docs`` is replaced; an empty table
    gives an empty table.  BPE models need the rule on neighbours, which is checked against the
    library in tests; a text without any place that no piece crosses is scanned as a whole.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "ids"])
    r = f"{own_columns(docs, 'ids')}r"
    is_giant = F.length(plain_text(text)) > giant_chars
    done = docs.filter(~is_giant).withColumn("ids", _encoded(model_file, F.col(text)))  # no shuffle: the row keeps its ids
    giant = numbered(docs.filter(is_giant), doc_id, r)
    found = _scan(giant.select(F.col(r).alias("rid"), F.col(text).alias("text")), model_file, chunk)
    return done.unionByName(giant.join(found.withColumnRenamed("rid", r), r).drop(r))


def decode_pieces(df: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of a list of ids; null gives null, ids out of range an error."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        m = model(model_file)
        cut, flat = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()
        known = column.is_valid().to_pylist()
        return pa.array([m.decode(flat[i:j]) if ok else None for ok, i, j in zip(known, cut[:-1], cut[1:])], pa.string())

    return df.withColumn(out, text_of(F.col(ids)))


def ids_crc32(column):
    """CRC-32 of a list of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def crc(lists: pa.Array) -> pa.Array:
        cut, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        known = lists.is_valid().to_pylist()
        return pa.array([zlib.crc32(ids[i:j].tobytes()) if ok else None for ok, i, j in zip(known, cut[:-1], cut[1:])], pa.int64())

    return crc(column)
