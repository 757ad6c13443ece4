"""Pieces: the scan against the library and against all paths."""

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pointloom.llm import piece_scan, queries
from pointloom.llm.piece_scan import Dense, Meeting, Pieces, after, decode_pieces, encode_pieces, times

PATH = public_tokenizers.path("piece_bpe_32k.model")


def scanned(pieces, text, size):
    """One text by matrices of ``size`` characters, without Spark."""
    cuts = [*range(0, len(text), size), len(text)]
    spans = list(zip(cuts[:-1], cuts[1:]))
    ms = [pieces.run(text, a, b, b == len(text)) for a, b in spans]
    total = ms[0]
    for m in ms[1:]:
        total = times(total, m)
    assert total[0].shape == (len([s for s in pieces.states(text, len(text)) if s[1] == len(text)]),)
    last = int(total[0].argmax())
    forward = [ms[0][0]]
    for m in ms[1:]:
        forward.append(after(forward[-1], m))
    at = [last]
    for m, f in zip(ms[:0:-1], forward[-2::-1]):
        at.append(int((f + m.into(at[-1])).argmax()))
    out, entry = [], (0, 0)
    for (a, b), state in zip(spans, at[::-1]):
        exits = [s for s in pieces.states(text, b) if b < len(text) or s[1] == len(text)]
        out += pieces.run(text, a, b, b == len(text), (entry, exits[state]))
        entry = exits[state]
    return out, total[0].max()


def test_products_of_both_kinds_agree():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        a, b, c = rnd.integers(1, 6, 3)
        x, y = Meeting(rnd.normal(size=a), rnd.normal(size=b)), Meeting(rnd.normal(size=b), rnd.normal(size=c))
        full = lambda m: m.all if isinstance(m, Dense) else m.column[:, None] + m.row[None, :]
        want = full(times(Dense(full(x)), Dense(full(y))))
        for left in (x, Dense(full(x))):
            for right in (y, Dense(full(y))):
                assert np.allclose(full(times(left, right)), want)
                assert np.allclose(after(left[0], right), want[0])


def test_bpe_equals_the_library():
    m = piece_scan.Model(PATH)
    rnd = random.Random(6)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "日本", "🙂", "er", "anti", "dis", "estab", "x" * 5, "zq", "."]
    for _ in range(250):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40)))
        got, _ = scanned(m.pieces, m.sp.normalize(text), rnd.choice([17, 20, 50]))
        assert m.numbers(got) == m.sp.encode(text), text


def test_unigram_takes_the_best_path():
    rnd = random.Random(8)
    score = {p: -rnd.uniform(1, 5) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "bcab"]}
    pieces = Pieces(score, bpe=False)
    for _ in range(60):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 13)))
        best = -np.inf
        for k in range(len(text)):
            for cut in combinations(range(1, len(text)), k):
                b = [0, *cut, len(text)]
                path = [text[i:j] for i, j in zip(b[:-1], b[1:])]
                if all(p in score for p in path):
                    best = max(best, sum(score[p] for p in path))
        for size in (5, 100):
            got, total = scanned(pieces, text, size)
            assert "".join(got) == text and abs(sum(score[p] for p in got) - best) < 1e-9 and abs(total - best) < 1e-9


@pytest.mark.parametrize("group", [2, 64])
def test_spark_scan_and_edges(spark, monkeypatch, group):
    monkeypatch.setattr(piece_scan, "GROUP", group)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    long = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(6).collect()]
    rows = [(1, None), (2, ""), (3, "  two  blanks "), (3, "again"), (None, "none"), (5, "y" * 700 + "antidisestablishment" * 30), *[(10 + i, t) for i, t in enumerate(long)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as c", "'x' as IDS")
    got = decode_pieces(encode_pieces(df, PATH, giant_chars=200, chunk=64), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"], r["ids"]) for r in got], key=key) == sorted([(i, t, sp.encode(t or "")) for i, t in rows], key=key)
    assert all(r["decoded"] == sp.decode(r["ids"]) for r in got)


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    want = [(i, len(x := sp.encode(t or "")), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, t in docs]
    assert sorted(tuple(r) for r in queries.QUERIES["op10_piece_scan"](spark, root).collect()) == sorted(want)


def test_empty_table(spark):
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_free_places_and_merges():
    p = piece_scan.Model(PATH).pieces
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice(["th", "▁", "e", "日", "🙂", ".", "\n", "q", "ing"]) for _ in range(rnd.randrange(1, 30)))
        lo = rnd.randrange(len(text))
        hi = rnd.randrange(lo, len(text) + 1)
        want = [i for i in range(lo, hi + 1) if i in (0, len(text)) or text[i - 1 : i + 1] not in p.inside]
        assert p.free(text, lo, hi) == want, (text, lo, hi)


def test_decoding_equals_the_library():
    m = piece_scan.Model(PATH)
    rnd = random.Random(12)
    some = [m.sp.piece_to_id(p) for p in ("▁", "▁▁", "▁a", "a", "▁▁▁▁", "the", "<0xE6>", "<0x97>", "<0xA5>", "<0x20>", "<0x41>", "日")] + [0, 1, 2]
    for _ in range(800):
        ids = [rnd.choice(some) for _ in range(rnd.randrange(0, 8))]
        assert m.decode(ids) == m.sp.decode(ids), ids
    for text in ("", "a b", " a", "日本 🙂\n x ", "  "):
        assert m.decode(m.sp.encode(text)) == text
    assert m.heads
    with pytest.raises(IndexError):
        m.decode([some[2], 10**6])
    with pytest.raises(IndexError):
        m.decode([some[2], -1])


def test_texts_are_encoded_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    df = decode_pieces(encode_pieces(docs, PATH), PATH).select("doc_id", "decoded", piece_scan.ids_crc32("ids").alias("c"), "ids")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ids_of(") == 1
    assert df.first()["decoded"] == "a b"
