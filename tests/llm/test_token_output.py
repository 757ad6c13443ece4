"""Token files: exact round trip and coded offsets."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import queries
from pointloom.llm.elias_fano import EliasFano, encode
from pointloom.llm.token_output import TokenFile, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(docs):
    t = Tokenizer.from_file(PATH)
    at, out = 0, []
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.QUERIES["op6_token_output"](spark, root).collect())
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == expected([tuple(r) for r in docs])


def test_edges_and_random_access(spark):
    docs = [(-5, "minus"), (3, None), (4, ""), (9, "long " * 5000), (9, "again"), (9, "again"), (70, "é\0 end"), (80, "hello <|endoftext|> world"), (None, "none"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("uri", F.lit("x")).withColumn("start", F.lit(1))
    manifest = write_tokens(df, PATH, end_id=2)
    got = read_tokens(manifest, with_ids=True).collect()
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])] == np.cumsum([0, *[r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])]])[:-1].tolist()
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[3])
    assert sorted([(r["doc_id"], 0, r["n_tokens"], r["ids_crc32"]) for r in got], key=key) == sorted([(i, 0, n, c) for i, _, n, c in expected(docs)], key=key)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [-5, 3, 4, 9, 9, 9, 70, 80, None, None]
    seen = []
    for r in manifest.orderBy("shard").collect():
        f = TokenFile(r["uri"])
        seen += [f.document(i).tolist() for i in range(f.n_docs)]
        f.close()
    assert seen == [r["ids"] for r in sorted(got, key=lambda r: r["start"])]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(df, PATH, end_id=2)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_elias_fano(n):
    rnd = random.Random(n)
    for most in (0, 1, 10, 1 << 40):
        values = sorted(rnd.randrange(most + 1) for _ in range(n))
        data = encode(np.array(values, np.uint64))
        ef = EliasFano(data + b"more")
        assert ef.size == len(data)
        assert ef.block(0, n).tolist() == values
        for a, b in [(0, 1), (n // 3, n // 2), (250, 260), (n - 3, n + 9)]:
            assert ef.block(a, b).tolist() == values[max(a, 0) : max(b, 0)]
        assert [ef[i] for i in range(0, n, 7)] == values[::7]
        if n == 5000:
            assert len(data) * 8 < n * (2.2 + max(0, np.log2(max(1, most / n)))) + 800
