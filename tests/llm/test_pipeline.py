"""The pipeline against a plain version of each stage on its own input."""

import re
from collections import defaultdict

import duckdb
import public_tokenizers

import corpus_pipeline as cp
from pointloom.llm import queries
from pointloom.llm._shared import stored

from .test_ngram_join import brute as components
from .test_packing import check
from .test_suffix_dedup import brute as repeated

ROOT = "/root/testdata/sf0.001"
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


def plain_quality(rows):
    """Documents kept, with the lines that stay, by the SQL of the query and a plain line count."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    names = [d[0] for d in con.execute(queries.QUALITY_SQL).description]
    kept = {r[0] for r in con.fetchall() if r[names.index("kept")]}
    texts, seen = defaultdict(set), defaultdict(set)
    norm = lambda x: SPACE.sub(" ", x).strip(" ").lower()
    for r in rows:
        if SPACE.sub("", r["text"]):
            texts[r["source"]].add(r["text"])
            for x in r["text"].split("\n"):
                if norm(x):
                    seen[r["source"], norm(x)].add(r["text"])
    bad = {k for k, v in seen.items() if len(v) >= 10 and len(v) > 0.1 * len(texts[k[0]])}
    return {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], norm(x)) not in bad) for r in rows if r["doc_id"] in kept}


def plain_lines(docs):
    first, gone = {}, defaultdict(set)
    for i in sorted(docs):
        at = [k for k, x in enumerate(docs[i].split("\n")) if SPACE.sub("", x)]
        parts = docs[i].split("\n")
        for k in range(len(at) - 2):
            w = tuple(parts[x] for x in at[k : k + 3])
            if first.setdefault(w, (i, k)) != (i, k):
                gone[i] |= set(at[k : k + 3])
    out = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}
    return {i: t for i, t in out.items() if SPACE.sub("", t)}


def test_each_stage(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, ROOT), "stage")
        outs.append(docs)
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    tables = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outs[:4]]
    for o in outs[:4]:
        assert o.columns == columns
        assert o.filter("n_chars <> length(text)").isEmpty()
    assert tables[0] == plain_quality(rows)
    assert tables[1] == plain_lines(tables[0])
    comp = components(sorted(tables[1].items()))
    assert tables[2] == {i: t for i, t in tables[1].items() if comp[i][1] == i}
    want = repeated([(i, t.encode()) for i, t in sorted(tables[2].items())])
    for i, (n, removed, _, _) in want.items():
        if n == removed:
            assert i not in tables[3]
        else:
            assert abs(len(tables[3][i].encode()) - (n - removed)) <= 6
    check(outs[4].collect(), sorted(tables[3].items()), 4096, public_tokenizers.path("word_bpe_49k.json"))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "h", 0), (1, "twice " * 30, "en", None, 1), (1, "twice " * 30, "en", None, 1), (2, " ".join(f"w{i}" for i in range(40)), None, "h", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, ROOT), "stage")
    assert [r["doc_id"] for r in docs.collect()] == [2]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, ROOT), "stage")
    assert docs.count() == 0
