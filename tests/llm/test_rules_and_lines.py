"""Quality rules and line dedup: against their SQL, and odd rows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from check import normal
from pointloom.llm import queries
from pointloom.llm.line_dedup import line_dedup
from pointloom.llm.quality import quality_rules

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, ROOT)
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(rel.fetchall(), names)


def test_quality_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(30))
    eight = "a b c d e f g h"
    long = " ".join(f"u{i}" for i in range(10))
    rows = [(None, None, None), (1, "", "h"), (2, " \n\t", "h"), (3, words, "h"), (3, words, "h"), (4, f"{words}\n{eight} x {eight}", None), (5, "é#$ " * 4, "h"), (6, "a " * 30, "h"), (7, "a\nb\na\n\na", "h")]
    rows += [(100 + i, f"Shared  LINE of the host {long}\nown text {i} {words} and more", "big") for i in range(12)] + [(200, f"shared line of THE host {long}" + "\n" * 3 + words, "other")]
    rows += [(300 + i, f"shared line of the host {long}\none{i} two three four five six seven eight", "big") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("KEPT", F.lit("x")).withColumn("_wtext", F.lit(1))
    out = quality_rules(df)
    assert out.columns.count("_wtext") == 1
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[None, None]["n_words"] == 0 and not got[None, None]["kept"]
    assert got[3, words]["kept"] and got[3, words]["n_repeat_words"] == 0
    assert got[4, rows[5][1]]["n_repeat_words"] == 16
    assert (got[5, rows[6][1]]["word_chars"], got[5, rows[6][1]]["n_symbols"]) == (12, 8)
    assert got[6, rows[7][1]]["n_repeat_words"] == 30
    assert got[7, rows[8][1]]["n_dup_lines"] == 2
    one = got[100, rows[9][1]]
    assert one["kept"] and one["n_common_words"] == 15 and one["clean_text"] == rows[9][1].split("\n")[1]
    assert got[200, rows[21][1]]["clean_text"] == rows[21][1]  # another host
    assert not got[300, rows[22][1]]["kept"] and not got[300, rows[22][1]]["base_failed"]
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_lines_of_odd_rows(spark):
    rows = [(5, "a\nb\nc\nd"), (2, "x\n\na\nb\n \nc\ny"), (9, None), (10, ""), (11, "a\nb"), (None, "b\nc\nd"), (5, "a\nb\nc\nd"), (6, "r\n" * 6), (7, "e\nf\ng\n" + "e\nf\ng")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("z")).withColumn("h", F.lit(0))
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup(df).collect())
    # document 2 comes first, so a-b-c goes from 5; b-c-d of 5 is before the one without an id
    assert got == sorted([(2, "x\n\na\nb\n \nc\ny", 0), (5, "d", 3), (5, "d", 3), (9, "", 0), (10, "", 0), (11, "a\nb", 0), (0, "", 3), (6, "r\n", 5), (7, "e\nf\ng", 3)])
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
