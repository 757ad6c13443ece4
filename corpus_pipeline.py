"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm._shared import NOT_SPACE, read, stored
from pointloom.llm.line_dedup import line_dedup
from pointloom.llm.ngram_join import ngram_jaccard_join
from pointloom.llm.packing import best_fit_packing
from pointloom.llm.quality import quality_rules
from pointloom.llm.queries import tokenizer_file
from pointloom.llm.suffix_dedup import suffix_dedup


def _with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents with a new text; documents left without a word go."""
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return df.withColumns(new).filter(F.col("text").rlike(NOT_SPACE)).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many documents of a host share go from the others."""
    # stored first: a filter on the verdict would otherwise be pushed below the counts and compute them again
    judged = stored(quality_rules(docs).select(*docs.columns, "clean_text", "kept"), "judged")
    return _with_text(judged.filter("kept"), docs.columns, F.col("clean_text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go."""
    return _with_text(stored(line_dedup(docs), "lines"), docs.columns, F.col("text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without an id stay."""
    kept = ngram_jaccard_join(docs).filter("component_id is null or component_id = doc_id").select(*docs.columns)
    n = kept.agg(F.count("doc_id").alias("a"), F.countDistinct("doc_id").alias("b")).first()
    if n["a"] == n["b"]:
        return kept
    whole = F.struct(*docs.columns)  # rows that share an id are one document: the smallest row stays
    one = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min(whole).alias("r")).select("r.*")
    return one.unionByName(kept.filter("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier go."""
    return _with_text(suffix_dedup(docs, with_text=True), docs.columns, F.col("clean_text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 4096 tokens."""
    return best_fit_packing(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats), ("best-fit packing", packed)]

#: Shingle sets, suffix orders and tokenizers have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
