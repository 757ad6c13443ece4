"""Benchmark runs: from a pair list and a dataset folder to statistics, summary and log."""

from __future__ import annotations

import sys
import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..operators import evaluate
from ..session import cut_lineage
from ..sources import sinks
from ..sources.datasets import dataset, read_pairs
from .correspondences import PAIR
from .registration import evaluate_front_end, register


def cloud_key(seq: Column, frame: Column) -> Column:
    """One number per sweep."""
    return F.shiftleft(seq.cast("long"), 32) + frame.cast("long")


def batch_items(spark: SparkSession, pair_list: str) -> DataFrame:
    """Pairs with the keys of their sweeps, the true pose and the overlap."""
    items = read_pairs(spark, pair_list)
    keys = {"src": cloud_key(F.col("seq"), F.col("src_idx")), "tgt": cloud_key(F.col("seq_db"), F.col("tgt_idx"))}
    return cut_lineage(items.withColumns(keys).withColumnRenamed("pose", "truth"))


def batch_points(spark: SparkSession, items: DataFrame, name: str, root: str) -> DataFrame:
    """Points of the sweeps that the pairs name; no other file is opened.

    The names of the sweeps go through the driver, as the listing of the folder does.
    """
    ends = items.select(F.col("seq").alias("s"), F.col("src_idx").alias("f")).union(items.select("seq_db", "tgt_idx")).distinct()
    frames: dict[int, list[int]] = defaultdict(list)
    for r in ends.collect():
        frames[r["s"]].append(r["f"])
    out = None
    for seq, wanted in sorted(frames.items()):
        some = dataset(name).clouds(spark, root).filter((F.col("seq") == seq) & F.col("frame").isin(sorted(wanted)))
        some = some.select(cloud_key(F.col("seq"), F.col("frame")).alias("cloud"), F.col("point_id").alias("pid"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("the pair list is empty")
    return cut_lineage(out)


def run_registration(spark: SparkSession, cfg: Config, pair_list: str, out: str) -> DataFrame:
    """Register all pairs of a list, write everything below ``out`` and return the summary.

    ``results`` (Parquet) has a row per pair with errors, success and inliers; ``statistics``
    the values line by line, overall and per sequence; ``summary`` and ``log`` what a reader
    wants first.  ``total_time`` is the wall time of the run in ms, shared equally by the pairs, as
    all are registered at once.
    """
    items = batch_items(spark, pair_list)
    began = time.perf_counter()
    points = batch_points(spark, items, cfg.dataset, cfg.dataset_root)
    found = cut_lineage(register(points, items.select(*PAIR).distinct(), cfg))
    spent = 1000.0 * (time.perf_counter() - began) / max(1, items.count())
    results = items.join(found, PAIR, "left").withColumn("total_time", F.lit(spent))
    results = cut_lineage(evaluate.with_success(results, cfg.rot_thresh, cfg.trans_thresh))
    results.write.mode("overwrite").parquet(f"{out}/results")
    sinks.write_statistics(results, f"{out}/statistics/all")
    sinks.write_statistics(results, f"{out}/statistics/sequences", per_sequence=True)
    sinks.write_log(results, f"{out}/log")
    summary = cut_lineage(evaluate.summarize(results))
    sinks.write_report(summary, f"{out}/summary")
    return summary


def run_matching(spark: SparkSession, cfg: Config, pair_list: str, out: str) -> DataFrame:
    """Front end alone: matches, true positives and precision per pair, and their means."""
    items = batch_items(spark, pair_list)
    points = batch_points(spark, items, cfg.dataset, cfg.dataset_root)
    metrics = evaluate_front_end(points, items.select(*PAIR).distinct(), items.select(*PAIR, "truth").dropDuplicates(PAIR), cfg)
    metrics = cut_lineage(items.select("seq", *PAIR).join(metrics, PAIR, "left").na.fill(0, ["matches", "tp"]).na.fill(0.0, ["precision"]))
    metrics.write.mode("overwrite").parquet(f"{out}/matches")
    summary = cut_lineage(evaluate.match_summary(metrics))
    sinks.write_report(summary, f"{out}/match_summary")
    return summary


def main(args: list[str]) -> None:
    """batch.py register|match PAIR_LIST OUT CONFIG..."""
    kind, pair_list, out, *configs = args
    spark = SparkSession.builder.appName(f"pointloom-{kind}").getOrCreate()
    {"register": run_registration, "match": run_matching}[kind](spark, load_config(*configs), pair_list, out).show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
