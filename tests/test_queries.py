"""Named queries against their SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal

ROOT = "/root/testdata/sf0.001"
# quick ones from each family; check.py runs them all
NAMES = [
    "voxel_stats", "gaussian_merge", "voxel_normals", "topk_per_class", "mutual_topk", "sample_per_voxel", "first_per_cell",
    "compat_graph_pyramid", "compat_graph_ellipse", "triangles", "otsu_threshold", "tls_sweep", "connected_components", "max_clique",
    "maximal_cliques", "yaw_fit", "radius_neighbours", "nearest_centres", "robust_kernels", "eval_rollup", "frame_neighbour_lookup",
    "run_overlap_join", "polar_cells", "ground_labels", "plane_regions", "convex_hull", "hash_desc", "deskew",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(rel.fetchall(), names)


@pytest.mark.parametrize("name", ["mutual_topk", "tls_sweep", "plane_regions"])
def test_same_result_with_other_partitions(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = entry.queries()[name](spark, ROOT)
        return normal([tuple(r) for r in df.collect()], df.columns)

    try:
        assert run("1") == run("13")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_tiles_do_not_change_pairs(spark):
    from pointloom.operators import compatibility as cg
    from pointloom.plans.correspondences import PAIR
    from pointloom.plans.graph_queries import LEVELS, corr_table

    corr = corr_table(spark, ROOT)
    whole, tiled = (cg.compatible_pairs(corr, PAIR, LEVELS, "point", t).collect() for t in (None, 3))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, tiled))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
