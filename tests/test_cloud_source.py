"""Dataset folders as tables, compressed clouds, and sinks that survive failing tasks."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThan, StringContains

from pointloom.sources import datasets, pcd, sinks, text_sink
from pointloom.sources.cloud_source import CloudReader, read_clouds


def lzf_pack(data: bytes) -> bytes:
    """Greedy LZF: copies of three bytes or more that lie at most 8192 back, literals otherwise."""
    out, literal, at, seen = bytearray(), bytearray(), 0, {}

    def flush():
        for i in range(0, len(literal), 32):
            piece = literal[i : i + 32]
            out.append(len(piece) - 1)
            out.extend(piece)
        literal.clear()

    while at < len(data):
        key = data[at : at + 3]
        old = seen.get(key, -1) if len(key) == 3 else -1
        seen[key] = at
        if old < 0 or at - old > 8192:
            literal.append(data[at])
            at += 1
            continue
        n = 3
        while n < 264 and at + n < len(data) and data[old + n] == data[at + n]:
            n += 1
        flush()
        back = at - old - 1
        out.append((min(n - 2, 7) << 5) | back >> 8)
        if n - 2 >= 7:
            out.append(n - 2 - 7)
        out.append(back & 255)
        at += n
    flush()
    return bytes(out)


def pcd_bytes(rows: np.ndarray, kind: str) -> bytes:
    """x, y, z and a two-byte ring number, with a field of two counts between them."""
    n = len(rows)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z pad ring\nSIZE 4 4 4 4 2\nTYPE F F F F U\nCOUNT 1 1 1 2 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {kind}\n"
    table = np.zeros(n, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("pad", "<f4", 2), ("ring", "<u2")])
    table["x"], table["y"], table["z"], table["ring"] = *rows.T, np.arange(n) % 16
    if kind == "ascii":
        return head.encode() + "".join(f"{r['x']} {r['y']} {r['z']} 0 0 {r['ring']}\n" for r in table).encode()
    if kind == "binary":
        return head.encode() + table.tobytes()
    plain = b"".join(np.ascontiguousarray(table[f]).tobytes() for f in table.dtype.names)
    packed = lzf_pack(plain)
    assert len(packed) < len(plain)
    return head.encode() + struct.pack("<II", len(packed), len(plain)) + packed


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", bytes(range(256)) * 40, b"abcabcabcabcd" * 9 + b"z"])
def test_lzf(data):
    assert pcd.lzf_expand(lzf_pack(data), len(data)) == data
    with pytest.raises(ValueError):
        pcd.lzf_expand(lzf_pack(data), len(data) + 1)


def test_kinds_of_pcd_agree():
    rows = np.round(np.random.default_rng(3).normal(size=(700, 3)), 2).astype(np.float32)
    for kind in ("ascii", "binary", "binary_compressed"):
        assert np.array_equal(pcd.parse_pcd(pcd_bytes(rows, kind)), rows)
    with pytest.raises(ValueError):
        pcd.parse_pcd(pcd_bytes(rows, "ascii").replace(b"DATA ascii", b"DATA other"))


def test_pushed_filters_open_only_their_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for seq in range(3):
        folder = tmp_path / f"{seq:02d}" / "pcd"
        folder.mkdir(parents=True)
        for frame in range(4):
            rows = rng.normal(size=(20 + frame, 3)).astype(np.float32)
            (folder / f"{frame}.pcd").write_bytes(pcd_bytes(rows, ["ascii", "binary", "binary_compressed"][seq]))
            want[seq, frame] = rows
        (folder / "notes.txt").write_text("not a cloud")
    root = str(tmp_path)
    points = datasets.dataset("hit_ms").clouds(spark, root)
    for r in points.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).collect():
        assert r["n"] == len(want[r["seq"], r["frame"]]) and np.isclose(r["x"], want.pop((r["seq"], r["frame"]))[:, 0].sum(), atol=1e-4)
    assert not want
    # files outside the filters would fail when opened
    for seq, frame in ((0, 1), (1, 3), (2, 0)):
        (tmp_path / f"{seq:02d}" / "pcd" / f"{frame}.pcd").write_bytes(b"broken")
    with pytest.raises(PySparkException):
        points.count()
    assert points.filter("seq = 0 and frame > 1").count() == 22 + 23
    assert points.filter(F.col("frame").isin(2)).count() == 3 * 22
    assert points.filter("seq < 2 and frame = 0 and x < 1e9").count() == 40
    reader = CloudReader({"path": root, "layout": "hit_ms"})
    other = StringContains(("path",), "x")
    assert list(reader.pushFilters([EqualTo(("seq",), 1), LessThan(("frame",), 3), In(("frame",), (1, 3)), other])) == [other]
    assert [(f.seq, f.frame) for f in reader.files()] == [(1, 1)]


def test_large_files_are_split(spark, tmp_path):
    folder = tmp_path / "07" / "velodyne"
    folder.mkdir(parents=True)
    rows = np.random.default_rng(2).normal(size=(1000, 4)).astype("<f4")
    rows.tofile(folder / "000005.bin")
    rows[:3].tofile(folder / "000006.bin")
    (tmp_path / "08" / "velodyne").mkdir(parents=True)
    read_clouds(spark, str(tmp_path), "kitti")  # registers the source
    small = spark.read.format("pointclouds").option("layout", "kitti").option("splitBytes", 4000).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == 5
    got = small.filter("frame = 5").orderBy("point_id").select("point_id", "x", "y", "z").toPandas()
    assert got["point_id"].tolist() == list(range(1000)) and np.array_equal(got[["x", "y", "z"]].to_numpy(), rows[:, :3])
    folder = tmp_path / "TestData" / "MathildaAVE" / "2018-10-12" / "pcds"
    folder.mkdir(parents=True)
    for kind, name in (("binary", "1"), ("ascii", "2"), ("binary_compressed", "3")):
        (folder / f"{name}.pcd").write_bytes(pcd_bytes(np.round(rows[:400, :3], 2), kind))
    clouds = spark.read.format("pointclouds").option("layout", "apollo").option("splitBytes", 999).load(str(tmp_path))
    assert clouds.rdd.getNumPartitions() > 6
    for frame in (1, 2, 3):
        got = clouds.filter(F.col("frame") == frame).orderBy("point_id").toPandas()
        assert got["point_id"].tolist() == list(range(400)) and set(got["seq"]) == {22}
        assert np.array_equal(got[["x", "y", "z"]].to_numpy(), np.round(rows[:400, :3], 2))


def test_empty_folder_and_unknown_layout(spark, tmp_path):
    assert read_clouds(spark, str(tmp_path / "none"), "kitti").count() == 0
    with pytest.raises(PySparkException):
        read_clouds(spark, str(tmp_path), "other").count()


def text_of(folder, name):
    return "".join(p.read_text() for p in sorted((folder / name).glob("part-*")))


def test_failing_task_leaves_the_old_output(spark, tmp_path):
    out = tmp_path / "report"
    lines = spark.range(1000).repartition(4).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").cast("string").alias("value"))
    ordered = lines.repartitionByRange("file", "value").sortWithinPartitions("file", "value")
    text_sink.write_parts(ordered, str(out))
    old = {f: text_of(out, f) for f in ("f0", "f1", "f2")}
    assert sorted(map(int, old["f1"].split())) == list(range(1, 1000, 3))
    bad = lines.withColumn("value", F.when(F.col("value") == "777", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(PySparkException):
        text_sink.write_parts(bad, str(out))
    assert {f: text_of(out, f) for f in old} == old  # killed tasks may leave files behind, but never here
    text_sink.write_parts(lines.filter("file = 'f2'").withColumn("value", F.lit("x")), str(out))
    assert not (out / "f0").exists() and set(text_of(out, "f2").split()) == {"x"}
    with pytest.raises(PySparkException):
        text_sink.write_parts(lines, str(out), overwrite=False)
    assert set(text_of(out, "f2").split()) == {"x"}


def test_report_log_and_colours(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 2, True, 0.5, 0.1), (1, 3, 4, False, 9.0, 7.0)], "seq int, src int, tgt int, success boolean, rot_err double, trans_err double")
    sinks.write_log(rows, str(tmp_path / "log"))
    assert text_of(tmp_path / "log", "pairs.log").splitlines() == ["0 1-2 success=true rot_err=0.500 trans_err=0.100", "1 3-4 success=false rot_err=9.000 trans_err=7.000"]
    sinks.write_report(rows.groupBy("seq").count(), str(tmp_path / "rep"))
    assert sorted(text_of(tmp_path / "rep", "summary.json").splitlines()) == ['{"seq":0,"count":1}', '{"seq":1,"count":1}']
    pts = spark.createDataFrame([(1, i, float(i), 0.0, 1.0, i % 2) for i in range(6)], "cloud int, pid long, x double, y double, z double, feature int")
    sinks.write_pcd(sinks.feature_colours(pts, "feature"), str(tmp_path / "pcd"), coloured=True)
    text = text_of(tmp_path / "pcd", "cloud=1")
    assert np.array_equal(pcd.parse_pcd(text.encode())[:, 0], np.arange(6))
    colours = [line.split()[3] for line in text.splitlines()[-6:]]
    assert colours[0] == colours[2] == colours[4] != colours[1] == colours[3]
