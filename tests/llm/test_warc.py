"""Archives: exact round trip over ranges of any size."""

import gzip
import hashlib
import os

from pyspark.sql import functions as F

from pointloom.llm.warc import archive_files, read_warc, record, write_warc


def test_ranges_cut_members(spark):
    big = "é<p>" * 3000
    rows = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (None, "u", big), (1, "", "short"), (3, "", "short"), (4, "x", None), (6, "x", ""), (7, "x", "\r\n\r\nWARC/1.0" * 20), (2, "http://b", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("z")).withColumn("first", F.lit(1))
    manifest = write_warc(df)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = h == big and i != 2
        want.append((i if i is not None else -1, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    for split in (1, 37, 500, 1 << 24):
        got = read_warc(manifest, split_bytes=split, with_payload=True).collect()
        rows_got = [(-1 if r["page_id"] is None else r["page_id"], *(r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got]
        assert sorted(map(str, rows_got)) == sorted(map(str, want))
        assert all(r["payload"] == b"" for r in got if r["record_type"] == "revisit")
        assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {big, "short", "", rows[8][2]}


def test_foreign_and_damaged_files(spark, tmp_path):
    good = [gzip.compress(record(i, "u", os.urandom(900) + b"\x1f\x8b\x08" + b"text", "0" * 64, None, False)) for i in range(6)]
    bad = bytearray(good[2])
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(b"".join([good[0], good[1], bytes(bad), b"junk\x1f\x8b\x08junk", good[3]]))
    (tmp_path / "b.warc.gz").write_bytes(good[4] + good[5][:-300])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    for split in (100, 1 << 20):
        got = read_warc(archive_files(spark, str(tmp_path)), split_bytes=split).collect()
        assert sorted(r["page_id"] for r in got) == [0, 1, 3, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_warc(write_warc(df)).collect() == []
