"""WARC archives: a writer that stores equal payloads once, and a splittable reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import by_size, plain_text, shared_folder, small_batches, stored
from .files import create, new_file, open_for_reading

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "uri string, n_records bigint, n_bytes bigint"
_RECORD = (
    "uri string, position bigint, record_type string, page_id bigint, url string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, payload binary"
)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as it stands inside its gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, file_bytes: int, level: int):
    def run(batches):
        out = uri = None
        count = 0

        def closed():
            size = out.tell()
            out.close()
            columns = [pa.array([uri]), pa.array([count], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["uri", "n_records", "n_bytes"])

        for batch in batches:
            names = ("page_id", "url", "html", "digest", "refers_to", "revisit")
            for page_id, url, html, digest, refers_to, revisit in zip(*[batch.column(c).to_pylist() for c in names]):
                if out is None:
                    uri = new_file(folder, ".warc.gz")
                    out, count = create(uri), 0
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(record(page_id, url, html.encode(), digest, refers_to, revisit)) + packer.flush())
                count += 1
                if out.tell() >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 100,
    file_bytes: int = 256 << 20,
    level: int = 6,
) -> DataFrame:
    """Write a record per row, each in a gzip member of its own; returns the manifest of files.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest
    page_id is a response and the others revisit it.  Null html is an empty payload; shorter
    payloads are all responses.  A row without an id revisits an equal payload that has one,
    otherwise it is a response; rows that repeat the smallest id are responses too.  Only
    digests and ids are shuffled, not payloads.  Files of lost attempts are not in the manifest.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), plain_text(html).alias("html"))
    keys = rows.select("page_id", F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    same = keys.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
    same = stored(same.filter("k > 1 and first is not null").select("digest", "first"), "payloads")
    marked = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(by_size(same, same.count(), 120), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    marked = marked.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("first")))
    folder = folder or shared_folder(spark, "warc")
    return stored(marked.mapInArrow(_write(folder, file_bytes, level), _MANIFEST), "manifest")


class _Source:
    """Bytes of a file from any position, read ahead in steps."""

    def __init__(self, uri: str, step: int = 1 << 20):
        self.file, self.step = open_for_reading(uri), step
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at = at
            self.data = self.file.read_at(min(max(n, self.step), max(0, self.size - at)), at)
        return self.data[at - self.at : at - self.at + n]

    def find_magic(self, at: int, end: int) -> int:
        """First possible member start in [at, end), or ``end``."""
        while at < end:
            n = min(self.step, end - at + len(MAGIC) - 1)
            k = self.get(at, n).find(MAGIC)
            if k >= 0 and at + k < end:
                return at + k
            at += max(1, n - len(MAGIC) + 1)
        return end


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """Content of the member at ``at`` and the position after it; None if there is no WARC member."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    checked = False
    try:
        while not unpack.eof:
            data = source.get(pos, min(1 << 16, source.size - pos))
            if not data:
                return None
            pos += len(data)
            out.append(unpack.decompress(data))
            if not checked and sum(map(len, out)) >= 7:
                if b"".join(out)[:7] != b"WARC/1.":
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(out), pos - len(unpack.unused_data)) if checked else None


def parsed(content: bytes) -> dict:
    """Header fields in lower case, and the payload behind the HTTP header."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields | {"payload": block}


def _read(with_payload: bool):
    def run(batches):
        names = [c.split()[0] for c in _RECORD.split(", ")]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for uri, start, end in zip(*[batch.column(c).to_pylist() for c in ("uri", "start", "end")]):
                source, rows, at = _Source(uri), [], start
                while (at := source.find_magic(at, end)) < end:
                    got = _member(source, at)
                    if got is None:  # the three bytes stood there by chance, or the member is damaged
                        at += 1
                        continue
                    f, after = parsed(got[0]), got[1]
                    kind, body = f.get("warc-type"), f["payload"]
                    revisit = kind == "revisit"
                    number = lambda k: int(f[k]) if k in f else None
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2] if revisit else hashlib.sha256(body).hexdigest()
                    size = number("x-payload-length") if revisit else len(body)
                    refers = number("x-refers-to-page-id")
                    rows.append((uri, at, kind, number("x-page-id"), f.get("warc-target-uri"), size, digest, refers, body if with_payload else None))
                    at = after
                    if len(rows) >= 1000 or (with_payload and sum(len(r[-1]) for r in rows) > 8 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                source.file.close()

    return run


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """All records of gzipped archives given as (uri, n_bytes).

    A file is cut into byte ranges.  A task looks for the gzip magic from the start of its range,
    takes a candidate only if it decodes to a WARC header, reads on member by member, and owns
    the records that start inside its range, wherever they end.  Damaged members are passed over.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.filter("n_bytes > 0").select("uri", "n_bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("uri", "start", F.least(F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "uri", "start").mapInArrow(_read(with_payload), _RECORD)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, n_bytes) of the archives in a folder that this library did not write."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("uri"), F.col("length").alias("n_bytes"))
