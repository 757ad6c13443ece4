"""Token ids as binary files with Elias-Fano document boundaries."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import with_running_sums
from ._shared import shared_folder, stored
from .elias_fano import EliasFano, encode
from .files import create, new_file, open_for_reading
from .tokens import encoder

MAGIC = b"PTLOOM01"
_TAIL = "<QQQQB7x8s"  # documents, null ids, bytes of ids, bytes of the index, width of an id, magic
#: Documents whose boundaries are selected together.
_BLOCK = 4096
_MANIFEST = "shard int, uri string, n_docs bigint, n_tokens bigint, n_bytes bigint"


class TokenFile:
    """One file: ids side by side, then the coded boundaries and document ids, then a tail of fixed size.

    Boundaries and document ids never decrease, so both are Elias-Fano coded; ``bounds[i]`` and
    ``bounds[i + 1]`` frame document i without a table of 64-bit offsets.
    """

    def __init__(self, uri: str):
        self.file = open_for_reading(uri)
        size = self.file.size()
        tail = struct.unpack(_TAIL, self._read(size - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
        self.n_docs, self.n_null, self.id_bytes, index, self.width, magic = tail
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        data = self._read(self.id_bytes, index)
        self.bounds = EliasFano(data)
        self.doc_ids = EliasFano(data[self.bounds.size :])
        self.shift = struct.unpack("<q", data[-8:])[0]

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number ``first`` to ``last`` (exclusive) of the file, as 32-bit integers."""
        kind = "<u2" if self.width == 2 else "<u4"
        return np.frombuffer(self._read(first * self.width, (last - first) * self.width), kind).astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])

    def close(self) -> None:
        self.file.close()


def _write(path: str, end_id: int, folder: str):
    def run(batches):
        encode_texts, out = encoder(path), None
        kind = "<u2" if max(encode_texts.size, end_id + 1) <= 1 << 16 else "<u4"
        sizes, docs, n_null = [], [], 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                uri = new_file(folder, ".tok")
                out = create(uri)
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            n_null += sum(i is None for i in ids)
            docs.append(np.array([i for i in ids if i is not None], np.int64))
            for at in range(0, len(texts), 1000):
                packed = [p + end for p in encode_texts(texts[at : at + 1000])]
                sizes.append(np.array([len(p) // 4 for p in packed], np.int64))
                out.write(np.frombuffer(b"".join(packed), "<u4").astype(kind).tobytes())
        if out is None:
            return
        bounds = np.cumsum(np.concatenate([[0], *sizes]))
        known = np.concatenate(docs)
        shift = int(known[0]) if len(known) else 0
        index = encode(bounds) + encode((known - shift).astype(np.uint64)) + struct.pack("<q", shift)
        width = 2 if kind == "<u2" else 4
        out.write(index + struct.pack(_TAIL, len(bounds) - 1, n_null, int(bounds[-1]) * width, len(index), width, MAGIC))
        n_bytes = out.tell()
        out.close()
        row = [TaskContext.get().partitionId(), uri, len(bounds) - 1, int(bounds[-1]), n_bytes]
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["shard", "uri", "n_docs", "n_tokens", "n_bytes"])

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 64 << 20
) -> DataFrame:
    """Encode all documents, write them in ascending id order and return the manifest.

    The rows are range-partitioned by id (and the text's hash, so that rows without an id
    spread too); each task streams one file.  A file counts only if the stored manifest names
    it, so attempts that were lost leave nothing behind that is read.  Manifest: shard (order of
    the files), uri, n_docs, n_tokens, n_bytes, first (tokens in all files before it).

    Null text is the empty document (its end id alone); rows without an id come last; rows that
    share an id stay separate and come in the order of the text's hash.  An empty table gives
    an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    folder = folder or shared_folder(spark, "tokens")
    manifest = stored(dealt.mapInArrow(_write(tokenizer, end_id, folder), _MANIFEST), "manifest")
    whole = with_running_sums(manifest.withColumn("all", F.lit(0)), ["all"], ["shard"], {"last": F.col("n_tokens")}).drop("all")
    return whole.withColumn("first", F.col("last") - F.col("n_tokens")).drop("last")


def _read(with_ids: bool, most: int = 1 << 20):
    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist()):
                f = TokenFile(uri)
                at = 0
                while at < f.n_docs:  # some documents at a time: at most ``most`` ids, or one document
                    frame = f.bounds.block(at, at + _BLOCK + 1).astype(np.int64)
                    n = max(1, int(np.searchsorted(frame, frame[0] + most, "right")) - 1)
                    frame = frame[: n + 1]
                    end = at + len(frame) - 1
                    known = [int(x) + f.shift for x in f.doc_ids.block(at, end)]
                    ids = f.ids(int(frame[0]), int(frame[-1]))
                    cut = [ids[a:b] for a, b in zip(frame[:-1] - frame[0], frame[1:] - frame[0])]
                    columns = [
                        pa.array(known + [None] * (end - at - len(known)), pa.int64()),
                        pa.array(frame[:-1] + first),
                        pa.array(np.diff(frame)),
                        pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                        pa.array([c.tolist() for c in cut] if with_ids else [None] * len(cut), pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    at = end
                f.close()

    return run


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and ids if asked for."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("uri", "first").repartition(parts, "uri")
    return files.mapInArrow(_read(with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>")
