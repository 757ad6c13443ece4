"""Data source ``pointclouds``: the sweeps of a dataset folder as one table of points.

``spark.read.format("pointclouds").option("layout", "kitti").load(root)`` after
``register(spark)``.  Filters on ``seq`` and ``frame`` choose files before any is opened;
large files are read in ranges of points by several tasks, small ones share a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import pcd
from .store import listed, located

SCHEMA = "path string, point_id long, x float, y float, z float, seq int, frame int"
_ARROW = pa.schema([("path", pa.string()), ("point_id", pa.int64()), *((c, pa.float32()) for c in "xyz"), ("seq", pa.int32()), ("frame", pa.int32())])
#: Bytes of one range, and of the small files that one task reads.
SPLIT_BYTES = 32 << 20
#: Points of one batch.
BATCH = 1 << 18
_RECORD = 16  # four float32


@dataclass(frozen=True)
class Layout:
    """Where a dataset keeps its sweeps: a pattern of the path below the root with sequence and frame."""

    pattern: str
    sequence: Callable[[str], int | None]


def layouts() -> dict[str, Layout]:
    from .datasets import SESSIONS

    at = {s: i for i, s in enumerate(SESSIONS)}
    return {
        "kitti": Layout(r"(\d+)/velodyne/(\d+)\.bin", int),
        "kitti360": Layout(r"data_3d_raw/[^/]*drive_(\d+)_sync/velodyne_points/data/(\d+)\.bin", int),
        "apollo": Layout(r"([^/]+Data/.+/)pcds/(\d+)\.pcd", at.get),
        "hit_ms": Layout(r"(\d+)/pcd/(\d+)\.pcd", int),
    }


@dataclass(frozen=True)
class Span:
    """Bytes ``start`` to ``stop`` of a file; whole files have ``stop`` = size."""

    path: str
    seq: int
    frame: int
    start: int
    stop: int
    size: int


class Spans(InputPartition):
    def __init__(self, spans: list[Span]):
        super().__init__(spans)
        self.spans = spans


_TESTS = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}


def _holds(kind: str, have: int, want) -> bool:
    if kind == "in":
        return have in want
    return {"eq": have == want, "gt": have > want, "ge": have >= want, "lt": have < want, "le": have <= want}[kind]


class CloudReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        name = options.get("layout", "kitti").lower()
        if name not in layouts():
            raise ValueError(f"unknown layout {name!r}; known: {sorted(layouts())}")
        self.layout = name
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take comparisons of ``seq`` and ``frame`` with values; return all others."""
        for f in filters:
            kind = _TESTS.get(type(f))
            if kind is None or f.attribute not in (("seq",), ("frame",)) or f.value is None:
                yield f
            else:
                self.tests.append((f.attribute[0], kind, f.value))

    def files(self) -> list[Span]:
        """Sweeps that pass the pushed filters, from the listing alone."""
        layout = layouts()[self.layout]
        shape, out = re.compile("/" + layout.pattern + "$"), []
        base = located(self.root)[1].rstrip("/")
        for path, size in listed(self.root):
            match = shape.match(path[len(base) :])
            seq = layout.sequence(match[1]) if match else None
            if seq is None:
                continue
            frame = int(match[2])
            if all(_holds(kind, seq if name == "seq" else frame, want) for name, kind, want in self.tests):
                out.append(Span(path, seq, frame, 0, size, size))
        return out

    def partitions(self) -> list[Spans]:
        parts, some, filled = [], [], 0
        for f in self.files():
            if f.size > self.split:
                step = self.split // _RECORD * _RECORD or _RECORD
                parts += [Spans([Span(f.path, f.seq, f.frame, a, min(a + step, f.size), f.size)]) for a in range(0, f.size, step)]
                continue
            if some and filled + f.size > self.split:
                parts.append(Spans(some))
                some, filled = [], 0
            some.append(f)
            filled += f.size
        if some:
            parts.append(Spans(some))
        return parts or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        fs = located(self.root)[0]
        for span in partition.spans:
            with fs.open_input_file(span.path) as f:
                first, xyz = _points(f, span)
            for i in range(0, len(xyz), BATCH):
                part = np.ascontiguousarray(xyz[i : i + BATCH].T)
                n = part.shape[1]
                constant = [pa.array(np.full(n, v, np.int32)) for v in (span.seq, span.frame)]
                yield pa.record_batch([pa.array([span.path] * n), pa.array(np.arange(first + i, first + i + n)), *(pa.array(c) for c in part), *constant], schema=_ARROW)


def _points(f, span: Span) -> tuple[int, np.ndarray]:
    """Number of the first point and the points that start in the span."""
    if span.path.endswith(".bin"):
        raw = np.frombuffer(f.read_at((span.stop - span.start) // _RECORD * _RECORD, span.start), "<f4")
        return span.start // _RECORD, raw.reshape(-1, 4)[:, :3]
    head = pcd.parse_head(f.read_at(min(span.size, pcd.HEAD_BYTES), 0))
    if head.kind != "binary":  # text and compressed bodies have no known places: the first range reads the file
        if span.start:
            return 0, np.empty((0, 3), np.float32)
        return 0, pcd.parse_body(head, f.read_at(span.size - head.body, head.body))
    width = head.dtype.itemsize
    first, last = (min(head.points, max(0, -(-(b - head.body) // width))) for b in (span.start, span.stop))
    return first, pcd.parse_body(head, f.read_at((last - first) * width, head.body + first * width))


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointclouds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CloudReader:
        return CloudReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CloudSource)


def read_clouds(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Points of all sweeps of a dataset folder: path, point_id, x, y, z, seq, frame."""
    register(spark)
    return spark.read.format("pointclouds").option("layout", layout).load(root)
