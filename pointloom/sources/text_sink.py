"""Data source ``textparts``: named text files, written whole or not at all.

Rows are ``file`` (a relative name) and ``value`` (a line).  Tasks write into a new folder
beside the target; only when all of them are done does the driver put that folder in its
place.  A failed job leaves the old output as it was, and what lost or repeated attempts
wrote is not taken over.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .store import located


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: written name and final name."""

    files: list[tuple[str, str]]


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        self.staging = f"{self.target}.__new-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, staging = located(self.staging)
        task = TaskContext.get()
        files, name, out = [], None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                names = batch.column("file")
                runs = pc.run_end_encode(names)
                ends, at = runs.run_ends.to_pylist(), 0
                for file, end in zip(runs.values.to_pylist(), ends):
                    if file != name:
                        if out is not None:
                            out.close()
                        name = file
                        at_place = f"{file}/part-{task.partitionId():05d}"
                        mine = f"{staging}/_attempts/{task.taskAttemptId()}/{at_place}-{len(files)}"
                        fs.create_dir(mine.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(mine)
                        files.append((mine, f"{at_place}-{len(files):05d}"))
                    lines = batch.column("value").slice(at, end - at).to_pylist()
                    out.write(("\n".join("" if x is None else x for x in lines) + "\n").encode())
                    at = end
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Place the files of the attempts that count, then the folder."""
        fs, staging = located(self.staging)
        target = located(self.target)[1]
        there = fs.get_file_info(target).type != pafs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.target} exists: write with mode overwrite")
        whole = f"{staging}/whole"
        fs.create_dir(whole, recursive=True)
        for m in messages:
            for mine, name in m.files if m is not None else ():
                fs.create_dir(f"{whole}/{name}".rsplit("/", 1)[0], recursive=True)
                fs.move(mine, f"{whole}/{name}")
        with fs.open_output_stream(f"{whole}/_SUCCESS"):
            pass
        if there:
            fs.move(target, f"{staging}/old")
        fs.move(whole, target)
        fs.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = located(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class PartsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textparts"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], overwrite)


def write_parts(lines: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Write ``file``, ``value`` rows, in their order within each task, below ``folder``.

    A file is a folder of parts: its parts in the order of their names are its text.
    """
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(PartsSink)
    lines.select("file", "value").write.format("textparts").mode("overwrite" if overwrite else "append").save(folder)
