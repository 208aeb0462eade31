"""A sink of single files: every row becomes a file that is either whole or not there.

A task writes each file under a name of its attempt in ``_staging`` and then moves it to its
own name, which replaces what is there. So a task that fails leaves no part of a
file in sight, its second attempt writes the same names again, and attempts that run side
by side don't mix. The driver removes the staging folder at the job's end, be it
good or bad. Paths can be of any store that Arrow opens.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path within it; Spark writes local addresses with one slash."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.staging = path.rstrip("/"), names, f"_staging/{uuid.uuid4().hex}"

    def _staged(self) -> str:
        return f"{opened(self.path)[1]}/{self.staging}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        fs, top = opened(self.path)
        context = TaskContext.get()
        own = f"{self._staged()}/{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}" if context else f"{self._staged()}/{uuid.uuid4().hex}"
        fs.create_dir(own)
        for n, row in enumerate(rows):
            values = dict(zip(self.names, row, strict=True))
            name = values["name"]
            if not name or "/" in name or "\\" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name of a file: {name!r}")
            part = f"{own}/{n}"
            with fs.open_output_stream(part) as out:
                if values.get("content") is not None:
                    out.write(values["content"])
                else:
                    source, at = opened(values["source"])
                    with source.open_input_stream(at) as given:
                        while piece := given.read(BLOCK):
                            out.write(piece)
            fs.move(part, f"{top}/{name}")
        fs.delete_dir(own)
        return WriterCommitMessage()

    def _clear(self) -> None:
        fs, top = opened(self.path)
        fs.delete_dir_contents(f"{top}/{self.staging}", missing_dir_ok=True)
        fs.delete_dir_contents(f"{top}/_staging", missing_dir_ok=True) if not _others(fs, f"{top}/_staging") else None

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


def _others(fs: pafs.FileSystem, path: str) -> bool:
    """Are there files of another job that is still writing?"""
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return any(f.type == pafs.FileType.File for f in found)


class FileSink(DataSource):
    """Format ``single_files``: rows of name and content, or of name and source (the path of a file to copy)."""

    @classmethod
    def name(cls) -> str:
        return "single_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one: use mode append")
        if "name" not in schema.names or not {"content", "source"} & set(schema.names):
            raise ValueError("rows need a name, and content or a source")
        return FileWriter(self.options["path"], schema.names)


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (name, content) or (name, source) as files of the folder ``path``."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.write.format("single_files").mode("append").option("path", path).save()
