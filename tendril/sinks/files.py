"""Reports as single files and records as files of their own, by Spark's Python data source writers.

`one_file` writes a sorted table as one CSV file: every task writes its rows to a part beside the target, and the commit
joins the parts in the order of the partitions, byte order mark and header once, into a file that takes the target's name
in one step. A task or job that fails leaves no target, and the abort takes the parts away. `file_per_row` writes each row
as a file of its own and never over one that is there: a person may have begun to fill it.

Paths are those of a file system that all executors and the driver see, a URI or a plain path.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: What spreadsheets in Spanish open with accents and columns right.
BOM, SEPARATOR, LINE_END = "﻿", ";", "\r\n"
CHUNK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its partition, and its files as (staged, target), or the one staged part."""

    partition: int
    files: list[tuple[str, str]]


class _Staged(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.staging = path, overwrite, f"{path}.parts-{uuid.uuid4().hex}"
        # made here, on the driver: a task that outlives the abort finds no folder to write into
        system, staging = located(self.staging)
        system.create_dir(staging, recursive=True)

    def _clear(self) -> None:
        system, staging = located(self.staging)
        if exists(system, staging):
            system.delete_dir(staging)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _partition(self) -> tuple[int, str]:
        """The partition, and a name of this attempt alone: a task that is run twice writes two parts, of which one is committed."""
        task = TaskContext.get()
        return task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}"


class _OneFile(_Staged):
    def __init__(self, path: str, overwrite: bool, columns: list[str]) -> None:
        super().__init__(path, overwrite)
        self.columns = columns

    def write(self, rows: Iterator) -> Part:
        number, name = self._partition()
        system, staging = located(self.staging)
        with system.open_output_stream(f"{staging}/{name}") as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as out:
            writer = csv.writer(out, delimiter=SEPARATOR, lineterminator=LINE_END)
            writer.writerows(["" if v is None else v for v in row] for row in rows)
        return Part(number, [(f"{staging}/{name}", "")])

    def commit(self, messages: list[Part | None]) -> None:
        system, target = located(self.path)
        if exists(system, target) and not self.overwrite:
            self._clear()
            raise FileExistsError(f"{self.path} is there already")
        _, staging = located(self.staging)
        whole = f"{staging}/whole"
        with system.open_output_stream(whole) as out:
            head = io.StringIO()
            csv.writer(head, delimiter=SEPARATOR, lineterminator=LINE_END).writerow(self.columns)
            out.write((BOM + head.getvalue()).encode())
            for part in sorted(filter(None, messages), key=lambda m: m.partition):
                with system.open_input_stream(part.files[0][0]) as read:
                    while block := read.read(CHUNK):
                        out.write(block)
        system.move(whole, target)
        self._clear()


class _FilePerRow(_Staged):
    def write(self, rows: Iterator) -> Part:
        number, attempt = self._partition()
        system, staging = located(self.staging)
        _, folder = located(self.path)
        system.create_dir(f"{staging}/{attempt}", recursive=False)
        files = []
        for name, content in rows:
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no name of a file")
            with system.open_output_stream(f"{staging}/{attempt}/{name}") as out:
                out.write((content or "").encode())
            files.append((f"{staging}/{attempt}/{name}", f"{folder}/{name}"))
        return Part(number, files)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = located(self.path)
        files = [f for m in messages if m for f in m.files]
        there = sorted(_clashes(system, files))
        if there and not self.overwrite:
            self._clear()
            raise FileExistsError(f"{len(there)} files are there already, or twice: {', '.join(there[:5])}")
        system.create_dir(folder, recursive=True)
        for staged, target in files:
            system.move(staged, target)
        self._clear()


def _clashes(system: fs.FileSystem, files: Sequence[tuple[str, str]]) -> set[str]:
    """Targets that are there, or that two rows name."""
    seen: set[str] = set()
    clash = set()
    for _, target in files:
        if target in seen or exists(system, target):
            clash.add(target)
        seen.add(target)
    return clash


class ReportFile(DataSource):
    """Format `report_file`: one CSV file of the rows in their order."""

    @classmethod
    def name(cls) -> str:
        return "report_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _OneFile(self.options["path"], overwrite, schema.names)


class RecordFiles(DataSource):
    """Format `record_files`: a file for each row (name, content) in a folder."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["name", "content"]:
            raise ValueError("rows of record_files are (name, content)")
        return _FilePerRow(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (ReportFile, RecordFiles):
        spark.dataSource.register(source)


def one_file(df: DataFrame, path: str, order: Sequence = (), overwrite: bool = True) -> None:
    """The rows, in order, as one CSV file. Values are written as they come: format them before (null is empty)."""
    register(df.sparkSession)
    sorted_ = df.orderBy(*order) if order else df
    sorted_.write.format("report_file").mode("overwrite" if overwrite else "append").save(path)


def file_per_row(df: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of a folder; an error, and none written, if one of them is there."""
    register(df.sparkSession)
    df.select("name", "content").write.format("record_files").mode("append").save(folder)
