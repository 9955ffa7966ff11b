"""Data sources that Spark's own readers and writers lack: growing logs, folders with empty files, a log with one header.

Register them once a session with ``register(spark)``.  Paths are local or
mounted paths, or addresses that pyarrow knows; driver and executors must
both reach them.
"""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else f"file://{os.path.abspath(path)}")


def _listed(fs: files.FileSystem, folder: str, recursive: bool) -> list[files.FileInfo]:
    return fs.get_file_info(files.FileSelector(folder, allow_not_found=True, recursive=recursive))


# Growing logs


@dataclass
class Block(InputPartition):
    file: str
    first: int
    begin: int
    end: int


class GrowingLogs(DataSource):
    """A stream of the lines (file, position, line) of text files that grow; ``position`` is the byte at which a line begins.

    Options: ``path`` (a folder), ``suffix`` (".csv"), ``blockBytes`` (64 MB).
    An offset says for each file how many bytes were read; it is kept in the
    checkpoint, so a batch that was lost is read again from the same bytes and
    none is passed over.  A line is taken once its end is written.  A file that
    is shorter than what was read of it was begun anew and is read from its
    start; files that vanish are passed over.  Empty lines come as empty
    strings, bytes that are no UTF-8 are replaced.  What was added to a file is
    read in blocks, each a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "file string, position long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingLogsReader(self.options)


class GrowingLogsReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".csv")
        self.block = int(options.get("blockBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = opened(self.path)
        found = [f for f in _listed(fs, root, True) if f.is_file and f.path.endswith(self.suffix)]
        return {f.path: _last_line_end(fs, f.path, f.size) for f in sorted(found, key=lambda f: f.path)}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        blocks = []
        for name, stop in end.items():
            first = start.get(name, 0)
            first = first if first <= stop else 0
            blocks += [Block(name, first, at, min(at + self.block, stop)) for at in range(first, stop, self.block)]
        return blocks

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        with fs.open_input_file(block.file) as raw, io.BufferedReader(raw, 1 << 20) as stream:
            yield from _batches(block, _owned_lines(stream, block))

    def commit(self, end: dict) -> None:
        """Files stay as they are."""


def _last_line_end(fs: files.FileSystem, path: str, size: int, step: int = 1 << 16) -> int:
    """The number of bytes up to the last line feed; looked for from the end."""
    with fs.open_input_file(path) as f:
        while size > 0:
            begin = max(0, size - step)
            at = f.read_at(size - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


def _owned_lines(stream: io.BufferedReader, block: Block) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a block; one that began before it belongs to the block before."""
    at = block.begin
    if at > block.first:
        stream.seek(at - 1)
        at += len(stream.readline()) - 1
    else:
        stream.seek(at)
    while at < block.end:
        line = stream.readline()
        if not line:
            return
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def _batches(block: Block, lines: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    places, texts, size = [], [], 0
    for at, line in lines:
        places.append(at)
        texts.append(line.decode("utf-8", "replace"))
        size += len(line)
        if len(places) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(block.file, places, texts)
            places, texts, size = [], [], 0
    if places:
        yield _batch(block.file, places, texts)


def _batch(file: str, places: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["file", "position", "line"])


# Folders


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


class FileListing(DataSource):
    """(path, stem, folder, length) of the files below a folder, those without a byte too; contents are not read.

    Options: ``path``, ``suffixes`` (comma-separated, in any case; all files if
    none), ``depth`` (2).  Each folder down to that depth is listed by a task of
    its own, and the last ones with all below them.  Hidden files are listed; a
    folder that is not there has no files.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, stem string, folder string, length long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileListingReader(self.options)


class FileListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.depth = options["path"], int(options.get("depth", 2))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())

    def partitions(self) -> list[Folder]:
        fs, root = opened(self.path)
        level, found = [root], []
        for _ in range(self.depth):
            found += [Folder(p, False) for p in level]
            level = [f.path for p in level for f in _listed(fs, p, False) if f.type == files.FileType.Directory]
        return found + [Folder(p, True) for p in level]

    def read(self, part: Folder) -> Iterator[tuple[str, str, str, int]]:
        fs, _ = opened(self.path)
        for f in _listed(fs, part.path, part.recursive):
            if f.is_file and (not self.suffixes or f.base_name.lower().endswith(self.suffixes)):
                yield f.path, os.path.splitext(f.base_name)[0], os.path.basename(os.path.dirname(f.path)), f.size


# Logs with one header


@dataclass
class Written(WriterCommitMessage):
    staging: str
    name: str


class HeadedLog(DataSource):
    """A log of CSV lines with one header: its files, put together in order of their names, are one CSV file.

    Option: ``path`` (a folder).  Each write or streaming batch becomes a
    numbered folder, put in place by one rename once all its tasks are done, so
    a log shows whole writes only; what a failed write left is removed.  The
    header is a file of its own and is written once.  Mode "append" goes on with
    a log, "overwrite" begins it anew.  A streaming batch that was written before
    is not written again.  One writer at a time.  Nulls are empty fields, times
    have whole seconds.
    """

    @classmethod
    def name(cls) -> str:
        return "headed_log"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return HeadedLogWriter(self.options["path"], schema.names, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return HeadedLogStreamWriter(self.options["path"], schema.names, overwrite)


def _text(value: object) -> object:
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S")
    return value.isoformat() if isinstance(value, date) else value


class _Log:
    """What batch and streaming writes share."""

    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = path, names, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, root = opened(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.csv"
        fs.create_dir(f"{root}/{self.staging}")
        with fs.open_output_stream(f"{root}/{self.staging}/{name}") as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as out:
            w = csv.writer(out, lineterminator="\n")
            for row in rows:
                w.writerow([_text(v) for v in row])
        return Written(self.staging, name)

    def publish(self, messages: list[Written | None], number: int | None) -> None:
        """Put what the tasks wrote in place; Spark may commit with another copy of the writer than wrote."""
        fs, root = opened(self.path)
        done = [m for m in messages if m is not None]
        self.staging = done[0].staging if done else self.staging
        fs.create_dir(f"{root}/{self.staging}")
        old = sorted(f.path for f in _listed(fs, root, False) if re.fullmatch(r"[0-9]{10}", f.base_name))
        last = int(os.path.basename(old[-1])) if old else 0
        place = f"{root}/{(last if number is None else number) + 1:010d}"
        if number is not None and place in old:
            self.discard()
            return
        wanted = {m.name for m in done}
        for f in _listed(fs, f"{root}/{self.staging}", False):
            if f.base_name not in wanted:  # of a task that was run twice
                fs.delete_file(f.path)
        if self.overwrite and number is None:
            for p in old:
                fs.delete_dir(p)
        head = f"{root}/{0:010d}"
        if fs.get_file_info(f"{head}/header.csv").type == files.FileType.NotFound:
            fs.create_dir(head)
            with fs.open_output_stream(f"{head}/header.csv") as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as out:
                csv.writer(out, lineterminator="\n").writerow(self.names)
        fs.move(f"{root}/{self.staging}", place)
        self.discard()

    def discard(self) -> None:
        """Remove what was not put in place, of earlier writes that were lost too."""
        fs, root = opened(self.path)
        for f in _listed(fs, root, False):
            if f.base_name.startswith("_staging-"):
                fs.delete_dir(f.path)


class HeadedLogWriter(_Log, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self.discard()


class HeadedLogStreamWriter(_Log, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.discard()


def register(spark: SparkSession) -> SparkSession:
    for source in (GrowingLogs, FileListing, HeadedLog):
        spark.dataSource.register(source)
    return spark
