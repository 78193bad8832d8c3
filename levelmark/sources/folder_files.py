"""Data source that lists the files of a folder, empty ones included, in parallel.

A partition lists one folder: near the root only its own files, further down all
that is below it. Nothing but names, lengths and times is read, and no list of
paths passes through the driver.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, modificationTime timestamp"
#: Folders that are opened from the root down before each of the rest goes to a task.
SPREAD = 64
#: Files of one output batch.
BATCH = 10_000


def opened(folder: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what goes before its paths. A path without a
    scheme, or one of `file:`, is taken as it is, as Spark takes it."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), folder, "file:"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(folder)
    return system, path, folder.removesuffix("/")[: len(folder.removesuffix("/")) - len(path)]


def is_folder(path: str) -> bool:
    system, inner, _ = opened(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def hidden(name: str) -> bool:
    """Names that Spark's own file sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return [f for f in system.get_file_info(fs.FileSelector(folder)) if not hidden(f.base_name)]


@dataclass
class Folder(InputPartition):
    path: str
    below: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.pattern = options.get("pattern", "*")
        self.below = options.get("recursive", "true").lower() == "true"

    def partitions(self) -> list[Folder]:
        system, root, _ = opened(self.folder)
        ready, waiting = [], [root]
        while self.below and 0 < len(waiting) < SPREAD:
            ready += waiting
            waiting = [f.path for folder in waiting for f in entries(system, folder) if f.type == fs.FileType.Directory]
        if not self.below:
            ready, waiting = waiting, []
        return [Folder(path, False) for path in ready] + [Folder(path, True) for path in waiting]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.folder)
        folders, rows = [partition.path], []
        while folders:
            for entry in entries(system, folders.pop()):
                if entry.type == fs.FileType.Directory:
                    if partition.below:
                        folders.append(entry.path)
                elif fnmatchcase(entry.base_name, self.pattern):
                    rows.append((before + entry.path, entry.size, entry.mtime_ns // 1000))
                if len(rows) >= BATCH:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        paths, sizes, times = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))]
        return pa.RecordBatch.from_arrays(columns, ["path", "length", "modificationTime"])


class FolderFiles(DataSource):
    """Options: `path` (a folder), `pattern` (of file names), `recursive`."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def folder_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    spark.dataSource.register(FolderFiles)
    return spark.read.format(FolderFiles.name()).option("pattern", pattern).option("recursive", str(recursive)).load(folder)
