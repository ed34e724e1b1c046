"""Listings: all files and folders below a path, empty ones too, in batches and as a stream of changes; members of archives."""

from __future__ import annotations

import io
import os
import re
import tarfile
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.functions import udtf

from ..operators.tables import save

SCHEMA = "path string, is_folder boolean, bytes long, modified_ns long"
COLUMNS = ("path", "is_folder", "bytes", "modified_ns")
#: Entries of one folder that one task looks at; folders with more are shared by several tasks.
SLICE = 10_000
#: Folders that planning goes into before it leaves the rest to tasks.
PLANNED = 256


def local(path: str) -> str:
    return re.sub("^file:/*", "/", path).rstrip("/") or "/"


class Test:
    """Filters on a row of a listing, those that can be decided from the row alone; see pushed()."""

    KINDS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringEndsWith: str.endswith, StringStartsWith: str.startswith}

    def __init__(self, filters: list[Filter] = ()):
        self.filters = [(COLUMNS.index(f.attribute[0]), type(f), f.value) for f in filters]

    @classmethod
    def takes(cls, f: Filter) -> bool:
        return type(f) in cls.KINDS and len(f.attribute) == 1 and f.attribute[0] in COLUMNS

    def __call__(self, row: tuple) -> bool:
        return all(self.KINDS[kind](row[at], value) for at, kind, value in self.filters)

    def by_name(self, path: str) -> bool:
        """Whether a row of this path can hold, before its size and time are known."""
        return all(self.KINDS[kind](path, value) for at, kind, value in self.filters if at == 0)


@dataclass
class Folder(InputPartition):
    """A folder to list: all below it, or of its own entries those whose names fall to this part."""

    path: str
    deep: bool
    part: int = 0
    parts: int = 1


def row_of(path: str, is_folder: bool) -> tuple | None:
    """A row of the listing; None for what has gone meanwhile."""
    try:
        s = os.stat(path) if is_folder else os.lstat(path)
    except FileNotFoundError:
        return None
    return path, is_folder, 0 if is_folder else s.st_size, s.st_mtime_ns


def entries(path: str) -> list[tuple[str, bool]]:
    """(path, is_folder) of what lies in a folder, without its size and time, which cost a call each; links are files."""
    try:
        with os.scandir(path) as found:
            return sorted((e.path, e.is_dir(follow_symlinks=False)) for e in found)
    except FileNotFoundError:
        return []


def rows_below(folder: Folder, test: Test) -> Iterator[tuple]:
    """The rows of a partition that hold: the folder itself comes with its first part."""
    if folder.part == 0 and test.by_name(folder.path) and (row := row_of(folder.path, True)) and test(row):
        yield row
    for path, is_folder in entries(folder.path):
        if is_folder:
            if folder.deep:
                yield from rows_below(Folder(path, True), test)
        elif test.by_name(path) and zlib.crc32(os.fsencode(path)) % folder.parts == folder.part and (row := row_of(path, False)) and test(row):
            yield row


def planned(root: str) -> list[Folder]:
    """Tasks for all below the root: folders are gone into level by level until there are PLANNED, those with many entries
    are cut into parts, and what is left is listed by tasks with all that is below it."""
    out, level, n = [], [root], 0
    while level and n < PLANNED:
        below = []
        for path in level:
            found = entries(path)
            parts = max(1, -(-sum(not d for _, d in found) // SLICE))
            out += [Folder(path, False, k, parts) for k in range(parts)]
            below += [p for p, d in found if d]
        n, level = n + len(level), below
    return out + [Folder(p, True) for p in level]


class ListingReader(DataSourceReader):
    """Filters on suffix, prefix, size, time and kind are decided before rows leave a task, names before a file is looked at."""

    def __init__(self, options):
        self.root, self.test = local(options["path"]), Test()

    def pushFilters(self, filters):  # noqa: N802
        self.test = Test([f for f in filters if Test.takes(f)])
        return [f for f in filters if not Test.takes(f)]

    def partitions(self):
        return planned(self.root)

    def read(self, partition):
        return rows_below(partition, self.test)


@dataclass
class Between(InputPartition):
    folder: Folder
    start: int
    end: int


class ChangesReader(DataSourceStreamReader):
    """Files and folders as they change: a row whenever one has been made, written, renamed or moved in since the last batch.

    The offset is a time in nanoseconds; a batch has what changed after its start and up to its end, by the clock of the
    file system. What changes while a batch is read has a later time and comes with the next one. What is deleted is not
    told. With option `since` the stream begins there, else with all that is there.
    """

    def __init__(self, options):
        self.root, self.since = local(options["path"]), int(options.get("since", "0"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed_ns": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed_ns": time.time_ns()}

    def partitions(self, start: dict, end: dict):
        return [Between(f, start["changed_ns"], end["changed_ns"]) for f in planned(self.root)]

    def read(self, partition):
        for row in rows_below(partition.folder, Test()):
            try:
                s = os.lstat(row[0])
            except FileNotFoundError:
                continue
            if partition.start < max(s.st_mtime_ns, s.st_ctime_ns) <= partition.end:
                yield row

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    """format("listing").load(path): unlike binaryFile it has files of 0 bytes and folders without files."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return ChangesReader(self.options)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of all below a path that every executor mounts, the path itself first; nothing for one that is not there.
    Which filters a query pushes into it is seen in its plan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").load(path)


def changes(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The same as a stream of what has changed; see ChangesReader."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").option("since", str(since)).load(path)


def explored(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """SCHEMA of all below the folders in `roots` (path), for trees too large for one plan: folders are opened by the
    executors, a Spark job a level, and the names found are dealt evenly before sizes and times are asked for, so that a
    folder that holds nearly all files is no task's alone. Repeated and nested roots count once."""

    def opened(it):
        for b in it:
            for top in b.column(0).to_pylist():
                found = entries(top)
                for at in range(0, len(found), SLICE):
                    part = found[at : at + SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([d for _, d in part], pa.bool_())], names=["path", "is_folder"])

    def measured(it):
        for b in it:
            rows = [r for p, d in zip(*(c.to_pylist() for c in b.columns), strict=True) if (r := row_of(p, d))]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=list(COLUMNS))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "(?<=.)/+$", "")
    level = save(roots.where("path IS NOT NULL").select(clean.alias("path"), F.lit(True).alias("is_folder")).distinct(), "level")
    names = level
    while not level.isEmpty():
        folders = level.where("is_folder").select("path").repartition(tasks, "path")
        level = save(folders.mapInArrow(opened, "path string, is_folder boolean").join(names.where("is_folder"), ["path", "is_folder"], "left_anti"), "level")
        names = names.unionAll(level)
    return names.distinct().repartition(tasks, F.xxhash64("path")).mapInArrow(measured, SCHEMA)


@udtf(returnType="member string, bytes long, is_folder boolean, error string")
class ArchiveMembers:
    """Members of a zip or tar archive given as bytes; an archive that cannot be read is one row with the error."""

    def eval(self, content: bytes):
        try:
            data = io.BytesIO(content)
            if zipfile.is_zipfile(data):
                with zipfile.ZipFile(data) as z:
                    for i in z.infolist():
                        yield i.filename, i.file_size, i.is_dir(), None
            else:
                data.seek(0)
                with tarfile.open(fileobj=data) as t:
                    for m in t:
                        yield m.name, m.size, m.isdir(), None
        except (OSError, tarfile.TarError, zipfile.BadZipFile) as e:
            yield None, None, None, type(e).__name__
