"""Published tables: written by many tasks, made visible by one marker, in batches and in streams.

A part counts only if a manifest names it, so that a reader never sees half of a write. Tasks write parts under names of
their own and tell their row count, size and digest; the commit makes of these messages the manifest, put in place by one
move. A write that fails leaves the manifest as it was, and its parts are removed. Each batch of a stream has a manifest of
its own number, so that a batch that is written again after a failure counts once.

Paths may be on any file system that Arrow knows (local ones only if all executors mount them).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST, BATCHES, PARTS = "_manifest.json", "_batches", "parts"
PIECE = 1 << 20


class Folder:
    """A folder on one of Arrow's file systems."""

    def __init__(self, path: str):
        if "://" in path:
            self.fs, self.top = pa.fs.FileSystem.from_uri(path)
        else:
            self.fs, self.top = pa.fs.LocalFileSystem(), path.removeprefix("file:")
        self.top = self.top.rstrip("/")

    def names(self, below: str) -> list[str]:
        found = self.fs.get_file_info(pa.fs.FileSelector(f"{self.top}/{below}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file)

    def read(self, name: str) -> bytes | None:
        path = f"{self.top}/{name}"
        if not self.fs.get_file_info(path).is_file:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def put(self, name: str, data: bytes) -> None:
        """All of it or nothing: under another name first, then one move."""
        path = f"{self.top}/{name}"
        part = f"{path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, path)

    def delete(self, names) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.top}/{name}").is_file:
                self.fs.delete_file(f"{self.top}/{name}")


class Digesting:
    """A stream that is written through, with the digest and the number of its bytes."""

    def __init__(self, stream):
        self.stream, self.sha, self.size, self.closed = stream, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        data = bytes(data)
        self.sha.update(data)
        self.size += len(data)
        self.stream.write(data)
        return len(data)

    def writable(self) -> bool:
        return True

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.stream.close()


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote; name is None where it had no rows."""

    name: str | None
    rows: int
    bytes: int
    sha256: str


class Writing:
    """What batch and stream writers share. `kind` is parquet or csv."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.schema = options["path"], options.get("kind", "parquet"), schema
        if self.kind not in ("parquet", "csv"):
            raise ValueError(f"parts are parquet or csv, not {self.kind}")
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Part:
        """Runs in a task; a second attempt writes a part of its own, of which only one's message is committed."""
        folder, name, rows, sink, out = Folder(self.path), f"{self.job}-{uuid.uuid4().hex}.{self.kind}", 0, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                folder.fs.create_dir(f"{folder.top}/{PARTS}", recursive=True)
                sink = Digesting(folder.fs.open_output_stream(f"{folder.top}/{PARTS}/{name}"))
                file = pa.PythonFile(sink, mode="w")
                out = pa.parquet.ParquetWriter(file, batch.schema) if self.kind == "parquet" else pa.csv.CSVWriter(file, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Part(None, 0, 0, "")
        out.close()
        sink.close()
        return Part(name, rows, sink.size, sink.sha.hexdigest())

    def listed(self, messages: list[Part | None]) -> list[dict]:
        return sorted((vars(m) for m in messages if m is not None and m.name), key=lambda m: m["name"])

    def sealed(self, files: list[dict]) -> bytes:
        return (json.dumps({"kind": self.kind, "schema": self.schema.jsonValue(), "rows": sum(f["rows"] for f in files), "files": files}, sort_keys=True, indent=1) + "\n").encode()

    def take_back(self, messages) -> None:
        """Removes what these messages name and whatever else this writer's tasks have left."""
        folder = Folder(self.path)
        own = {n for n in folder.names(PARTS) if n.startswith(self.job)} if messages is None else {m.name for m in messages if m is not None and m.name}
        folder.delete(f"{PARTS}/{n}" for n in own)


class TableWriter(Writing, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        super().__init__(options, schema)
        self.overwrite = overwrite

    def commit(self, messages) -> None:
        folder = Folder(self.path)
        before = json.loads(folder.read(MANIFEST) or b"null")
        if before and not self.overwrite and (before["schema"] != self.schema.jsonValue() or before["kind"] != self.kind):
            raise ValueError("rows of another schema or kind are there already")
        kept = [] if self.overwrite or not before else before["files"]
        folder.put(MANIFEST, self.sealed(kept + self.listed(messages)))
        if self.overwrite and before:
            folder.delete(f"{PARTS}/{f['name']}" for f in before["files"])

    def abort(self, messages) -> None:
        self.take_back(None)


class BatchWriter(Writing, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId) -> None:  # noqa: N803
        folder, name = Folder(self.path), f"{BATCHES}/{batchId:012d}.json"
        if folder.read(name) is not None:
            self.take_back(messages)  # this batch counts already
        else:
            folder.put(name, self.sealed(self.listed(messages)))

    def abort(self, messages, batchId) -> None:  # noqa: N803
        self.take_back(messages)


def manifests(path: str) -> list[dict]:
    """The manifest of a table or those of a stream's batches, in order; none where nothing was ever committed."""
    folder = Folder(path)
    found = [folder.read(MANIFEST), *[folder.read(f"{BATCHES}/{n}") for n in folder.names(BATCHES) if n.endswith(".json")]]
    return [json.loads(f) for f in found if f is not None]


@dataclass
class Listed(InputPartition):
    name: str
    sha256: str


class TableReader(DataSourceReader):
    """A task for each part; one whose bytes are not those that its manifest names is an error."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.parts = [Listed(f["name"], f["sha256"]) for m in manifests(self.path) for f in m["files"]]
        self.schema = schema

    def partitions(self):
        return self.parts

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no parts at all
            return
        folder, sha = Folder(self.path), hashlib.sha256()
        name = f"{folder.top}/{PARTS}/{partition.name}"
        with folder.fs.open_input_stream(name) as f:
            while piece := f.read(PIECE):
                sha.update(piece)
        if sha.hexdigest() != partition.sha256:
            raise ValueError(f"{name} is not what its manifest names")
        want = to_arrow_schema(self.schema)
        with folder.fs.open_input_file(name) as f:
            if name.endswith(".csv"):
                options = pa.csv.ConvertOptions(column_types=want, strings_can_be_null=True, quoted_strings_can_be_null=False)
                batches = pa.csv.open_csv(f, convert_options=options)
            else:
                batches = pa.parquet.ParquetFile(f).iter_batches(4096)
            for b in batches:
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(b.columns, want, strict=True)], schema=want)


class PublishedSource(DataSource):
    """format("published"): append and overwrite of tables, streams in append mode, and reading of what was committed."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> StructType:
        found = manifests(self.options["path"])
        if not found:
            raise FileNotFoundError(f"nothing was committed at {self.options['path']}")
        return StructType.fromJson(found[-1]["schema"])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> BatchWriter:  # noqa: N802
        return BatchWriter(self.options, schema)


def publish_rows(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Writes df (flat columns for csv) as parts and then the manifest that makes them count."""
    df.sparkSession.dataSource.register(PublishedSource)
    df.write.format("published").option("kind", kind).mode(mode).save(path)


def publish_stream(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Publishes what a stream has now, batch by batch; a later call goes on from the checkpoint."""
    df.sparkSession.dataSource.register(PublishedSource)
    out = df.writeStream.format("published").option("kind", kind).option("path", path).option("checkpointLocation", checkpoint)
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed parts, each checked against its digest."""
    spark.dataSource.register(PublishedSource)
    return spark.read.format("published").load(path)


def sweep(path: str) -> int:
    """Removes parts that no manifest names, such as those of killed tasks; only while nothing is being written there."""
    folder = Folder(path)
    named = {f["name"] for m in manifests(path) for f in m["files"]}
    lost = [n for n in folder.names(PARTS) if n not in named]
    folder.delete(f"{PARTS}/{n}" for n in lost)
    return len(lost)
