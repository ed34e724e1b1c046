"""Reports, manifests and published folders: staged beside their place, put there whole, a marker last.

Files go through Hadoop's file systems, so that the folders may lie wherever Spark can write.
"""

from __future__ import annotations

import base64
import html
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """A Hadoop file system, as far as sinks need it."""

    def __init__(self, spark: SparkSession, near: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(near).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def move(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"could not move {a} to {b}")

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """All of it or nothing: a part file beside the path, then its name changes."""
        part = f"{path}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(data))
            stream.hsync() if hasattr(stream, "hsync") else None
        finally:
            stream.close()
        if self.exists(path):
            self.delete(path)
        self.move(part, path)


def canonical(value) -> bytes:
    """JSON with sorted keys; numbers that are not finite are an error."""
    return (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Reports, states, proofs and positions: small values as canonical JSON, replaced as a whole."""
    files = Files(spark, path)
    files.make(path.rpartition("/")[0])
    files.write(path, canonical(value))


def read_json(spark: SparkSession, path: str, default=None):
    """The value at path; the default where there is none or it cannot be read."""
    files = Files(spark, path)
    try:
        return json.loads(files.read(path)) if files.exists(path) else default
    except ValueError:
        return default


def publish(spark: SparkSession, staged: dict[str, str]) -> None:
    """Moves every staged folder or file to its place, or none: what stood there is put aside first and comes back if any
    move fails."""
    if not staged:
        return
    files, aside, done = Files(spark, next(iter(staged))), [], []
    try:
        for source, place in staged.items():
            if files.exists(place):
                backup = f"{place}.backup-{uuid.uuid4().hex}"
                files.move(place, backup)
                aside.append((backup, place))
            files.move(source, place)
            done.append(place)
    except Exception:
        for place in done:
            files.delete(place)
        for backup, place in aside:
            files.move(backup, place)
        raise
    for backup, _ in aside:
        files.delete(backup)


def content_digest(df: DataFrame) -> dict:
    """{rows, digest}: the same for the same rows in any order or partition; nothing but two numbers reaches the driver."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(7), row).cast("decimal(38,0)")).alias("b")).first()
    return {"rows": got["n"], "digest": f"{int(got['a'] or 0) % (1 << 64):016x}{int(got['b'] or 0) % (1 << 64):016x}"}


def write_tables(spark: SparkSession, out: str, tables: dict[str, DataFrame], summary: dict, formats: tuple[str, ...] = ("csv", "json")) -> dict:
    """Writes each table in each format below out and then out/_manifest.json, the mark that all is there: the summary,
    and for each table its rows and digest. A reader that finds no mark finds an unfinished report. Returns the manifest."""
    files, staged, listed = Files(spark, out), {}, {}
    files.make(out)
    if files.exists(f"{out}/_manifest.json"):
        files.delete(f"{out}/_manifest.json")
    for name, df in tables.items():
        listed[name] = content_digest(df)
        for kind in formats:
            part = f"{out}/.{name}.{kind}.part-{uuid.uuid4().hex}"
            writer = df.write.option("header", True) if kind == "csv" else df.write
            writer.format(kind).save(part)
            staged[part] = f"{out}/{name}.{kind}"
    publish(spark, staged)
    manifest = {"summary": summary, "tables": listed, "formats": list(formats)}
    write_json(spark, f"{out}/_manifest.json", manifest)
    return manifest


def manifest_problem(spark: SparkSession, out: str, schemas: dict[str, str]) -> str | None:
    """Why the tables at out are not those of its manifest: 'missing', 'unfinished' or 'changed: name'; else None."""
    manifest = read_json(spark, f"{out}/_manifest.json")
    if manifest is None:
        return "unfinished" if Files(spark, out).exists(out) else "missing"
    for name, want in manifest["tables"].items():
        if content_digest(spark.read.schema(schemas[name]).json(f"{out}/{name}.json")) != want:
            return f"changed: {name}"
    return None


def pair_tables(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """A pair report (file, status, counterpart) and its counts from pairs (left, right)."""
    status = F.when(F.col("right").isNull(), "missing_caption").when(F.col("left").isNull(), "orphan_caption").otherwise("paired")
    rows = pairs.select(F.coalesce("left", "right").alias("file"), status.alias("status"), F.when(F.col("left").isNotNull(), F.col("right")).alias("counterpart"))
    counts = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}  # three rows
    return rows, {s: counts.get(s, 0) for s in ("paired", "missing_caption", "orphan_caption")}


def extraction_tables(members: DataFrame) -> tuple[DataFrame, dict]:
    """The status report of an extraction and how many members have each status, with what was done in a word."""
    counts = {r["status"]: r["n"] for r in members.groupBy("status").agg(F.count("*").alias("n")).collect()}  # five rows at most
    action = "aborted" if counts.get("aborted") else "failed" if not counts.get("written") and counts.get("error") else "extracted"
    return members.select("archive", "status", "name", "bytes", "sha256", "reason"), {"action": action, **{s: counts.get(s, 0) for s in ("written", "skipped", "rejected", "error", "aborted")}}


def completion_path(out: str | None, state: str, tool: str, job: str) -> str:
    """Where a job's report goes: below its outputs, or in the state folder where it has none."""
    return f"{out}/reports/{tool}_{job}.json" if out else f"{state}/{tool}_{job}.json"


def complete(spark: SparkSession, report: dict, path: str, write_manifest=None, reused: bool = False) -> list[str]:
    """Writes a job's manifest (not for a reused result) and its report; failures to write are returned as warnings."""
    warnings = []
    for what, step in (("manifest", None if reused else write_manifest), ("report", lambda: write_json(spark, path, report))):
        try:
            if step:
                step()
        except Exception as e:  # noqa: BLE001  results stay valid without their report
            warnings.append(f"{what} write failed: {e}")
    return warnings


def page(title: str, summary: dict, sample: list[dict], pictures: dict[str, np.ndarray] | None = None) -> str:
    """A report as one HTML page: counts, the sample's rows and, at most a few, pictures as inline PNG."""
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    counts = "".join(f"<tr>{cell(k)}{cell(v)}</tr>" for k, v in summary.items())
    names = list(sample[0]) if sample else []
    rows = "".join("<tr>" + "".join(cell(r[c]) for c in names) + "</tr>" for r in sample)
    shown = "".join(f'<img alt="{html.escape(k, quote=True)}" src="{data_uri(v)}">' for k, v in (pictures or {}).items())
    head = "".join(f"<th>{html.escape(c)}</th>" for c in names)
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{counts}</table><table><tr>{head}</tr>{rows}</table>{shown}\n'


def png(image: np.ndarray) -> bytes:
    """A picture of 8-bit samples (height, width, 1 to 4 channels) as PNG."""
    image = image.reshape(*image.shape[:2], -1).astype(np.uint8)
    height, width, channels = image.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)  # filter 0 before each row
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def data_uri(image: np.ndarray, most: int = 96) -> str:
    """A thumbnail of at most so many pixels a side, inline."""
    from .images import resize

    scale = min(1.0, most / max(image.shape[:2]))
    if scale < 1:
        image = resize(image, max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))).round()
    return "data:image/png;base64," + base64.b64encode(png(image)).decode()


def gif(frames: list[np.ndarray], fps: float) -> bytes:
    """Frames of equal size (height, width, 3) as an endless animation, in 256 fixed colours (3, 3 and 2 bits)."""
    height, width = frames[0].shape[:2]
    levels = [(r * 255 // 7, g * 255 // 7, b * 255 // 3) for r in range(8) for g in range(8) for b in range(4)]
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), bytes(x for c in levels for x in c), b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for f in frames:
        index = (f[..., 0] >> 5 << 5 | f[..., 1] >> 5 << 2 | f[..., 2] >> 6).astype(np.uint16).ravel()
        # Codes stay nine bits long where the table is cleared before it grows past them.
        codes = np.concatenate([c for i in range(0, len(index), 250) for c in ([256], index[i : i + 250])] + [[257]]).astype(np.uint16)
        bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :9]
        data = np.packbits(bits.ravel(), bitorder="little").tobytes()
        out += [b"!\xf9\x04\x04", struct.pack("<H", max(2, round(100 / fps))), b"\x00\x00", b",", struct.pack("<HHHHB", 0, 0, width, height, 0), b"\x08"]
        out += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)] + [b"\x00"]
    return b"".join([*out, b";"])


COPIED = "source string, target string, bytes long, sha256 string, error string"
PIECE = 1 << 20


def place(path: str):
    """(file system, path) of Arrow's for a URI or a local path, which all executors must mount."""
    import pyarrow.fs

    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def put(pieces, target: str, size: int | None) -> tuple[int, str]:
    """Bytes and SHA-256 of what is written to the target: all of it, of the size that is expected (null: any), under a
    part's name that changes at the end; else nothing."""
    import hashlib

    fs, path = place(target)
    part, sha, n = f"{path}.{uuid.uuid4().hex}.part", hashlib.sha256(), 0
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with fs.open_output_stream(part) as out:
            for data in pieces:
                sha.update(data)
                n += len(data)
                out.write(data)
        if size is not None and n != size:
            raise OSError(f"{n} bytes of {size}")
        fs.move(part, path)
    except Exception:
        if fs.get_file_info(part).is_file:
            fs.delete_file(part)
        raise
    return n, sha.hexdigest()


def each_put(rows, work) -> pa.RecordBatch:
    """work(source, target, size or content) -> (bytes, digest) for each row; a failure is its row's error."""
    out = []
    for source, target, what in rows:
        try:
            out.append((source, target, *work(source, target, what), None))
        except OSError as e:
            out.append((source, target, None, None, f"{type(e).__name__}: {e}"))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names=["source", "target", "bytes", "sha256", "error"])


def write_files(contents: DataFrame) -> DataFrame:
    """COPIED for contents (source, target, content): each content in a file of its own, whole or not at all, written by the
    tasks that hold the rows. Null contents are empty files."""

    def work(source, target, content):
        content = content or b""
        return put((content[i : i + PIECE] for i in range(0, len(content), PIECE)), target, len(content))

    def run(it):
        for b in it:
            yield each_put(zip(*(c.to_pylist() for c in b.columns), strict=True), work)

    return contents.select("source", "target", F.col("content").cast("binary").alias("content")).mapInArrow(run, COPIED)


def copy_files(moves: DataFrame, move: bool = False) -> DataFrame:
    """COPIED for moves (source, target, bytes), both on file systems that Arrow knows: hashed while copied to a part file,
    held against the expected size (null: any), then renamed. A failed copy leaves no target; a move removes its source
    only after that."""

    def work(source, target, size):
        fs, path = place(source)
        with fs.open_input_stream(path) as f:
            done = put(iter(lambda: f.read(PIECE), b""), target, size)
        if move:
            fs.delete_file(path)
        return done

    def run(it):
        for b in it:
            yield each_put(zip(*(c.to_pylist() for c in b.columns), strict=True), work)

    return moves.select("source", "target", F.col("bytes").cast("long").alias("bytes")).mapInArrow(run, COPIED)


def send_set(files: DataFrame, out: str, name: str) -> DataFrame:
    """moves for copy_files: the one file of a set goes to out itself, several go to a folder of the set's name."""
    n = files.count()
    folder = out if n == 1 else f"{out}/{name}"
    return files.select(F.col("path").alias("source"), F.concat(F.lit(folder + "/"), F.regexp_extract("path", "[^/]*$", 0)).alias("target"), "bytes")


def decide(state: dict, key: str, decision: str, sent=None) -> dict:
    """state with a verdict on a set, 'ok' or 'redo'. sent(key) sends a set and returns where it went; a set that was sent
    before, to a place that is still known, is not sent again."""
    if decision not in ("ok", "redo"):
        raise ValueError("a decision is 'ok' or 'redo'")
    entry, before = {"decision": decision}, state.get("decisions", {}).get(key, {})
    if decision == "redo":
        entry["dest"] = before["dest"] if before.get("decision") == "redo" and before.get("dest") else sent(key)
    return {"decisions": {**state.get("decisions", {}), key: entry}, "position": key}


def sweep_parts(spark: SparkSession, folder: str) -> int:
    """Removes part files that an interrupted run left in a folder."""
    files = Files(spark, folder)
    stale = [n for n in files.names(folder) if n.endswith(".part") or ".part." in n or ".part-" in n]
    for n in stale:
        files.delete(f"{folder}/{n}")
    return len(stale)


def roll_back(spark: SparkSession, root: str, written: list[str]) -> int:
    """Removes what one attempt wrote (paths below root, none beyond it), latest first; returns how many were there."""
    files, n = Files(spark, root), 0
    for path in reversed(written):
        if path.startswith(root.rstrip("/") + "/") and "/../" not in path and files.exists(path):
            n += files.delete(path)
    return n


def clean_folder(spark: SparkSession, folder: str, keep: str = ".png") -> int:
    """Removes all files of a folder that do not end as they should."""
    files = Files(spark, folder)
    junk = [n for n in files.names(folder) if not n.lower().endswith(keep)]
    for n in junk:
        files.delete(f"{folder}/{n}")
    return len(junk)
