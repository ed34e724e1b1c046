"""Archives as tables: members with their bytes, under budgets, with safe names; and archives built from tables."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: archives within archives are opened this deep at most.
DEEPEST = 2
MEMBER = "archive string, ord long, depth int, name string, status string, bytes long, sha256 string, reason string"
UNSAFE = re.compile(r'[<>:"|?*\x00-\x1f]')
RESERVED = re.compile(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")


@dataclass(frozen=True)
class Limits:
    total: int = 8 << 30
    member: int = 2 << 30
    members: int = 100_000
    depth: int = 1
    suffixes: tuple[str, ...] = ()


class OverBudget(Exception):
    pass


def kind_of(name: str) -> str | None:
    low = name.lower()
    if low.endswith(".unitypackage"):
        return "unity"
    if low.endswith(".zip"):
        return "zip"
    return "tar" if re.search(r"\.(tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz|gz)$", low) else None


def safe_path(name: str) -> str | None:
    """A member's path below its archive's folder, cleaned; None for one that would leave it or that has nothing left."""
    if name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name):
        return None
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        return None
    clean = [UNSAFE.sub("_", p).rstrip(" .") or "_" for p in parts]
    return "/".join("_" + p if RESERVED.match(p) else p for p in clean)


class Budget:
    """Counts members and bytes, those declared and those read; over any limit it raises."""

    def __init__(self, limits: Limits):
        self.limits, self.members, self.declared, self.read = limits, 0, 0, 0

    def member(self, size: int) -> None:
        self.members += 1
        if self.members > self.limits.members:
            raise OverBudget(f"more than {self.limits.members} members")
        if size < 0 or size > self.limits.member:
            raise OverBudget(f"a member declares {size} bytes of {self.limits.member}")
        self.declared += size
        if self.declared > self.limits.total:
            raise OverBudget(f"members declare more than {self.limits.total} bytes")

    def drain(self, stream) -> bytes:
        out = bytearray()
        while chunk := stream.read(1 << 20):
            out += chunk
            self.read += len(chunk)
            if len(out) > self.limits.member or self.read > self.limits.total:
                raise OverBudget("a member holds more bytes than it may")
        return bytes(out)


def raw_members(content: bytes, kind: str, budget: Budget) -> Iterator[tuple[str, bytes | None, str]]:
    """(name, bytes, why not) of the files of an archive; links are named but not followed."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                budget.member(i.file_size)
                if i.external_attr >> 16 & 0o170000 == 0o120000:
                    yield i.filename, None, "link"
                elif i.flag_bits & 1:
                    yield i.filename, None, "encrypted"
                else:
                    with z.open(i) as f:
                        yield i.filename, budget.drain(f), ""
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        entries: dict[str, dict[str, bytes]] = {}
        for m in t:
            if m.isdir():
                continue
            budget.member(m.size)
            if not m.isfile():
                yield m.name, None, "link" if m.issym() or m.islnk() else "special"
                continue
            data = budget.drain(t.extractfile(m))
            if kind == "tar":
                yield m.name, data, ""
                continue
            parts = m.name.removeprefix("./").split("/")
            if len(parts) > 1 and parts[-1] in ("pathname", "asset"):
                if parts[-1] in entries.setdefault(parts[-2], {}):
                    yield m.name, None, "repeated"
                else:
                    entries[parts[-2]][parts[-1]] = data
        for entry in entries.values():
            if len(entry) == 2:
                lines = entry["pathname"][:8192].decode("utf-8", "replace").splitlines()
                yield (lines[0].strip() if lines else ""), entry["asset"], ""


def members(name: str, content: bytes | None, limits: Limits, depth: int = 0, budget: Budget | None = None) -> Iterator[tuple]:
    """(depth, name, status, bytes, sha256, reason, data): written, skipped, rejected or error; one row 'aborted' where a
    budget is passed and 'error' where the archive cannot be read. Archives among the members are opened behind them."""
    kind = kind_of(name)
    if kind is None or content is None:
        yield depth, None, "error", None, None, "no archive", None
        return
    if kind == "tar" and not tarfile.is_tarfile(io.BytesIO(content)) and name.lower().endswith(".gz"):
        content, kind = wrap(gzip.decompress(content), name), "tar"
    budget = budget or Budget(limits)
    seen: set[str] = set()
    try:
        for member, data, why in raw_members(content, kind, budget):
            path = safe_path(member)
            if data is None:
                yield depth, member, "error" if why == "repeated" else "skipped", None, None, why, None
            elif path is None:
                yield depth, member, "rejected", None, None, "unsafe path", None
            elif limits.suffixes and not path.lower().endswith(limits.suffixes):
                yield depth, member, "skipped", None, None, "filtered", None
            else:
                stem, dot, suffix = path.rpartition(".") if "." in path.rpartition("/")[2] else (path, "", "")
                n, free = 1, path
                while free.lower() in seen:
                    n += 1
                    free = f"{stem}_{n}{dot}{suffix}"
                seen.add(free.lower())
                yield depth, free, "written", len(data), hashlib.sha256(data).hexdigest(), "", data
                if depth < min(limits.depth, DEEPEST) and kind_of(free):
                    for row in members(free, data, limits, depth + 1, budget):
                        yield (row[0], f"{free}/{row[1] or ''}", *row[2:])
    except OverBudget as e:
        yield depth, None, "aborted", None, None, str(e), None
    except (OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
        yield depth, None, "error", None, None, type(e).__name__, None


def wrap(data: bytes, name: str) -> bytes:
    """A single compressed file as an archive of it."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name.rpartition("/")[2][:-3])
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def extract(archives: DataFrame, limits: Limits = Limits(), with_content: bool = False) -> DataFrame:
    """The members of archives (path, content), one row each; a null content or an unknown kind is an error row.

    One archive is read by one task, member by member, within its budgets.
    """

    def run(it):
        for b in it:
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, (depth, name, status, size, sha, reason, data) in enumerate(members(path or "", content, limits)):
                    row = {"archive": path, "ord": i, "depth": depth, "name": name, "status": status, "bytes": size, "sha256": sha, "reason": reason}
                    yield pa.RecordBatch.from_pylist([row | {"content": data}] if with_content else [row], schema=schema)

    fields = [("archive", pa.string()), ("ord", pa.int64()), ("depth", pa.int32()), ("name", pa.string()), ("status", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("reason", pa.string())]
    schema = pa.schema(fields + [("content", pa.binary())] * with_content)
    return archives.select("path", "content").mapInArrow(run, MEMBER + ", content binary" * with_content)


def build(files: DataFrame) -> DataFrame:
    """(path, content) of archives from files (archive, name, data), the kind by the archive's suffix: members by name, times
    of zero, so that equal files make equal archives. A .unitypackage takes guid/pathname and the like as names."""

    def pack(t: pa.Table) -> pa.Table:
        path = t["archive"][0].as_py()
        rows = sorted(zip(t["name"].to_pylist(), t["data"].to_pylist(), strict=True))
        out = io.BytesIO()
        if kind_of(path) == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in rows:
                    z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
        else:
            plain = io.BytesIO()
            with tarfile.open(fileobj=plain, mode="w") as tar:
                for name, data in rows:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as z:
                z.write(plain.getvalue())
        return pa.table({"path": [path], "content": pa.array([out.getvalue()], pa.binary())})

    return files.select("archive", "name", F.col("data").cast("binary").alias("data")).groupBy("archive").applyInArrow(pack, "path string, content binary")
