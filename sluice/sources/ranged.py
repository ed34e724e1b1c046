"""Archives of any size by byte ranges: a catalog of members first, then each member by the task that it falls to.

A zip's members are found in its central directory and a plain tar's by jumping from header to header, so that planning reads
no contents; budgets are prefix sums over the catalog, kept before anything is extracted. Members are then read by range, in
pieces, by as many tasks as there are, and nothing holds a whole archive or a whole member. A compressed tar can only be read
from its beginning: it is one task's, in one pass, also in pieces.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import prefix_scan
from ..operators.sinks import place
from ..operators.tables import save
from .archives import Limits, kind_of, safe_path

PIECE = 1 << 20
CATALOG = "archive string, ord long, member string, path string, kind string, start long, packed long, bytes long, crc long, reason string"
EXTRACTED = "archive string, ord long, path string, status string, bytes long, sha256 string, reason string"
DATA = "archive string, ord long, place long, data binary"


def unpacked(f):
    """A stream of what a compressed tar holds, by its first bytes; unlike tarfile's own, it goes on over all members of a
    gzip file and all streams of the other kinds."""
    magic = f.read(6)
    f.seek(0)
    if magic[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=f)
    if magic[:3] == b"BZh":
        return bz2.BZ2File(f)
    return lzma.LZMAFile(f) if magic == b"\xfd7zXZ\0" else f


def rows_of(archive: str) -> Iterator[tuple]:
    """A row of the catalog for each file in an archive; an archive that cannot be read ends with a row that says why."""
    order, kind = 0, kind_of(archive)
    try:
        if kind is None:
            raise ValueError("no archive")
        fs, path = place(archive)
        if kind == "zip":
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    why = "link" if i.external_attr >> 16 & 0o170000 == 0o120000 else "encrypted" if i.flag_bits & 1 else "" if i.compress_type in (0, 8) else "method"
                    yield archive, order, i.filename, safe_path(i.filename), "stored" if i.compress_type == 0 else "deflated", i.header_offset, i.compress_size, i.file_size, i.CRC, why
                    order += 1
            return
        plain = archive.lower().endswith(".tar")
        with fs.open_input_file(path) as f, tarfile.open(fileobj=f if plain else unpacked(f), mode="r:" if plain else "r|") as t:
            for m in t:
                if m.isdir():
                    continue
                why = "" if m.isfile() else "link" if m.issym() or m.islnk() else "special"
                yield archive, order, m.name, safe_path(m.name), "plain" if plain else "stream", m.offset_data, m.size, m.size, None, why
                order += 1
                t.members = []  # a streamed archive keeps no list
    except (OSError, EOFError, ValueError, tarfile.TarError, zipfile.BadZipFile, NotImplementedError, zlib.error, lzma.LZMAError) as e:
        yield archive, order, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def catalog(archives: DataFrame) -> DataFrame:
    """CATALOG of archives (path), on file systems that Arrow knows: a row for each file, in order, and one with a reason and
    no member for an archive that cannot be read (to its end). One task reads an archive's directory."""

    def run(it):
        names = [c.split()[0] for c in CATALOG.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        held: list[tuple] = []
        for b in it:
            for archive in b.column(0).to_pylist():
                for row in rows_of(archive):
                    held.append(row)
                    if len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.where("path IS NOT NULL").select("path").distinct().repartition(tasks, "path").mapInArrow(run, CATALOG)


def planned(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The catalog with `status`: aborted from the first member on by which an archive has more members or declares more bytes
    than it may, error for unreadable archives, skipped for links and what is filtered, rejected for paths that leave the
    folder, repeated for a path (in any case) that an earlier member of the archive has; chosen for all others."""
    members = save(members, "catalog")
    files = members.where("member IS NOT NULL")
    declared = prefix_scan(files, ["archive"], ["ord"], F.col("bytes"), "sum", "_bytes", inclusive=True)
    over = (F.col("_bytes") > limits.total) | (F.col("ord") >= limits.members) | (F.col("bytes") > limits.member)
    stop = declared.where(over).groupBy("archive").agg(F.min("ord").alias("_stop"))
    first = files.where("path IS NOT NULL").groupBy("archive", F.lower("path").alias("_low")).agg(F.min("ord").alias("_first"))
    named = members.withColumn("_low", F.lower("path")).join(stop, "archive", "left").join(first, ["archive", "_low"], "left")
    wanted = F.lit(True)
    if limits.suffixes:
        wanted = F.coalesce(*[F.when(F.endswith(F.lower("path"), F.lit(s)), True) for s in limits.suffixes], F.lit(False))
    status = F.when(F.col("ord") >= F.col("_stop"), "aborted").when(F.col("member").isNull(), "error").when(F.col("reason") != "", "skipped")
    status = status.when(F.col("path").isNull(), "rejected").when(~wanted, "skipped").when(F.col("ord") > F.col("_first"), "repeated").otherwise("chosen")
    return save(named.select(*members.columns, status.alias("status")), "planned")


def inflated(f, kind: str, start: int, packed: int) -> Iterator[bytes]:
    """The contents of a member in pieces of at most PIECE bytes, read by ranges from where it starts."""
    if kind != "plain":
        f.seek(start)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member where the directory has one")
        start += 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    f.seek(start)
    z = zlib.decompressobj(-15) if kind == "deflated" else None
    while packed > 0:
        data = f.read(min(PIECE, packed))
        if not data:
            raise EOFError("the archive ends within a member")
        packed -= len(data)
        if z is None:
            yield data
            continue
        while data:
            yield z.decompress(data, PIECE)
            data = z.unconsumed_tail
    if z is not None and (rest := z.flush()):
        yield from (rest[i : i + PIECE] for i in range(0, len(rest), PIECE))


def checked(pieces: Iterator[bytes], size: int, crc: int | None) -> Iterator[bytes]:
    """The pieces; an error at once where they are more than declared, at the end where they are fewer or others."""
    n = found = 0
    for data in pieces:
        n += len(data)
        if n > size:
            raise ValueError("a member holds more bytes than it declares")
        found = zlib.crc32(data, found)
        yield data
    if n < size or crc is not None and found != crc:
        raise ValueError("a member is not what the directory has")


BROKEN = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, tarfile.TarError)


def failing(e: Exception) -> Iterator[bytes]:
    raise e
    yield b""


def streamed(row: dict) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(row, pieces) of the chosen members (`many`) of an archive that is read from its beginning; where it breaks off, what
    has not come fails."""
    left = {m["ord"]: m for m in row["many"]}
    try:
        fs, path = place(row["archive"])
        with fs.open_input_file(path) as f, tarfile.open(fileobj=unpacked(f), mode="r|") as t:
            order = 0
            for m in t:
                if m.isdir():
                    continue
                if order in left:
                    stream = t.extractfile(m)
                    yield row | left.pop(order), checked(iter(lambda s=stream: s.read(PIECE), b""), m.size, None)
                order += 1
                t.members = []
        broken: Exception = EOFError("the archive has fewer members than before")
    except BROKEN as e:
        broken = e
    for m in left.values():
        yield row | m, failing(broken)


def each_member(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(row, its pieces) for the rows of dealt()."""
    for row in rows:
        if row["kind"] == "stream":
            yield from streamed(row)
            continue
        try:
            fs, path = place(row["archive"])
            f = fs.open_input_file(path)
        except OSError as e:
            yield row, failing(e)
            continue
        with f:
            yield row, checked(inflated(f, row["kind"], row["start"], row["packed"]), row["bytes"], row["crc"])


def dealt(plan: DataFrame) -> DataFrame:
    """The chosen members over tasks: each by itself, those of a streamed archive together."""
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plan.where("status = 'chosen'")
    alone = rows.where("kind <> 'stream'").select("archive", "ord", "path", "kind", "start", "packed", "bytes", "crc", F.lit(None).cast("array<struct<ord:long,path:string>>").alias("many"))
    streams = rows.where("kind = 'stream'").groupBy("archive").agg(F.collect_list(F.struct("ord", "path")).alias("many"))  # at most Limits.members
    null = lambda c: F.lit(None).cast("long").alias(c)
    together = streams.select("archive", null("ord"), F.lit(None).cast("string").alias("path"), F.lit("stream").alias("kind"), null("start"), null("packed"), null("bytes"), null("crc"), "many")
    return alone.unionByName(together).repartition(tasks, F.xxhash64("archive", "ord"))


def contents(plan: DataFrame) -> DataFrame:
    """DATA: the contents of the chosen members of planned(), in pieces of at most PIECE bytes (place: where each begins). A
    member that fails its checks is an error."""

    def run(it):
        for row, pieces in each_member(r for b in it for r in b.to_pylist()):
            at = 0
            for data in pieces:
                yield pa.RecordBatch.from_arrays([pa.array([row["archive"]]), pa.array([row["ord"]], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["archive", "ord", "place", "data"])
                at += len(data)

    return dealt(plan).mapInArrow(run, DATA)


def extracted(plan: DataFrame) -> DataFrame:
    """EXTRACTED: what became of each row of planned(), with size and digest of the members that were read whole and are what
    the directory says (written), and the reason for those that are not (error)."""

    def run(it):
        for row, pieces in each_member(r for b in it for r in b.to_pylist()):
            sha, n, why = hashlib.sha256(), 0, None
            try:
                for data in pieces:
                    sha.update(data)
                    n += len(data)
            except BROKEN as e:
                why = f"{type(e).__name__}: {e}"
            values = [row["archive"], row["ord"], n, sha.hexdigest(), why]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["archive", "ord", "n", "sha", "why"])

    read = dealt(plan).mapInArrow(run, "archive string, ord long, n long, sha string, why string")
    both = plan.drop("bytes").join(read, ["archive", "ord"], "left")
    good = F.col("n").isNotNull() & F.col("why").isNull()
    status = F.when(F.col("status") != "chosen", F.col("status")).when(good, "written").otherwise("error")
    return both.select("archive", "ord", F.coalesce("path", "member").alias("path"), status.alias("status"), F.when(good, F.col("n")).alias("bytes"), F.when(good, F.col("sha")).alias("sha256"), F.coalesce("why", F.when(F.col("status") == "chosen", "").otherwise(F.col("reason"))).alias("reason"))
