"""Archives made by many tasks: blocks compressed side by side, offsets by prefix sums, bytes that do not depend on how rows lie.

Contents are cut into blocks of a fixed size. In a zip each block ends its part of a member's deflate stream at a byte, and
the member's CRC is combined from those of its blocks; a compressed tar is one gzip member a block. Where each piece stands in
its archive follows from sizes alone, so that no task holds an archive or a member: what joins the pieces only writes them one
behind the other.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import prefix_scan
from ..operators.sinks import place as place_of
from ..operators.tables import save
from .archives import kind_of

BLOCK = 1 << 20
LEVEL = 6
#: Zip without its 64-bit form: sizes below this, and so many members.
MOST_BYTES, MOST_MEMBERS = (1 << 32) - 1, (1 << 16) - 1
PIECES = "archive string, place long, data binary"
#: The time and mode that every member is given.
DOS_TIME, DOS_DATE, UNIX_FILE = 0, (1 << 5) | 1, 0o100644 << 16


def times_matrix(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def combined(first: int, second: int, n: int) -> int:
    """The CRC-32 of two texts in a row from that of each and the length of the second: the first is shifted by n zero bytes,
    by squaring the matrix over bits that shifts by one."""
    shift = [0xEDB88320, *[1 << i for i in range(31)]]  # one bit
    for _ in range(3):
        shift = [times_matrix(shift, row) for row in shift]
    while n:
        if n & 1:
            first = times_matrix(shift, first)
        shift = [times_matrix(shift, row) for row in shift]
        n >>= 1
    return first ^ second


def deflated(data: bytes, last: bool) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def tar_head(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.PAX_FORMAT)


def blocks(files: DataFrame) -> DataFrame:
    """(archive, name, block, raw, crc, data): the compressed blocks of files (archive, name, data), each by itself."""
    size = F.octet_length("data")
    count = F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")
    cut = files.select("archive", "name", F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data")).select("archive", "name", "data", size.alias("size"), count.alias("count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    cut = cut.select("archive", "name", "size", "count", "block", F.substring("data", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("data"))

    def run(it):
        for b in it:
            out = []
            for archive, name, size, count, block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                last = block == count - 1
                if kind_of(archive) == "zip":
                    out.append((archive, name, block, len(data), zlib.crc32(data), deflated(data, last)))
                else:
                    full = (tar_head(name, size) if block == 0 else b"") + data + (bytes(-size % 512) if last else b"")
                    out.append((archive, name, block, len(data), 0, gzipped(full)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=["archive", "name", "block", "raw", "crc", "data"])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, F.xxhash64("archive", "name", "block")).mapInArrow(run, "archive string, name string, block int, raw long, crc long, data binary")


def members_of(parts: DataFrame) -> DataFrame:
    """(archive, name, raw, packed, crc) of each member, its CRC combined from its blocks'."""
    lists = parts.groupBy("archive", "name").agg(F.sum("raw").alias("raw"), F.sum(F.octet_length("data").cast("long")).alias("packed"), F.sort_array(F.collect_list(F.struct("block", "crc", "raw"))).alias("each"))

    def run(it):
        for b in it:
            crcs = []
            for each in b.column(4).to_pylist():
                crc = 0
                for e in each:
                    crc = combined(crc, e["crc"], e["raw"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64())], names=["archive", "name", "raw", "packed", "crc"])

    return lists.mapInArrow(run, "archive string, name string, raw long, packed long, crc long")


def local_and_central(name: str, raw: int, packed: int, crc: int, start: int) -> tuple[bytes, bytes]:
    """A zip member's header and its entry in the directory."""
    encoded = name.encode()
    common = struct.pack("<HHHHHIIIH", 20, 0x800, 8, DOS_TIME, DOS_DATE, crc, packed, raw, len(encoded))
    return b"PK\x03\x04" + common + b"\0\0" + encoded, b"PK\x01\x02" + struct.pack("<H", 0x314) + common + struct.pack("<HHHHII", 0, 0, 0, 0, UNIX_FILE, start) + encoded


def pieces(files: DataFrame) -> DataFrame:
    """PIECES of archives from files (archive, name, data): in order of place and put one behind the other they are the
    archive, a zip or a gzip-compressed tar by its name. Members are in order of name; times are fixed, so that equal files
    make equal archives whatever the partitions. Names should not repeat within an archive; null data is an empty member.

    A zip member or archive of 4 GB or a directory of 65,536 members is an error: use a tar.
    """
    parts = save(blocks(files), "blocks")
    members = save(members_of(parts), "members")
    zipped = F.endswith(F.lower("archive"), F.lit(".zip"))
    head = F.when(zipped, 30 + F.octet_length("name")).otherwise(0).cast("long")
    members = prefix_scan(members.withColumn("head", head), ["archive"], ["name"], F.col("head") + F.col("packed"), "sum", "start").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    members = save(members, "placed")
    inside = prefix_scan(parts.select("archive", "name", "block", F.octet_length("data").cast("long").alias("n")), ["archive", "name"], ["block"], F.col("n"), "sum", "inside").select("archive", "name", "block", F.coalesce("inside", F.lit(0).cast("long")).alias("inside"))
    body = parts.join(inside, ["archive", "name", "block"]).join(members.select("archive", "name", "start", "head"), ["archive", "name"]).select("archive", (F.col("start") + F.col("head") + F.col("inside")).alias("place"), "data")

    entry = prefix_scan(members, ["archive"], ["name"], F.when(zipped, 46 + F.octet_length("name")).cast("long"), "sum", "entry").withColumn("entry", F.coalesce("entry", F.lit(0).cast("long")))
    ends = members.groupBy("archive").agg(F.max(F.col("start") + F.col("head") + F.col("packed")).alias("end"), F.count("*").alias("n"), F.sum(F.when(zipped, 46 + F.octet_length("name")).cast("long")).alias("directory"))
    ends = save(ends, "ends")

    def heads(it):
        for b in it:
            out = []
            for r in b.to_pylist():
                if max(r["raw"], r["packed"], r["start"]) > MOST_BYTES:
                    raise ValueError(f"{r['archive']}: 4 GB or more need a tar")
                first, second = local_and_central(r["name"], r["raw"], r["packed"], r["crc"], r["start"])
                out += [(r["archive"], r["start"], first), (r["archive"], r["end"] + r["entry"], second)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["archive", "place", "data"])

    def tails(it):
        for b in it:
            out = []
            for r in b.to_pylist():
                if kind_of(r["archive"]) != "zip":
                    out.append((r["archive"], r["end"], gzipped(bytes(2 * tarfile.BLOCKSIZE))))
                    continue
                if r["n"] > MOST_MEMBERS or r["end"] + r["directory"] > MOST_BYTES:
                    raise ValueError(f"{r['archive']}: a zip of this size needs a tar")
                out.append((r["archive"], r["end"] + r["directory"], b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, r["n"], r["n"], r["directory"], r["end"], 0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["archive", "place", "data"])

    framed = entry.where(zipped).join(ends.select("archive", "end"), "archive").mapInArrow(heads, PIECES)
    return body.unionByName(framed).unionByName(ends.mapInArrow(tails, PIECES))


def write(found: DataFrame, folder: str) -> DataFrame:
    """(archive, path, bytes): PIECES written to files below the folder, one archive by one task, piece behind piece, under a
    part's name that changes at the end. A gap or an overlap between pieces is an error, and leaves no file."""

    def run(it):
        now, out, at, fs, path = None, None, 0, None, ""

        def finish():
            out.close()
            fs.move(f"{path}.part", path)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{folder}/{now}"]), pa.array([at], pa.int64())], names=["archive", "path", "bytes"])

        for b in it:
            for archive, where, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != now:
                    if out is not None:
                        yield finish()
                    now, at = archive, 0
                    fs, path = place_of(f"{folder}/{archive}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{path}.part")
                if where != at:
                    out.close()
                    fs.delete_file(f"{path}.part")
                    raise ValueError(f"{archive}: a piece at {where} instead of {at}")
                out.write(data)
                at += len(data)
        if out is not None:
            yield finish()

    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(tasks, "archive").sortWithinPartitions("archive", "place").select("archive", "place", "data")
    return dealt.mapInArrow(run, "archive string, path string, bytes long")


def serial(archive: str, files: list[tuple[str, bytes]]) -> bytes:
    """The same archive by one loop: what pieces() is held against."""
    out, directory = io.BytesIO(), []
    for name, data in sorted(files):
        cut = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
        if kind_of(archive) == "zip":
            body, start = b"".join(deflated(c, i == len(cut) - 1) for i, c in enumerate(cut)), out.tell()
            first, second = local_and_central(name, len(data), len(body), zlib.crc32(data), start)
            out.write(first + body)
            directory.append(second)
        else:
            for i, c in enumerate(cut):
                out.write(gzipped((tar_head(name, len(data)) if i == 0 else b"") + c + (bytes(-len(data) % 512) if i == len(cut) - 1 else b"")))
    end = out.tell()
    if kind_of(archive) == "zip":
        out.write(b"".join(directory) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(directory), len(directory), sum(map(len, directory)), end, 0))
    else:
        out.write(gzipped(bytes(2 * tarfile.BLOCKSIZE)))
    return out.getvalue()
