"""WARC archives: a record for each page, written and read by Spark's own sources, and a reader that salvages damaged ones.

Archives hold one gzip member per record (or plain records) and go through Spark's text writer, so that they can be on any
file system that Spark knows and are committed like any other table. The writer ends each row with one byte: a member's
last byte is the highest one of its length, 0 for every member below 16 MB; a plain record's is its last line feed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, HOT, batches, is_small, meet, new_path, save, tidy

#: Payloads below this size are never stored by reference.
LEAST = 100
#: Members hold less than this, so that the last byte of their length is 0.
MEMBER = (1 << 24) - 1
PIECE = 1 << 16
URN = "urn:sluice:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a record may begin after damage: a version line or a gzip member.
NEXT_LINE = re.compile(rb"(?<=\n)WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/1\.[01]\r\n")
FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*((?:[^\r\n]|\r\n[ \t])*)\r\n")
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


# Records


def header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def http_head(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def record(payload: bytes, digest: str, record_id: str, uri: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or with refers_to a revisit without it."""
    block = http_head(len(payload)) + (b"" if refers_to else payload)
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return header(fields) + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + b"\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(data: bytes, level: int | None) -> list[bytes]:
    """The record as it is stored, as rows that lack their last byte."""
    if level is None:
        return [data[:-1]]
    return [member(data[at : at + MEMBER], level)[:-1] for at in range(0, len(data), MEMBER)]


# Salvage


class Damaged(ValueError):
    """A record that fails a check."""


class Cut(Damaged):
    """A record that goes on beyond the bytes at hand."""


@dataclass
class Record:
    """A record whose checks all hold; of a compressed one, start and end are those of its members."""

    start: int
    end: int
    fields: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, if it has one."""
        if self.fields.get("content-type", "").replace(" ", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    """Bytes from start to end that are no valid record."""

    start: int
    end: int
    reason: str


def check_digest(stated: str, data: bytes, what: str) -> None:
    """Compares with a digest stated as algorithm:value in hexadecimal or base 32; unknown algorithms are taken as they are."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return
    found = hashlib.new(name, data).digest()
    if value.lower() != found.hex() and value.upper().rstrip("=") != base64.b32encode(found).decode().rstrip("="):
        raise Damaged(f"{what} digest")


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields (names in lower case), block and end of the record at this place; Damaged where a check fails."""
    version = VERSION.match(data, at)
    if not version:
        if len(data) - at < 10 and b"WARC/1.1\r\n".startswith(data[at:].replace(b"1.0", b"1.1")):
            raise Cut("version line")
        raise Damaged("version line")
    fields, pos = {}, version.end()
    while m := FIELD.match(data, pos):
        fields.setdefault(m[1].decode("latin-1").lower(), re.sub(r"\r\n[ \t]+", " ", m[2].decode("utf-8", "replace")).strip())
        pos = m.end()
    if data[pos : pos + 2] != b"\r\n":
        raise (Cut if b"\r\n" not in data[pos:] else Damaged)("header field")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("content length")
    start, end = pos + 2, pos + 2 + int(size)
    if end + 4 > len(data):
        raise Cut("block")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = bytes(data[start:end])
    if "warc-block-digest" in fields:
        check_digest(fields["warc-block-digest"], block, "block")
    if "warc-payload-digest" in fields and fields.get("warc-type") != "revisit":
        check_digest(fields["warc-payload-digest"], Record(0, 0, fields, block).payload, "payload")
    return fields, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at this place, checked against its CRC and length, and where it ends."""
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = data[pos : pos + PIECE]
            if not piece:
                raise Cut("member")
            parts.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Damaged("member") from e
    return b"".join(parts), pos - len(z.unused_data)


def in_member(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int, str]:
    """All records of the gzip member at this place, of those after it that continue its last record, the end, and the
    reason for which the rest of the content is no record (empty if there is none)."""
    content, end = inflate(data, at)
    found, pos = [], 0
    while pos < len(content):
        try:
            fields, block, pos = parse(content, pos)
            found.append((fields, block))
        except Cut as e:
            try:
                if data[end : end + 3] != MAGIC:
                    return found, end, str(e)
                more, further = inflate(data, end)
            except Damaged:
                return found, end, str(e)
            if VERSION.match(more):
                return found, end, str(e)
            content, pos, end = content[pos:] + more, 0, further
        except Damaged as e:
            return found + in_rest(content, pos + 1), end, str(e)
    return found, end, ""


def in_rest(content: bytes, at: int) -> list[tuple[dict[str, str], bytes]]:
    """The valid records from this place on, each at the next version line that one begins at."""
    found = []
    while m := NEXT_LINE.search(content, at):
        try:
            fields, block, at = parse(content, m.start())
            found.append((fields, block))
        except Damaged:
            at = m.start() + 1
    return found


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that hold every check, in order, and the gaps between them.

    After a failed check the next place is sought at which a member or a version line begins a valid record; everything
    passed over is a gap. A member that is sound but whose content is no record, or not all of it, is a gap too, after the
    records that it does hold.
    """
    at, bad, reason = 0, -1, ""
    while at < len(data):
        held, end, why = [], at, ""
        try:
            if data[at : at + 3] == MAGIC:
                held, end, why = in_member(data, at)
                if not held and why:
                    raise Damaged(why)
            else:
                fields, block, end = parse(data, at)
                held = [(fields, block)]
        except Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            following = NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad >= 0:
            yield Gap(bad, at, reason)
            bad = -1
        for fields, block in held:
            yield Record(at, end, fields, block)
        if why:
            yield Gap(at, end, why)
        at = end
    if bad >= 0:
        yield Gap(bad, len(data), reason)


# Spark


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def write(pages: DataFrame, path: str, level: int | None = 6, per_file: int = 16_384, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html) into archives in the folder `path`, which must be new.

    Of rows with equal payloads of at least LEAST bytes the one of the smallest page_id is a response, the others are
    revisits that refer to it; rows that repeat that page_id and payload are responses as well. Null ids come last. Null
    html is an empty payload; a null url is named after the record. level is that of gzip, None writes plain records;
    per_file bounds the records of one archive, since readers take a file at a time.

    Only digests are shuffled, and grouped before they are. Rows meet the first of their payload by a broadcast if there are
    few such groups; else hot ones are broadcast and the other rows are shuffled.
    """
    payload = payload_of(F.col("html"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = pages.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    groups = save(groups, "payloads")
    if is_small(groups):
        named = pages.join(F.broadcast(groups.drop("c")), "digest", "left")
    else:
        is_hot = F.col("c") * HOT > pages.count()
        top = F.broadcast(groups.where(is_hot).select("digest", F.col("first").alias("top"), F.lit(True).alias("hot")))
        rest = groups.where(~is_hot).select(F.col("digest").alias("key"), "first")
        # hot rows keep a key of their own, that no other row has, and stay spread out
        key = F.when(F.col("hot"), F.concat("digest", F.coalesce(F.col("page_id"), F.lit(-1)).cast("string").cast("binary"))).otherwise(F.col("digest"))
        named = pages.join(top, "digest", "left").withColumn("key", key).join(rest, "key", "left").withColumn("first", F.coalesce("top", "first"))
    later = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    rows = named.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))

    def run(it):
        for b in it:
            out = []
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = digest.hex()
                record_id = f"{URN}{'null' if page_id is None else page_id}:{name}"
                uri = record_id if url is None else UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
                out += packed(record(body, name, record_id, uri, None if refers_to is None else f"{URN}{refers_to}:{name}", date), level)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    stored = batches(rows).mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string").alias("value"))
    stored.write.option("lineSep", "\n" if level is None else "\0").option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


RECORDS = "file string, start long, end long, damage string, type string, record_id string, uri string, refers_to string, payload_digest string, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All that salvage() finds in the archives of a folder (or those a pattern names), a row each: the file, the bytes from
    start to end, and a record's type, id, target, reference, stated payload digest and payload (of other records than
    responses: the block); for a gap only `damage`, the check that failed. An empty folder gives no rows.

    A file is read whole by one task. Archives of over 2 GB are beyond Spark's reader of binary files and raise there.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(it):
        for b in it:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py()
                for found in salvage(data):
                    if isinstance(found, Gap):
                        yield name, found.start, found.end, found.reason, *[None] * 6
                        continue
                    f = found.fields
                    ids = [v.strip("<>") if (v := f.get(k)) else None for k in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
                    yield name, found.start, found.end, None, f.get("warc-type"), *ids, f.get("warc-payload-digest"), found.payload

    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary()]
    names = ["file", "start", "end", "damage", "type", "record_id", "uri", "refers_to", "payload_digest", "payload"]

    def run(it):
        held, size = [], 0
        for row in rows(it):
            held.append(row)
            size += 500 + len(row[-1] or b"")
            if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return batches(files).mapInArrow(tidy(run), RECORDS)


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """The log of quarantined bytes: file, start, end, damage; at most the number of records lost, none in sound archives."""
    return read(spark, path).where("damage IS NOT NULL").select("file", "start", "end", "damage")


def round_trip(pages: DataFrame, level: int | None = 6) -> DataFrame:
    """Writes pages as archives and reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are of the payload read; a revisit's are those of the response that it refers to. See write() for
    nulls and repeated rows, which all stay rows; an empty table gives none; further columns are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, level)
    page = lambda c: F.expr(f"nullif(split_part({c}, ':', 4), 'null')").cast("long")
    found = read(spark, path).where("damage IS NULL AND type IN ('response', 'revisit')")
    body = F.col("type") == "response"
    listed = found.select("type", "record_id", "refers_to", F.when(body, F.octet_length("payload")).cast("long").alias("payload_bytes"), F.when(body, F.sha2("payload", 256)).alias("payload_digest"))
    listed = save(listed, "records")
    revisits = listed.where("type = 'revisit'").select("record_id", "refers_to")
    asked = revisits.groupBy("refers_to").agg(F.count("*").alias("c"))
    bodies = listed.where("type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    answers = save(bodies.join(asked, "refers_to"), "answers")
    seen = meet(revisits, answers, ["refers_to"]).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), page("refers_to").alias("refers_to"))
    first = listed.where("type = 'response'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(seen)


#: What round_trip() gives, in DuckDB's SQL.
ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p),
r AS (SELECT *, strlen(body) >= {LEAST} AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS later FROM f)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN first END AS refers_to FROM r"""
