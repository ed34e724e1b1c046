"""Media columns: payloads cut by content into chunks, equal chunks stored once, ordered chunk lists to rebuild them.

A payload is stored as 8-bit samples. Its store is a table with one row for each distinct payload: a head with the length
and digest of each chunk in order, the samples of all chunks that occur nowhere else (`inline`), the samples of chunks
that occur again and of which this row is the first owner (`owned`), and the places of all chunks that are not inline
(`shared`). The stored form of a payload is its row's head, inline and owned samples, one after another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, SMALL, batches, id_text, meet, new_path, partitions, save

#: A cut where the gear hash of the last 32 bytes has its top MASK_BITS bits zero, between LEAST and MOST bytes.
MASK_BITS, LEAST, MOST = 11, 512, 16_384
UNIT = 64


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 pseudo-random 32-bit values by the splitmix rule."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(32)).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The hash rolls over 32 bytes: each step shifts older bytes out of its 32 bits."""
    h = gear()[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends, at = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST:
            at = end
            ends.append(at)
    while len(data) - at > MOST:
        at += MOST
        ends.append(at)
    return ends if at == len(data) else [*ends, len(data)]


def chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def head_of(parts: list[bytes]) -> bytes:
    """GEAR, the number of chunks, and (length, digest) of each."""
    return b"GEAR" + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + digest(p) for p in parts)


def table_of(head: bytes) -> tuple[list[int], list[bytes]]:
    """Lengths and digests of the chunks that a head names."""
    if head[:4] != b"GEAR" or len(head) != 8 + 20 * struct.unpack("<I", head[4:8])[0]:
        raise ValueError("damaged head")
    entries = list(struct.iter_unpack("<I16s", head[8:]))
    return [n for n, _ in entries], [d for _, d in entries]


def features(samples: bytes, n_chunks: int) -> str:
    """Mean, deviation and entropy of the samples, the share of the fullest of 16 bands, and the number of chunks."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    bands = n.reshape(16, 16).sum(axis=1)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};band={int(bands.argmax())}:{bands.max() / len(x):.4f};chunks={n_chunks}"


LISTING = "doc_id long, key binary, n_bytes long, digests array<binary>"
STORE = "key binary, n_bytes long, head binary, inline binary, owned array<struct<digest:binary,data:binary>>, shared array<struct<idx:int,digest:binary>>"
#: Of chunks' samples (at most MOST bytes each) so many are broadcast at once.
FEW_CHUNKS = 1_000


def payload_key(text: Column) -> Column:
    """The SHA-256 of the padded payload of a text that is not null."""
    raw = text.cast("binary")
    size = F.octet_length(raw)
    full = F.greatest(F.lit(UNIT), F.ceil(size / UNIT) * UNIT)
    return F.unhex(F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), (full - size).cast("int")))), 256))


def write(docs: DataFrame, path: str) -> DataFrame:
    """Stores the payloads of docs at path; returns the listing (doc_id, key, n_bytes, digests) of all rows.

    key is the payload's SHA-256. No payload is ever aggregated: of rows with one key the first by doc_id travels to the
    receiver of the key, where what repeats there is passed over in order; beyond that only digests move.
    """
    texts = id_text(docs)

    def list_chunks(it):
        for b in it:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            full = [padded(r) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.sha256(p).digest() for p in full], pa.binary()), pa.array(list(map(len, raw)), pa.int64()), pa.array([[digest(c) for c in chunks(p)] for p in full], pa.list_(pa.binary()))],
                names=["doc_id", "key", "n_bytes", "digests"],
            )

    listing = save(batches(texts).mapInArrow(list_chunks, LISTING), "listing")
    copies = save(listing.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).where("c > 1"), "copies")
    places = listing.select("doc_id", "key", F.posexplode("digests").alias("idx", "digest"))
    at = F.struct("key", "idx")
    owners = places.groupBy("digest").agg(F.count("*").alias("c"), F.min(at).alias("owner"), F.max(at).alias("other")).where("owner != other").drop("other")
    owners = save(owners, "owners")
    shared = meet(places.select("digest", "key", "idx"), owners, ["digest"])
    place = F.struct("idx", "digest", (F.col("owner") == at).alias("own"))
    shared = save(shared.groupBy("key").agg(F.sort_array(F.collect_set(place)).alias("shared")), "shared")  # at most the chunks of one payload

    # Copies stay behind, unless they are too many to name; then those of the most frequent payloads do.
    named = copies if copies.count() <= SMALL else copies.where(F.col("c") * HOT > listing.count())
    chosen = texts.select("doc_id", payload_key(F.col("text")).alias("key"), "text").join(F.broadcast(named.drop("c")), "key", "left")
    chosen = chosen.where("first IS NULL OR doc_id = first").select("key", "text")

    def squeeze(it):
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["key", "packed"])

    def store(it):
        last, z = None, zstandard.ZstdDecompressor()
        for b in it:
            rows = []
            for key, packed, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == last:
                    continue
                last = key
                raw = z.decompress(packed)
                parts = chunks(padded(raw))
                shared = shared or []
                away = {s["idx"] for s in shared}
                rows.append(
                    {
                        "key": key, "n_bytes": len(raw), "head": head_of(parts), "inline": b"".join(p for i, p in enumerate(parts) if i not in away),
                        "owned": [{"digest": s["digest"], "data": parts[s["idx"]]} for s in shared if s["own"]], "shared": [{"idx": s["idx"], "digest": s["digest"]} for s in shared],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=STORE_ARROW)

    n = partitions(docs.sparkSession)
    packed = batches(chosen).mapInArrow(squeeze, "key binary, packed binary").repartition(n, "key")
    full = packed.join(shared, "key", "left").sortWithinPartitions("key").select("key", "packed", "shared")
    batches(full).mapInArrow(store, STORE).write.option("compression", "zstd").parquet(path)
    return listing


STORE_ARROW = pa.schema(
    [
        ("key", pa.binary()), ("n_bytes", pa.int64()), ("head", pa.binary()), ("inline", pa.binary()),
        ("owned", pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))), ("shared", pa.list_(pa.struct([("idx", pa.int32()), ("digest", pa.binary())]))),
    ]
)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and the payload itself. Size and
    digest of the media are those of the stored form, from the columns as they are read back.

    Every chunk is held against its digest and every payload against its key; damage raises an error. Shared chunks come
    to their payload as rows of their own behind its row, so that one payload is held at a time.
    """
    stored = spark.read.schema(STORE).parquet(path)
    wanted = save(stored.select("key", F.explode("shared").alias("s")).select("key", "s.idx", "s.digest"), "wanted")
    often = save(wanted.groupBy("digest").agg(F.count("*").alias("c")), "often")
    owned = stored.select(F.explode("owned").alias("c")).select("c.digest", "c.data")
    is_hot = F.col("c") * FEW_CHUNKS > wanted.count()
    hot = save(owned.join(F.broadcast(often.where(is_hot).select("digest")), "digest"), "hot")  # under FEW_CHUNKS rows
    fetched = wanted.join(F.broadcast(hot), "digest").unionByName(wanted.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(owned, "digest"))
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["payload"] * with_payload
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload

    def rebuild(it):
        """Rows (key, idx, data, head, form_bytes, form_sha256): first, with idx -1, the payload's own, then its shared chunks."""
        held, away = None, {}

        def finish():
            key, inline, head, form_bytes, form_sha = held
            lengths, digests = table_of(head)
            parts, at = [], 0
            for i, n in enumerate(lengths):
                if i in away:
                    parts.append(away[i])
                else:
                    parts.append(inline[at : at + n])
                    at += n
            samples = b"".join(parts)
            sha = hashlib.sha256(samples)
            if sha.digest() != key or [digest(p) for p in parts] != digests:
                raise ValueError(f"damaged payload {key.hex()}")
            row = (key, len(samples), sha.hexdigest(), zlib.crc32(samples[-UNIT:]), form_bytes, form_sha, features(samples, len(parts)))
            return row + (samples,) * with_payload

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

        for b in it:
            rows = []
            for key, idx, data, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if idx >= 0:
                    if held is None or held[0] != key:
                        raise ValueError(f"chunk without payload {key.hex()}")
                    away[idx] = data
                    continue
                if held is not None:
                    rows.append(finish())
                held, away = (key, data, *rest), {}
            yield out(rows)
        if held is not None:
            yield out([finish()])

    form = F.aggregate("owned", F.concat("head", "inline"), lambda a, c: F.concat(a, c["data"]))
    own = stored.select("shared", "key", F.lit(-1).alias("idx"), F.col("inline").alias("data"), "head", F.octet_length(form).cast("long").alias("form_bytes"), F.sha2(form, 256).alias("form_sha256"))
    more = fetched.select("key", "idx", "data", F.lit(None).cast("binary").alias("head"), F.lit(None).cast("long").alias("form_bytes"), F.lit(None).cast("string").alias("form_sha256"))
    plain = own.where(F.size("shared") == 0).drop("shared")
    mixed = own.where(F.size("shared") > 0).drop("shared").unionByName(more).repartition(partitions(spark), "key").sortWithinPartitions("key", "idx")
    kind = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", payload binary" * with_payload
    return batches(plain).mapInArrow(rebuild, kind).unionAll(batches(mixed).mapInArrow(rebuild, kind))


def round_trip(docs: DataFrame) -> DataFrame:
    """write() to a new folder beside the checkpoints, read() and the values of each row of docs.

    Null text is empty; an empty payload is 64 zero bytes. Equal texts are stored once and have equal values; every row
    of docs, repeated ones and null doc_ids too, has a row. An empty table gives none; further columns are ignored.
    """
    path = new_path(docs.sparkSession, "media")
    listing = write(docs, path).select("doc_id", "key", "n_bytes")
    read_back = read(docs.sparkSession, path, with_payload=False)
    often = listing.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") * HOT > listing.count())  # under HOT rows
    values = save(read_back.join(F.broadcast(often), "key", "left").withColumn("c", F.coalesce("c", F.lit(1))), "values")
    return meet(listing, values, ["key"]).drop("key")
