"""Token ids in a compact table of blocks: canonical length-limited Huffman codes from counts over the whole input.

Format. A table (Parquet) of blocks, one row each, independent of each other:
  shard int, block int   shards ascend in doc_id, blocks ascend within a shard
  first long             ids of the shard before this block
  docs array<long>       documents of the block, ascending, each one whole
  counts array<int>      ids of each document
  checks binary          unsigned 32-bit little-endian bit offsets, one for every STRIDE ids of each document, each
                         document beginning anew
  bits binary            the codes, highest bit first, each document padded to whole bytes
  crc long               CRC-32 of bits
and beside it a table of (id, length, n): the code lengths, from which the canonical codes follow, and the counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, id_text, new_path, partitions, save
from .tokens import word_encoder

LIMIT, STRIDE, BLOCK_IDS = 16, 64, 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    weights, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        weights = both[by]
        is_leaf.append(by < len(leaves))
    take = 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    code, last = 0, 0
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next LIMIT bits: the id that begins there, and its length."""
    ids, size = np.zeros(1 << LIMIT, dtype=np.uint16), np.ones(1 << LIMIT, dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (LIMIT - lengths[order])
    end = int(spans.sum())
    ids[:end], size[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, size


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of a document padded to bytes, and the bit offset of every STRIDE-th id."""
    n = lengths[ids]
    ends = np.cumsum(n)
    starts = ends - n
    out = np.zeros(int(ends[-1] + 7) // 8 + 2 if len(ids) else 0)
    value, at = codes[ids] << (24 - n - (starts & 7)), starts >> 3
    for k in range(3):
        out[: len(out)] += np.bincount(at + k, weights=(value >> (16 - 8 * k)) & 255, minlength=len(out))[: len(out)] if len(ids) else 0
    return out.astype(np.uint8)[: int(ends[-1] + 7) // 8 if len(ids) else 0].tobytes(), starts[::STRIDE].astype("<u4")


def unpack_bits(bits: bytes, at: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Decodes lanes of n ids from bit offsets at, all lanes in step; the ids one lane after another."""
    ids, size = table
    data = np.frombuffer(bits + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    words = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    at, out = at.astype(np.int64), np.zeros((len(at), STRIDE), dtype=np.uint16)
    for k in range(int(n.max(initial=0))):
        here = np.minimum(at, 8 * len(bits))
        code = (words[here >> 3] >> (8 - (here & 7))) & 0xFFFF
        out[:, k] = ids[code]
        at = at + size[code]
    return out[np.arange(STRIDE) < n[:, None]]


def id_bounds(df: DataFrame, n: int) -> np.ndarray:
    """About n - 1 doc_ids that divide the rows into equal ranges, from a sketch of the column over all rows."""
    marks = df.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return np.unique(np.array(marks, dtype=np.int64))


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def run(it):
        enc = word_encoder(tokenizer)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.append(x, end_id).astype("<u2").tobytes() for x in enc.encode_all(b.column(1).to_pylist())], pa.binary())], names=["doc_id", "ids"])

    return batches(id_text(docs)).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all rows; the result has at most 65,536 rows whatever the input."""

    def run(it):
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in it:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Writes the blocks to path/blocks and the code to path/code.

    Null and empty texts are the end id alone. Null doc_ids come first; repeated doc_ids lie side by side. An empty
    table gives an empty file that read() takes. Further columns are ignored. A document whose codes take 512 MB or more
    does not fit a block and raises.
    """
    spark = docs.sparkSession
    tokens = save(tokenize(docs, tokenizer, end_id), "ids")
    counts = count_ids(tokens)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    rows = [(int(i), int(lengths[i]), int(counts[i])) for i in used]
    spark.createDataFrame(rows, "id int, length int, n long").coalesce(1).write.parquet(f"{path}/code")
    shards = partitions(spark)
    bounds = id_bounds(tokens, shards)

    def encode(it):
        for b in it:
            packed = [pack_bits(np.frombuffer(x, dtype="<u2"), codes, lengths) for x in b.column(1).to_pylist()]
            n = [len(x) // 2 for x in b.column(1).to_pylist()]
            shard = [0 if d is None else int(np.searchsorted(bounds, d, side="right")) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column(0), pa.array(n, pa.int32()), pa.array([c.tobytes() for _, c in packed], pa.binary()), pa.array([x for x, _ in packed], pa.binary())], names=["shard", "doc_id", "n", "checks", "bits"])

    def gather(it):
        """Rows of one shard in order, to blocks."""
        held, ids, first, block, shard = [], 0, 0, 0, 0

        def flush():
            checks, base = [], 0
            for _, _, c, x in held:
                checks.append(np.frombuffer(c, dtype="<u4") + np.uint32(8 * base))
                base += len(x)
            if base >= 1 << 29:
                raise ValueError(f"bit offsets of a block from document {held[0][0]} on do not fit 32 bits")
            bits = b"".join(x for *_, x in held)
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([[d for d, *_ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, *_ in held]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate(checks).astype("<u4").tobytes()], pa.binary()), pa.array([bits], pa.binary()), pa.array([zlib.crc32(bits)], pa.int64())], names=["shard", "block", "first", "docs", "counts", "checks", "bits", "crc"])

        for b in it:
            for s, d, n, c, x in zip(*(col.to_pylist() for col in b.columns), strict=True):
                shard = s
                held.append((d, n, c, x))
                ids += n
                if ids >= BLOCK_IDS:
                    yield flush()
                    held, first, block, ids = [], first + ids, block + 1, 0
        if held:
            yield flush()

    coded = batches(tokens).mapInArrow(encode, "shard int, doc_id long, n int, checks binary, bits binary")
    sorted_ = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "n", F.crc32("bits"))
    sorted_.mapInArrow(gather, "shard int, block int, first long, docs array<long>, counts array<int>, checks binary, bits binary, crc long").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids (little-endian unsigned 32-bit)."""
    code = spark.read.parquet(f"{path}/code").collect()  # at most 65,536 rows
    lengths = np.zeros(1 << 16, dtype=np.int64)
    for r in code:
        lengths[r["id"]] = r["length"]
    table = decode_table(lengths, canonical(lengths))
    blocks = spark.read.schema("shard int, block int, first long, docs array<long>, counts array<int>, checks binary, bits binary, crc long").parquet(f"{path}/blocks")
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}  # a row a shard
    base, before = {}, 0
    for s in sorted(totals):
        base[s] = before
        before += totals[s]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(it):
        for b in it:
            for r in b.to_pylist():
                if zlib.crc32(r["bits"]) != r["crc"]:
                    raise ValueError(f"damaged block {r['shard']}/{r['block']}")
                n = np.array(r["counts"], dtype=np.int64)
                lanes = -(-n // STRIDE)
                last = np.cumsum(lanes) - 1
                take = np.full(int(lanes.sum()), STRIDE, dtype=np.int64)
                take[last] = n - (lanes - 1) * STRIDE
                ids = unpack_bits(r["bits"], np.frombuffer(r["checks"], dtype="<u4"), take, table).astype("<u4")
                ends = np.cumsum(n)
                each = [ids[e - k : e] for e, k in zip(ends, n, strict=True)]
                columns = [pa.array(r["docs"], pa.int64()), pa.array(base[r["shard"]] + r["first"] + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes() for x in each], pa.binary())] * with_ids, names=names)

    return batches(blocks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """write() to a new folder beside the checkpoints, then read()."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, with_ids=False)
