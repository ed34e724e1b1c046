"""Best-fit-decreasing packing of token pieces into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, id_text, save, tidy
from .tokens import word_encoder


#: Parts that the pieces of one length are dealt into; sizes of all parts are at most capacity * SALTS rows.
SALTS = 128


class CapacityTree:
    """Segment tree over remaining capacities 0..top; a leaf says whether an open bin has just that much room left."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = np.zeros(2 * self.size, dtype=bool)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room that is at least need, found in logarithmic time."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing for counts[length] pieces of each length; every run of equal steps is one row of the plan.

    A row (length, rank, per_bin, first_bin, room_used): pieces of that length from that rank on go per_bin to a bin, from
    first_bin on, behind room_used tokens. Bins with equal content are numbered together, so the state is groups of bins.
    Each length opens at most two groups and splits at most one, and a group's room at least halves when it is visited:
    the plan has under 3 * capacity * log2(2 * capacity) rows however many pieces there are.
    """
    tree, rooms, plan, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def add(room: int, first: int, n: int) -> None:
        if n:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, int(counts[length])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = rooms[room].pop()
                tree.set(room, bool(rooms[room]))
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, per, first, capacity - room))
                add(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:  # fewer pieces than a bin of this group takes
                plan.append((length, rank, left, first + full, capacity - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            add(room, first + full, n - full)
    return np.array(plan, dtype=np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Ids of each document with end_id behind them, cut at capacity: doc_id, piece, start, length, ids_crc32."""

    def run(it):
        enc = word_encoder(tokenizer)
        for b in it:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, words in enumerate(enc.encode_all(b.column(1).to_pylist())):
                ids = np.append(words, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return batches(id_text(docs)).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece with its sequence and its place there; the sequences are as few as best-fit decreasing gives.

    The plan is made on the driver from one count per length (at most `capacity` of them), so it is the exact global
    plan for any number of documents. Pieces of one length are interchangeable: each gets a rank among them, from a
    window over (length, salt) and the running counts of the salts, and the plan says where that rank goes.

    Null and empty texts are one piece of the end id. Repeated rows are packed once each; ties of equal length go by
    doc_id within a salt. An empty table gives no rows. Further columns are ignored. A doc_id may be null.
    """
    pieces = save(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sizes = save(sizes.select("length", "salt", "n", before.alias("before")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_plan(counts, capacity)
    keys = plan[:, 0] << 44 | plan[:, 1]
    order = np.argsort(keys)
    plan, keys = plan[order], keys[order]

    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(sizes.drop("n"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))

    def place(it):
        for b in it:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return batches(ranked).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
