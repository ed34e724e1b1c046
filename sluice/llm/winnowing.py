"""Document fingerprints by winnowing: rolling hashes of k-grams, the least of each window, and where it stood."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, partitions
from .token_files import id_bounds

#: Any passage of at least GRAM + WINDOW - 1 characters that two texts share gives them a common hash;
#: a text of 30 or more that keeps three quarters of itself so keeps one at least.
GRAM, WINDOW = 16, 8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
LEAST = -(2**63)


class Powers:
    """BASE**i and BASE**-i modulo 2**64, kept as far as the longest text of up to KEPT characters so far."""

    KEPT = 1 << 20

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def made(n: int) -> list[np.ndarray]:
        out = []
        for factor in (BASE, pow(BASE, -1, 2**64)):
            steps = np.full(n, factor, dtype=np.uint64)
            steps[:1] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        return out

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return tuple(self.made(n))
        if len(self.up) < n:
            self.up, self.down = self.made(min(self.KEPT, max(n, 2 * len(self.up))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams, each in constant time from prefix sums of a polynomial hash."""
    up, down = POWERS.get(len(codes))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes.astype(np.uint64) * up, dtype=np.uint64)])
    h = (sums[k:] - sums[:-k]) * down[: len(codes) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def fingerprint(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing selects: in each window the least hash, of equal ones the rightmost.

    A text of fewer than k characters has itself as its one gram; one of fewer than `window` grams is one window.
    """
    if not text:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = gram_hashes(codes, min(k, len(codes)))
    top = np.uint64(0xFFFFFFFF)
    least = (h << np.uint64(32)) | (top - np.arange(len(h), dtype=np.uint64))
    span, window = 1, min(window, len(h))
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype("<u4"), (top - (chosen & top)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes (sorted, distinct); of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Base64 of (hash, position) pairs of unsigned 32-bit little-endian integers, in order of position."""
    return base64.b64encode(np.stack([hashes, positions], axis=1).astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes array<long>, positions array<int>; null and empty texts have none."""

    def run(it):
        for b in it:
            texts = b.column(1).to_pylist()
            found = [fingerprint(t, k, window) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))], names=["doc_id", "n_chars", "hashes", "positions"])

    return batches(id_text(docs)).mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<int>")


def edited_likeness(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the query's contract.

    The order over doc_ids needs no window over the whole table: ranges of doc_id, one a partition, are each sorted, and
    the first document of a range is sent to the range before it as well (that of the first range to the last).

    Null text is empty. Null doc_ids come first; rows of one doc_id follow in order of text. A lone document is its own
    successor. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = id_text(docs)
    n = partitions(spark)
    bounds = id_bounds(docs, n)

    def ranges(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        key = ids.fill_null(LEAST).to_numpy(zero_copy_only=False)
        return key, np.searchsorted(bounds, key, side="right")

    def least(it):
        for b in it:
            key, at = ranges(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(key)], names=["at", "key"])

    firsts = {r["at"]: r["key"] for r in docs.select("doc_id").mapInArrow(least, "at int, key long").groupBy("at").agg(F.min("key").alias("key")).collect()}  # a row a range
    filled = sorted(firsts)
    before = {firsts[r]: filled[i - 1] for i, r in enumerate(filled)}
    heads = np.array(sorted(before), dtype=np.int64)

    def deal(it):
        for b in it:
            key, at = ranges(b.column(0))
            extra = np.flatnonzero(np.isin(key, heads))
            rows = pa.array(np.concatenate([np.arange(len(key)), extra]))
            to = np.concatenate([at, [before[key[i]] for i in extra]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.arange(len(to)) >= len(key)), b.column(0).take(rows), b.column(1).take(rows)], names=["at", "beyond", "doc_id", "text"])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(it):
        held, over = None, False
        for b in it:
            out = []
            for beyond, doc_id, text in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if over:
                    continue
                own = fingerprint(text, k, window)
                mine = np.unique(own[0])
                if held is not None:
                    last_id, last, last_own, last_set = held
                    cut = len(last) // 4
                    edited = last[: len(last) - cut] + text[:cut]
                    other = fingerprint(edited, k, window)
                    out.append((last_id, len(last), hashlib.sha256(edited.encode()).hexdigest(), as_string(*last_own), as_string(*other), likeness(last_set, np.unique(other[0])), likeness(last_set, mine)))
                held, over = (doc_id, text, own, mine), beyond
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    dealt = batches(docs).mapInArrow(deal, "at int, beyond boolean, doc_id long, text string").repartitionById(n, F.col("at"))
    ordered = dealt.sortWithinPartitions("beyond", F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
