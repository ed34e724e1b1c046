"""Periodic runs of words: stretches that repeat themselves, found from Lyndon words without a suffix array.

In one of two opposite orders of the words, every run holds a Lyndon word as long as its period that is the longest one at
its place. So texts are scanned from right to left under both orders, with a stack of longest Lyndon words whose heads are
compared, and each of these words is extended to both sides. Long comparisons are halved by rolling hashes; what hashes
say is then verified word by word, so that results never rest on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, tidy

PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E681 % PRIME
#: Words that are compared one by one before hashes are asked.
NEAR = 8
#: Texts that are scanned as one row of words hold about so many bytes in all; a longer text is a row of its own.
ROW_BYTES = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    a, b = np.asarray(a, dtype=np.uint64), np.asarray(b, dtype=np.uint64)
    u = np.uint64
    a1, a0, b1, b0 = a >> u(31), a & u(0x7FFFFFFF), b >> u(31), b & u(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    total = ((a1 * b1) << u(1)) + (mid >> u(30)) + ((mid & u(0x3FFFFFFF)) << u(31)) + a0 * b0
    total = (total & u(PRIME)) + (total >> u(61))
    return np.where(total >= u(PRIME), total - u(PRIME), total)


def powers(n: int) -> np.ndarray:
    """BASE**0 to BASE**(n - 1) modulo PRIME, doubled until there are enough."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, pow(BASE, len(out), PRIME))])
    return out[:n]


def running(x: np.ndarray) -> np.ndarray:
    """0 and the sums of x up to each place, modulo PRIME, added over doubled distances so that none exceeds 64 bits."""
    block = 4  # numbers below 2**61: so many fit
    pad = -len(x) % block
    rows = np.concatenate([x, np.zeros(pad, dtype=np.uint64)]).reshape(-1, block)
    inner = np.cumsum(rows, axis=1, dtype=np.uint64) % np.uint64(PRIME)
    if len(rows) > 1:
        before = running(inner[:, -1])[:-1]
        inner = (inner + before[:, None]) % np.uint64(PRIME)
    return np.concatenate([np.zeros(1, dtype=np.uint64), inner.reshape(-1)[: len(x)]])


class Row:
    """Words as numbers from 0 up, with -1 behind each text, and common extensions of two places of one text."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.up = powers(self.n)
        self.sums = running(times((ids + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7) % np.uint64(PRIME), self.up))
        self.lists = None
        self.proved: dict[int, tuple[int, int]] = {}

    def same(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the hashes of m words from i < j on are equal."""
        p = np.uint64(PRIME)
        left, right = (self.sums[i + m] + p - self.sums[i]) % p, (self.sums[j + m] + p - self.sums[j]) % p
        return times(left, self.up[j - i]) == right

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j > i on are equal, by their hashes."""
        low, high = np.zeros(len(i), dtype=np.int64), self.n - j
        while (open_ := low < high).any():
            m = (low + high + 1) // 2
            good = self.same(i, j, m)
            low, high = np.where(open_ & good, m, low), np.where(open_ & ~good, m - 1, high)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j > i are equal, by their hashes."""
        low, high = np.zeros(len(i), dtype=np.int64), i.copy()
        while (open_ := low < high).any():
            m = (low + high + 1) // 2
            good = self.same(i - m, j - m, m)
            low, high = np.where(open_ & good, m, low), np.where(open_ & ~good, m - 1, high)
        return low

    def extension(self, i: int, j: int) -> int:
        """How many words from i and j > i on are equal. Verified: word t equals word t + p throughout, where of what was
        verified for this p = j - i before only the rest is looked at."""
        if self.lists is None:
            self.lists = self.sums.tolist(), self.up.tolist()
        sums, up = self.lists
        p, si, sj = j - i, sums[i], sums[j]
        factor, step, most = up[p], NEAR, self.n - j
        low = 0
        while True:  # galloping, then halving
            m = min(step, most)
            if ((sums[i + m] - si) * factor - sums[j + m] + sj) % PRIME:
                high = m - 1
                break
            low = m
            if m == most:
                high = m
                break
            step *= 2
        while low < high:
            m = (low + high + 1) // 2
            if ((sums[i + m] - si) * factor - sums[j + m] + sj) % PRIME:
                high = m - 1
            else:
                low = m
        start, end = self.proved.get(p, (0, 0))
        known = start <= i + low <= end
        stop = max(i, min(start, i + low)) if known else i + low
        if stop > i and not np.array_equal(self.ids[i:stop], self.ids[j : j + stop - i]):  # hashes were equal by chance
            low = int((self.ids[i:stop] != self.ids[j : j + stop - i]).argmax())
            known = False
        self.proved[p] = (min(i, start), end) if known else (i, i + low)
        return low

    def lyndon_ends(self, words: list[int], rises: np.ndarray) -> list[int]:
        """The end of the longest Lyndon word at each place, in the order of these numbers, where -1 is least: the next
        place at which a lesser suffix begins. `rises` names the places whose word is not above the next one."""
        ends = list(range(1, self.n + 1))
        for i in rises[::-1].tolist():
            x, j = words[i], i + 1
            while True:
                y = words[j]
                if x < y:
                    j = ends[j]
                    continue
                if x > y:
                    break
                k = 1
                while k < NEAR and words[i + k] == words[j + k]:
                    k += 1
                if k == NEAR:
                    k = self.extension(i, j)
                if words[i + k] > words[j + k]:
                    break
                j = ends[j]
            ends[i] = j
        return ends

    def runs(self, least: int, exponent: int) -> np.ndarray:
        """(start, end, period) of all runs of at least `least` words and `exponent` periods, sorted."""
        found, ids = [], self.ids
        word = np.flatnonzero(ids[:-1] >= 0)
        top = ids.max(initial=0)
        for numbers in (ids, np.where(ids < 0, -1, top - ids)):
            self.proved.clear()
            rises = word[numbers[word] <= numbers[word + 1]]
            ends = np.array(self.lyndon_ends([*numbers.tolist(), *[-1] * NEAR], rises), dtype=np.int64)
            i, j = word, ends[word]
            if exponent >= 3:  # then some word of the run that begins after its first is followed by itself
                likely = (ids[i] == ids[np.minimum(j, self.n - 1)]) & (2 * j - i <= self.n)
                i, j = i[likely], j[likely]
                likely = self.same(i, j, j - i)
                i, j = i[likely], j[likely]
            found.append((i, j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(i):
            return np.zeros((0, 3), dtype=np.int64)
        start, end = i - self.behind(i, j), j + self.ahead(i, j)
        claims = np.unique(np.stack([start, end, j - i, i], axis=1), axis=0)
        first = np.concatenate([[True], (claims[1:, :3] != claims[:-1, :3]).any(axis=1)])
        out = set()
        for (a, b, p), head in zip(claims[first, :3].tolist(), claims[first, 3].tolist(), strict=True):
            if b - a >= max(least, exponent * p):
                out.add((*self.verified(a, b, p, head), p))
        kept = np.array([r for r in out if r[1] - r[0] >= max(least, exponent * r[2])], dtype=np.int64).reshape(-1, 3)
        return kept[np.lexsort((kept[:, 2], kept[:, 0]))]

    def verified(self, a: int, b: int, p: int, head: int) -> tuple[int, int]:
        """Start and end of the run of period p about the word at head, from a to b if the hashes were right."""
        unlike = np.flatnonzero(self.ids[a : b - p] != self.ids[a + p : b]) + a
        low, high = unlike[unlike < head], unlike[unlike >= head]
        return (int(low[-1]) + 1 if len(low) else a), (int(high[0]) + p if len(high) else b)


def rows_of(texts: list[str]):
    """The texts in groups of about ROW_BYTES."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= ROW_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def of_texts(texts: list[str], least: int, exponent: int) -> tuple[list[int], list[np.ndarray], list[str]]:
    """Of each text the number of its words, its runs as (start, length, period), and the words that no run repeats."""
    counts, runs, kept = [], [], []
    for group in rows_of(texts):
        words: list[bytes] = []
        sizes = []
        for t in group:
            # of bytes, split() knows exactly the separators 0x20 and 0x09 to 0x0D
            cut = t.encode("utf-8", "surrogatepass").split()
            sizes.append(len(cut))
            words += cut
            words.append(b"")
        names = dict.fromkeys(words)
        names.pop(b"")
        for number, name in enumerate(names):
            names[name] = number
        names[b""] = -1
        row = Row(np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words)))
        found = row.runs(least, exponent)
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(drop, found[:, 0] + found[:, 2], 1)
        np.add.at(drop, found[:, 1], -1)
        drop = np.cumsum(drop) > 0
        ends = np.cumsum(np.array(sizes) + 1) - 1
        bounds = np.searchsorted(found[:, 0], np.concatenate([[0], ends]))
        at = 0
        for k, end in enumerate(ends.tolist()):
            mine = found[bounds[k] : bounds[k + 1]]
            text = words[at:end]
            if len(mine):
                text = [text[i] for i in np.flatnonzero(~drop[at:end]).tolist()]
            runs.append(np.stack([mine[:, 0] - at, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1))
            kept.append(b" ".join(text).decode("utf-8", "surrogatepass"))
            counts.append(sizes[k])
            at = end + 1
    return counts, runs, kept


def find(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words left, joined by spaces).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of words with smallest period p of at least `least`
    words and `exponent` (2 or more) times p that no neighbouring word extends keeping period p. A word is left out if a run
    has it after its first p words.

    Every text is scanned whole by one task, which needs some 200 bytes a word meanwhile; nothing is shuffled. Null and
    empty texts, and those of white space alone, have no words and no runs, and collapse to nothing. Rows are documents of
    their own: null and repeated doc_ids stay as they are. An empty table gives no rows; further columns are ignored.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(it):
        for b in it:
            counts, runs, kept = of_texts(b.column(1).to_pylist(), least, exponent)
            flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *runs])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            entries = pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, entries), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return batches(id_text(docs)).mapInArrow(tidy(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the CRC-32 of the decimal doc_id and g = floor(h / 10), every text whose h % 10 is 0 repeats
    p = 1 + floor((n - a) / (3 + g % 8)) of its n words from word a = g % n on. Null doc_ids and texts without words stay."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = id_text(docs).withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    cut = cut.withColumn("n", F.size("words")).where("true").withColumn("g", F.expr("h div 10"))
    cut = cut.withColumn("a", F.expr("if(n > 0, g % n, 0)").cast("int"))
    cut = cut.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    loop = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p AS int))), 1, n - a))")
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """Of the result of find(): doc_id, n_runs, the longest run (ties: least start, then period; none: nulls) with its
    exponent in thousandths, and SHA-256 of the list of runs and of the collapsed text."""

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))

    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    ranked = runs.select("*", best.alias("best"))
    return ranked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
