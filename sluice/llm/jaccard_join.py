"""Exact n-gram Jaccard join by partitioning the universe of shingles.

Two sets x, y of Jaccard similarity s or more differ in at most H = (1 - s) / (1 + s) * (|x| + |y|) shingles. Hash the
shingles into m = H + 1 segments: at least one segment has equal subsets in both. Sizes are put into bands, each with its
own H and segments; neighbouring bands meet in a space of their own. Documents with an equal subset are candidates.

Cost. A subset costs by how many documents have it; the empty one, which unrelated documents share most, gets no key
(allocation 0). What that takes from the bound is given to one-deletion neighbourhoods of subsets of two elements or more
(allocation 2), whose keys then hold at least one. With e segments empty in both and none equal beside them, the other
H + 1 - e hold at most H differences and at least one each, so all but e - 1 hold exactly one. A document with E empty
segments indexes the neighbourhoods of its segments up to the E-th that has two elements or more. Of two similar documents
take the one that stops first: up to there both index, and as e <= E, one of its segments of two elements or more holds
exactly one difference, so that neighbourhoods meet. Documents with fewer such segments than empty ones (sets of a few
shingles, of odd hashes) index all segments and share one key among themselves.

Groups. Each document is compared with the first of all it shares a key with; links found make components; then only
pairs of different components are left. The documents of a key are held against each other where they are, by sketches
of counts that bound their difference from below, and only pairs that sketches leave open go on to be compared whole.
Keys with more than CROWD documents of several components are not paired: their documents are joined by their rarest
shingles instead (any similar pair shares one among the first |x| - ceil(s|x|) + 1).

Shingles are 64-bit hashes; sets are compared whole, so results are exact but for hash collisions within a pair.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back, partitions, save, tidy
from .components import joined, roots
from .winnowing import POWERS

#: Documents of one key that are held against each other where they are: about a second of work for so many.
CROWD = 8_000
#: Cells of the sketch that pairs are held against each other by, and of its coarse form.
SKETCH, COARSE = 256, 32
#: Bytes of sets that a block of documents has at most, on average.
BLOCK_BYTES = 16 << 20
#: Ids of copies that are broadcast; more of them are shuffled.
MOST_COPIES = 1_000_000
TAG_EXACT, TAG_NEAR, TAG_FEW = 1, 2, 3


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def blank() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    return table


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of so many words; of the whole sequence where there are fewer."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    gap = blank()[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = POWERS.get(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    w = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h))


def sketch(x: np.ndarray) -> bytes:
    """How many elements hash into each of the cells, up to 255, and the size. The sum of differences of the cells of two
    sets is at most their symmetric difference."""
    return np.minimum(np.bincount((x >> np.uint64(11)) % np.uint64(SKETCH), minlength=SKETCH), 255).astype(np.uint8).tobytes() + len(x).to_bytes(8, "little")


class Similarity:
    """At least num/den. Bands of sizes grow by 1.4, or as far as the greatest partner of their least size."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] * den // num + 1, self.low[-1] * 7 // 5))

    def most(self, total: int) -> int:
        """A bound on the symmetric difference of two similar sets of at most `total` elements together."""
        return total * (self.den - self.num) // (self.num + self.den)

    def spaces(self, n: int) -> list[tuple[int, int]]:
        """(space, segments) that a set of n elements is in: 2b for its band, odd ones for two neighbouring bands."""
        b = bisect_right(self.low, n) - 1
        out = [(2 * b, self.most(2 * (self.low[b + 1] - 1)) + 1)]
        for low in (b - 1, b):  # the small side from band `low`, the large one from the next
            top = self.low[low + 1] - 1
            far = top * self.den // self.num  # the largest partner
            if low >= 0 and far > top and (n * self.den // self.num > top if low == b else n <= far):
                out.append((2 * low + 1, self.most(top + far) + 1))
        return out

    def possible(self, a: bytes, b: bytes) -> bool:
        """Whether two sketches leave it open that their sets are similar."""
        (p, m), (q, n) = ((np.frombuffer(s, np.uint8, SKETCH).astype(np.int16), int.from_bytes(s[SKETCH:], "little")) for s in (a, b))
        return min(m, n) * self.den >= self.num * max(m, n) and int(np.abs(p - q).sum()) <= self.most(m + n)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * self.den < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both * self.den >= self.num * (len(a) + len(b) - both)


def keys(x: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Index keys of a set: any two similar, unequal sets share one. A subset's key is made from the sum of its hashes,
    so that of the subset without an element takes one subtraction."""
    out = []
    token = mix(x ^ np.uint64(0x5851F42D4C957F2D))
    for space, m in similarity.spaces(len(x)):
        seg = ((x ^ (x >> np.uint64(29))) * np.uint64(2 * space + 0x9E3779B97F4A7C15) >> np.uint64(33)) * np.uint64(m) >> np.uint64(31)
        seg = seg.astype(np.int64)
        size = np.bincount(seg, minlength=m)
        order = np.argsort(seg, kind="stable")
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token[order], dtype=np.uint64)])
        ends = np.cumsum(size)
        sums = running[ends] - running[ends - size]

        def key(i, total, n, tag, space=space):
            return mix(mix(total + (i * 4 + tag).astype(np.uint64)) + (n * 1024 + space).astype(np.uint64))

        full = np.flatnonzero(size)
        out.append(key(full, sums[full], size[full], TAG_EXACT))
        empty = m - len(full)
        if empty:
            large = np.flatnonzero(size > 1)
            stop = large[empty - 1] + 1 if len(large) >= empty else m
            near = full[full < stop]
            mine = (seg < stop) & (size[seg] > 1)
            out += [key(near, sums[near], size[near], TAG_NEAR), key(seg[mine], sums[seg[mine]] - token[mine], size[seg[mine]] - 1, TAG_NEAR)]
            if len(large) < empty:
                out.append(mix(np.array([space * 8 + TAG_FEW], dtype=np.uint64)))
    return np.unique(np.concatenate(out))


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit numbers, byte by byte: all first bytes, all second bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def from_planes(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    full = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    full[:, :width] = rows.T
    return full.view("<u8").ravel()


def repeated(key: np.ndarray) -> np.ndarray:
    """Where the values that occur more than once stand."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(key) else order


def deal(df: DataFrame, found, n: int) -> DataFrame:
    """Keys of each row (doc_id, text) as found(text) gives them, brought together by key; rows (run, doc_id) for the keys
    of two or more documents. Keys of one batch travel as one blob per receiver, 48 bits of each: a false candidate
    costs a comparison. Of several keys of one receiver with the same documents one is enough."""

    def send(it):
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = [found(t) for t in b.column(1).to_pylist()]
            key = np.concatenate([*lists, np.zeros(0, np.uint64)]) & np.uint64((1 << 48) - 1)
            doc = np.repeat(ids, [len(x) for x in lists])
            to = (key % np.uint64(n)).astype(np.int64)
            order = np.argsort(to << 48 | key.astype(np.int64)) if n < 1 << 15 else np.lexsort((key, to))
            key, doc, to = key[order], doc[order], to[order]
            cut = np.searchsorted(to, np.arange(n + 1))
            some = [i for i in range(n) if cut[i] < cut[i + 1]]
            columns = [pa.array([planes(x[cut[i] : cut[i + 1]], width) for i in some], pa.binary()) for x, width in ((key, 6), (doc.astype(np.int64), 8))]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], names=["to", "keys", "docs"])

    def meet(it):
        key, doc = [], []
        for b in it:
            key += [from_planes(x, 6) for x in b.column(1).to_pylist()]
            doc += [from_planes(x, 8).view(np.int64) for x in b.column(2).to_pylist()]
        if key:
            key, doc = np.concatenate(key), np.concatenate(doc)
            several = repeated(key)
            key, doc = key[several], doc[several]
            if not len(key):
                return
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc = key[new], doc[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            sign = np.add.reduceat(mix(doc.astype(np.uint64) + np.uint64(77)), start) + size.astype(np.uint64)
            _, first = np.unique(np.where(size > 1, sign, 0), return_index=True)
            first = first[size[first] > 1]
            ends = np.cumsum(size[first])
            rows = np.repeat(start[first] - ends + size[first], size[first]) + np.arange(ends[-1] if len(ends) else 0)
            run = np.repeat(key[start[first]].astype(np.int64), size[first])
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(run[at : at + 50_000]), pa.array(doc[rows[at : at + 50_000]])], names=["run", "doc_id"])
            del key, doc, rows, run, several, order, new, start, size, sign, first, ends
            give_back()

    return batches(df).mapInArrow(tidy(send), "to int, keys binary, docs binary").repartitionById(n, F.col("to")).mapInArrow(meet, "run long, doc_id long")


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links of similarity num/den or more reach.

    Null, empty and blank texts have no shingles and are linked with nothing, not even each other. Rows of one doc_id
    are one document: linked if any of them is. A null doc_id has a null component. An empty table gives no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    similarity = Similarity(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(it):
        for b in it:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            marks = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([sketch(x) for x in sets], pa.binary())], names=["doc_id", "n_shingles", "mark", "sketch"])

    every = save(batches(docs).mapInArrow(tidy(describe), "doc_id long, n_shingles long, mark binary, sketch binary"), "sets")
    real = every.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    marks = real.groupBy("mark").agg(F.min("doc_id").alias("node"))
    nodes = save(real.select("doc_id", "mark").distinct().join(marks, "mark").select("doc_id", "node"), "nodes")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def found(text):
        x = shingles(text, words)
        return keys(x, similarity) if len(x) else x

    # Copies are known by their sets; of each set one document looks for others.
    copies = nodes.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("node")).alias("copy")).where("copy").select("doc_id")
    copies = save(copies, "copies")
    firsts = texts.join(F.broadcast(copies) if copies.count() <= MOST_COPIES else copies, "doc_id", "left_anti")
    members = save(deal(firsts, found, n).withColumnRenamed("doc_id", "node"), "members")
    proof = Proof(texts, real.select("doc_id", "sketch"), words, similarity)

    links = nodes.where("doc_id != node").selectExpr("doc_id AS a", "node AS b")
    # Each copy has its first document above it, each other document the first that it is linked with.
    links = save(links.unionAll(first_links(members, proof).selectExpr("b AS a", "a AS b")), "links")
    labels = joined(roots(links), links)
    left = save(of_several(members, labels), "rest")
    more = proof.links(across(left.where(F.col("n") <= crowd), proof))
    crowded = left.where(F.col("n") > crowd).select(F.col("node").alias("doc_id")).distinct()
    if not crowded.isEmpty():
        more = more.unionAll(by_rarest(save(crowded, "crowded"), labels, proof))
    labels = joined(labels, save(more, "links"))
    return every.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def with_sketches(members: DataFrame, proof: Proof, *columns: str) -> DataFrame:
    """Members with their sketches, those of one run in one task and in order of node."""
    full = members.join(proof.each.withColumnRenamed("doc_id", "node"), "node").select("run", "node", *columns, "sketch")
    return batches(full.repartition(partitions(full.sparkSession), "run").sortWithinPartitions("run", "node"))


def first_links(members: DataFrame, proof: Proof) -> DataFrame:
    """Each document against the first of those that it shares a key with and may be similar to. Runs are gone through in
    order; no more than the first document of one is held."""
    similarity = proof.similarity

    def run(it):
        now, first, held = None, None, []
        for b in it:
            found = []
            for r, node, sketch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != now:
                    now, first, held = r, node, []
                if node == first:
                    held.append(sketch)
                elif any(similarity.possible(x, sketch) for x in held):
                    found.append((first, node))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    pairs = with_sketches(members, proof).mapInArrow(tidy(run), "a long, b long")
    return proof.links(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))


def of_several(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their components and the size of the run, of runs with several components."""
    named = members.join(labels.withColumnsRenamed({"doc_id": "node"}), "node", "left").select("run", "node", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("run").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least != most")
    return named.join(several.select("run", "n"), "run")


def across(members: DataFrame, proof: Proof) -> DataFrame:
    """Pairs (a, b) of different components within a run that their sketches leave open."""
    similarity = proof.similarity

    def pairs(node, label, size, cells):
        """By size, each with those that are not too large for it: coarse sketches first, whole ones of what these leave."""
        order = np.argsort(size, kind="stable")
        node, label, size, cells = node[order], label[order], size[order], cells[order]
        coarse = cells.reshape(len(cells), COARSE, -1).sum(axis=2, dtype=np.int16)
        ends = np.searchsorted(size, size * similarity.den // similarity.num, side="right")
        for i in range(0, len(node) - 1):
            most = similarity.most(size[i] + size[i + 1 : ends[i]])
            j = np.flatnonzero(np.abs(coarse[i + 1 : ends[i]] - coarse[i]).sum(axis=1, dtype=np.int64) <= most)
            j, most = j + i + 1, most[j]
            j = j[(np.abs(cells[j] - cells[i]).sum(axis=1, dtype=np.int64) <= most) & (label[j] != label[i])]
            yield np.minimum(node[j], node[i]), np.maximum(node[j], node[i])

    def run(it):
        held, last = [], None

        def flush():
            node, label, cells = zip(*held, strict=True)
            size = np.array([int.from_bytes(c[SKETCH:], "little") for c in cells])
            cells = np.frombuffer(b"".join(c[:SKETCH] for c in cells), np.uint8).reshape(-1, SKETCH).astype(np.int16)
            return list(pairs(np.array(node), np.array(label), size, cells))

        def out(found):
            both = np.array([np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1)], dtype=np.int64)
            both = np.unique(both, axis=1)  # a pair meets under many keys
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["a", "b"])

        found, n = [], 0
        for b in it:
            for r, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != last and held:
                    more = flush()
                    found, n, held = found + more, n + sum(len(f[0]) for f in more), []
                last = r
                held.append(row)
            if n > 1 << 20:
                yield out(found)
                found, n = [], 0
        yield out(found + (flush() if held else []))

    return with_sketches(members, proof, "label").mapInArrow(tidy(run), "a long, b long").distinct()


class Proof:
    """Decides which pairs (a, b) are linked; sets are made of the texts of these only."""

    def __init__(self, texts: DataFrame, each: DataFrame, words: int, similarity: Similarity):
        self.texts, self.words, self.similarity = texts, words, similarity
        self.each = each  # a row for each text
        self.sets: DataFrame | None = None

    def need(self, ids: DataFrame) -> DataFrame:
        """The sets of at least these documents (doc_id)."""
        words = self.words

        def run(it):
            for b in it:
                found = [shingles(t, words).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "bytes", "elements"])

        ids = ids.distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc_id"), "doc_id", "left_anti")
        ids = save(ids, "wanted")
        if self.sets is None or not ids.isEmpty():
            made = save(batches(self.texts.join(ids, "doc_id").select("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, bytes long, elements binary"), "elements")
            self.sets = made if self.sets is None else self.sets.unionAll(made)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked. Documents are dealt into blocks, and a pair of blocks is one group: it gets each set
        that any of its pairs needs once, so that many pairs of few long documents do not each bring their sets."""
        similarity = self.similarity
        pairs = save(pairs, "pairs")
        sets = self.need(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
        n = partitions(pairs.sparkSession)
        total = sets.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        blocks = max(math.ceil(math.sqrt(n)), -(-total // BLOCK_BYTES))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        dealt = pairs.select((block("a") * blocks + block("b")).alias("group"), "a", "b")
        needed = dealt.select("group", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(sets.select("doc_id", "elements"), "doc_id")
        needed = needed.select("group", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "elements")
        rows = needed.unionByName(dealt.select("group", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("elements")))

        def run(it):
            group, held, cells = None, {}, {}

            def counts(d, i, size):
                """How many elements hash into each of so many cells."""
                if (d, i, size) not in cells:
                    cells[d, i, size] = np.bincount((held[d][i] >> np.uint64(11)).astype(np.int64) & (size - 1), minlength=size).astype(np.int32)
                return cells[d, i, size]

            def linked(a, b):
                for i, x in enumerate(held[a]):
                    for j, y in enumerate(held[b]):
                        size = 1 << max(len(x), len(y), 1).bit_length()
                        if np.abs(counts(a, i, size) - counts(b, j, size)).sum() <= similarity.most(len(x) + len(y)) and similarity.linked(x, y):
                            return True
                return False

            for batch in it:
                found = []
                for g, kind, a, b, elements in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if g != group:
                        group, held, cells = g, {}, {}
                    if kind == 0:
                        held.setdefault(a, []).append(np.frombuffer(elements, np.uint64))
                    elif linked(a, b):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        sorted_ = rows.repartition(n, "group").sortWithinPartitions("group", "kind", "a")
        return save(batches(sorted_).mapInArrow(tidy(run), "a long, b long").distinct(), "links")


def by_rarest(crowded: DataFrame, labels: DataFrame, proof: Proof) -> DataFrame:
    """Links between documents of crowded keys, by the shingles of theirs that fewest of them have."""
    own = proof.need(crowded).join(crowded, "doc_id")

    def spread(it):
        for b in it:
            for d, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(e, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d)), pa.array(np.full(len(x), len(x), dtype=np.int64)), pa.array(x)], names=["doc_id", "size", "shingle"])

    flat = save(batches(own.select("doc_id", "elements")).mapInArrow(spread, "doc_id long, size long, shingle long"), "flat")
    often = flat.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = flat.join(often, "shingle").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    similarity = proof.similarity
    prefix = F.slice("all", 1, (F.col("size") - F.ceil(F.col("size") * similarity.num / similarity.den) + 1).cast("int"))
    runs = ranked.select(F.col("doc_id").alias("node"), F.explode(prefix).alias("s")).where("s.often > 1").select(F.col("s.shingle").alias("run"), "node")
    runs = save(runs, "rare")
    links = first_links(runs, proof)
    known = joined(labels, links)
    return links.unionAll(proof.links(across(of_several(runs, known), proof)))
