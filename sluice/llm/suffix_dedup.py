"""Removal of byte strings of LENGTH that an earlier document has, by suffix arrays over shards.

1. Anchors. In each string of LENGTH bytes the least hash of its GRAM-byte grams (the rightmost of equal ones) is its
   anchor: equal strings have equal anchors. A string can only lie in its anchor's context, the bytes about the anchor
   as far as a string with it can reach. Each document sends the hashes of its anchors and of their contexts to the
   receiver of the anchor. Where an earlier document has the same context, the whole context goes.
2. Shards. What is left to decide are anchors with several contexts; the first document of each context sends it, with
   all its places there, to the shard of the anchor, so that equal strings meet in one shard. There a suffix array is made by refinement of ranks
   (Larsson and Sadakane), common prefixes follow by Kasai's rule, and neighbours with LENGTH common bytes form classes;
   each has its least doc_id.
3. Across shards. Anchors of more than HOT contexts would make one shard too large. Their strings are spread over all
   receivers instead, each string by its own hash, as sorted lists from every sender; a receiver merges the lists by
   binary search.
4. Spans of removed bytes go back to their documents by a join on the doc_id.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, give_back, partitions, save, tidy
from .jaccard_join import from_planes, mix, planes, repeated
from .winnowing import POWERS

#: Grams this long seldom repeat by chance; longer ones would make more anchors.
LENGTH, GRAM = 50, 20
HOT = 1_000
#: Bytes of distinct contexts that one suffix array takes at a time.
SHARD_BYTES = 1 << 20


@lru_cache(maxsize=1)
def scatter() -> np.ndarray:
    """The bytes in another order, for a second hash of the same strings."""
    return np.argsort(mix(np.arange(1, 257, dtype=np.uint64))).astype(np.uint8)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings of data."""
    up, down = POWERS.get(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions), ascending in position; none for data shorter than length."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = rolling(data, gram)
    low = np.uint64(0xFFFFFFFF)
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    span, window = 1, length - gram + 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (low - (least[np.concatenate([[True], least[1:] != least[:-1]])] & low)).astype(np.int64)
    return h[at], at


def suffix_ranks(rows: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of all rows (symbols from 1, 0 behind their ends), by at least their first `depth` symbols.

    The rank is how many suffixes are less, equal ones share it. Ranks start from seven symbols packed into a number;
    each round doubles the symbols and sorts only suffixes whose rank is shared, within their groups.
    """
    n, width = rows.shape
    packed = np.zeros((n, width), dtype=np.int64)
    for j in range(7):
        packed[:, : width - j] += rows[:, j:].astype(np.int64) << (9 * (6 - j))
    order = np.argsort(packed, axis=None)  # equal ones in any order, here and below
    flat = packed.ravel()[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    rank = np.empty(n * width, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 7
    while h < depth:
        shared = np.flatnonzero(np.bincount(rank, minlength=n * width)[rank] > 1)
        if not len(shared):
            break
        behind = np.zeros((n, width), dtype=np.int64)
        behind[:, : width - h] = np.where(rows[:, h:] > 0, rank.reshape(n, width)[:, h:] + 1, 0)
        first, second = rank[shared], behind.ravel()[shared]
        by = np.argsort(first * (n * width + 1) + second)
        shared, first, second = shared[by], first[by], second[by]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        part = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(shared))
        rank[shared] = first + at[part][np.cumsum(part) - 1] - at[group][np.cumsum(group) - 1]
        h *= 2
    return rank.reshape(n, width)


def common_prefixes(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For all suffixes (row * width + column) in full order: how many symbols, up to `most`, each shares with the one before.

    Kasai's rule, all rows in step: one column further on, a suffix has at most one symbol less in common. Equal suffixes
    are in order of their rows, so that the rule holds among them too.
    """
    n, width = rows.shape
    before = np.full(n * width, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before = before.reshape(n, width)
    out, have = np.zeros((n, width), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for c in range(width):
        have = np.maximum(have - 1, 0)
        other = before[:, c]
        have[other < 0] = 0
        row, column = other // width, other % width
        live = np.flatnonzero((other >= 0) & (c < sizes))
        while len(live):
            k = have[live]
            ok = (k < most) & (c + k < sizes[live]) & (column[live] + k < sizes[row[live]])
            live, k = live[ok], k[ok]
            live = live[rows[live, c + k] == rows[row[live], column[live] + k]]
            have[live] += 1
        out[:, c] = have
    return out.ravel()[order]


def least_documents(contexts: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """docs[i] is the least document with contexts[i]; for each string of `length` bytes in each context (row, start) the
    least document that has it in any context, or the greatest number where the context is too short."""
    sizes = np.array(list(map(len, contexts)), dtype=np.int64)
    width = int(sizes.max())
    starts = width - length + 1
    filled = np.arange(width) < sizes[:, None]
    rows = np.zeros((len(contexts), width), dtype=np.uint16)
    rows[filled] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.uint16) + 1
    order = np.argsort(suffix_ranks(rows, width).ravel() * rows.size + np.arange(rows.size))
    new = common_prefixes(rows, sizes, order, length) < length
    new[0] = True
    least = np.minimum.reduceat(docs[order // width], np.flatnonzero(new))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = least[np.cumsum(new) - 1]
    out = out.reshape(len(contexts), width)[:, :starts]
    out[np.arange(starts) + length > sizes[:, None]] = np.iinfo(np.int64).max
    return out


def spans(docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal runs that strings from these starts cover."""
    if not len(docs):
        return docs, starts, starts
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + length)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], starts[first], starts[last] + length


def blobs(to: np.ndarray, n: int, *columns: tuple[np.ndarray, int]):
    """(receiver, bytes of each column), for the receivers that get any; columns in so many byte planes, or as they are for 0."""
    order = np.argsort(to.astype(np.uint16) if n <= 1 << 16 else to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n + 1))
    columns = [(c[order], width) for c, width in columns]
    return [(i, *(planes(c[cut[i] : cut[i + 1]], width) if width else c[cut[i] : cut[i + 1]].tobytes() for c, width in columns)) for i in range(n) if cut[i] < cut[i + 1]]


def context_hashes(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hashes of the contexts of the anchors at these places, with how far they reach to either side."""
    low, high = np.maximum(0, at - length + gram), np.minimum(len(data), at + length)
    up, down = POWERS.get(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return mix((sums[high] - sums[low]) * down[low] + ((at - low) * 1024 + high - at).astype(np.uint64))


def record_batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def with_base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with `base`: places of unlike texts of one doc_id count on from each other, so that a
    place belongs to one text. It is 0 wherever a doc_id has one text only."""
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), (F.octet_length("text") + 1).cast("long").alias("n")).distinct()
    several = save(own.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "several")
    if several.isEmpty():
        return docs.withColumn("base", F.lit(0).cast("long"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bases = save(own.join(several, "doc_id").select("doc_id", "h", before.alias("base")), "bases")
    return docs.withColumn("h", F.xxhash64("text")).join(bases, ["doc_id", "h"], "left").drop("h").withColumn("base", F.coalesce("base", F.lit(0).cast("long")))


def own_places(places: np.ndarray, base: int, data: bytes) -> np.ndarray:
    """Those places that are a text's own, counted from its beginning."""
    return places[(places >= base) & (places < base + len(data))] - base


def removed(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, spans, full): for each document that loses any, lists of pairs of 64-bit (start, end), and of 64-bit places
    of anchors whose contexts go."""
    spark = texts.sparkSession
    n = partitions(spark)
    joined = lambda xs, kind: np.concatenate([np.frombuffer(x, kind) for x in xs] or [np.zeros(0, kind)])

    def send_anchors(it):
        for b in it:
            parts = []
            for d, base, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = np.frombuffer(t.encode(), np.uint8)
                h, at = anchors(data, length, gram)
                if len(h):
                    parts.append((h, context_hashes(data, at, length, gram), np.full(len(h), d, np.int64), at + base))
            if parts:
                key, context, doc, at = map(np.concatenate, zip(*parts, strict=True))
                rows = blobs((key % np.uint64(n)).astype(np.int64), n, (key // np.uint64(n), 5), (context, 6), (doc.astype(np.uint64), 8), (at.astype(np.uint64), 8))
                yield record_batch(rows, ["to", "keys", "contexts", "docs", "places"], [pa.int32(), *[pa.binary()] * 4])

    def shared_anchors(it):
        got = [[], [], [], []]
        for b in it:
            for column, width, into in zip(b.columns[1:], (5, 6, 8, 8), got, strict=True):
                into += [from_planes(x, width) for x in column.to_pylist()]
        if not got[0]:
            return
        key, context, doc, at = map(np.concatenate, got)
        del got
        doc, at = doc.view(np.int64), at.view(np.int64)
        several = repeated(key)  # an anchor that occurs once decides nothing
        key, context, doc, at = key[several], context[several], doc[several], at[several]
        if not len(key):
            return
        order = np.lexsort((at, doc, context, key))
        key, context, doc, at = key[order], context[order], doc[order], at[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_context = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        first = np.flatnonzero(new_context)  # the first document of each context
        own = np.cumsum(new_context) - 1
        full = doc > doc[first][own]
        group = (np.cumsum(new_key) - 1)[first]
        contexts = np.bincount(group)[group]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        many = np.minimum.reduceat(doc[first], start)[group] != np.maximum.reduceat(doc[first], start)[group]
        kind = np.where(full, 1, np.where(many, np.where(contexts > hot, 3, 2), 0)[own]).astype(np.int8)
        keep = kind > 0
        key, doc, at, kind = key[keep], doc[keep], at[keep], kind[keep]
        yield answer(doc, at, kind.astype(np.int64))
        del key, context, doc, at, kind, keep, order, own, group, contexts, many, full
        give_back()

    def answer(doc, first, second):
        """Rows of two numbers for documents, to the answer's receiver of each document: one blob a receiver."""
        order = np.lexsort((first, doc))
        doc, first, second = doc[order], first[order], second[order]
        rows = blobs(np.mod(doc, n), n, *((x.view(np.uint64), 8) for x in (doc, first, second)))
        return record_batch(rows, ["to", "docs", "first", "second"], [pa.int32(), *[pa.binary()] * 3])

    def answers(it):
        """All answers of a receiver, sorted by document: documents, numbers, and where each document begins."""
        got = [[], [], []]
        for b in it:
            for column, into in zip(b.columns[1:], got, strict=True):
                into += [from_planes(x, 8).view(np.int64) for x in column.to_pylist()]
        doc, first, second = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in got)
        order = np.lexsort((first, doc))
        doc, first, second = doc[order], first[order], second[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else [], len(doc)).astype(np.int64)
        return doc, first, second, list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))

    def anchors_of(it):
        doc, at, kind, parts = answers(it)
        for i in range(0, len(parts), 2000):
            rows = [(int(doc[a]), *(at[a:z][kind[a:z] == k].tobytes() for k in (1, 2, 3))) for a, z in parts[i : i + 2000]]
            yield record_batch(rows, ["doc_id", "full", "cold", "hot"], [pa.int64(), *[pa.binary()] * 3])

    def spans_of(it):
        doc, start, end, parts = answers(it)
        for i in range(0, len(parts), 2000):
            rows = [(int(doc[a]), np.stack([start[a:z], end[a:z]], axis=1).tobytes()) for a, z in parts[i : i + 2000]]
            yield record_batch(rows, ["doc_id", "spans"], [pa.int64(), pa.binary()])

    blob = "to int, docs binary, first binary, second binary"
    dealt = batches(texts).mapInArrow(tidy(send_anchors), "to int, keys binary, contexts binary, docs binary, places binary").repartitionById(n, F.col("to"))
    told = dealt.mapInArrow(shared_anchors, blob).repartitionById(n, F.col("to")).mapInArrow(anchors_of, "doc_id long, full binary, cold binary, hot binary")
    lists = [F.filter(F.array(c), lambda x: F.length(x) > 0).alias(c) for c in ("full", "cold", "hot")]
    shared = save(told.select("doc_id", *lists), "anchors")
    open_ = shared.where((F.size("cold") > 0) | (F.size("hot") > 0)).select("doc_id", "cold", "hot")

    def send_strings(it):
        for b in it:
            shards: dict[int, tuple[dict, list, list, list]] = {}
            key, check, late, start = [], [], [], []
            for d, zero, t, cold, warm in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = t.encode()
                places = own_places(joined(cold, np.int64), zero, data)
                hashes = rolling(np.frombuffer(data, np.uint8), gram)[places] if len(places) else places
                for p, k in zip(places.tolist(), hashes.tolist(), strict=True):
                    low = max(0, p - length + gram)
                    number, which, doc, base = shards.setdefault(k % n, ({}, [], [], []))
                    which.append(number.setdefault((k, data[low : p + length]), len(number)))
                    doc.append(d)
                    base.append(low + zero)
                p = own_places(joined(warm, np.int64), zero, data)
                if len(p):
                    s = np.unique(np.concatenate([np.arange(max(0, x - length + gram), min(x, len(data) - length) + 1) for x in p]))
                    x = rolling(np.frombuffer(data, np.uint8), length)[s]
                    key.append(x)
                    check.append((rolling(scatter()[np.frombuffer(data, np.uint8)], length)[s] >> np.uint64(32)).astype("<u4"))
                    late.append(np.full(len(x), d, dtype=np.int64))
                    start.append(s + zero)
            rows = [(i, [c for _, c in number], np.array([k for k, _ in number], dtype=np.uint64).tobytes(), np.array(which, dtype=np.int32).tobytes(), *(np.array(x, dtype=np.int64).tobytes() for x in rest), None) for i, (number, which, *rest) in shards.items()]
            if key:
                key, check, late, start = map(np.concatenate, (key, check, late, start))
                order = np.argsort(key)
                key, check, late, start = key[order], check[order], late[order], start[order]
                rows += [(i, None, k, None, d, s, c) for i, k, d, s, c in blobs((key % np.uint64(n)).astype(np.int64), n, (key, 0), (late, 0), (start, 0), (check, 0))]
            yield record_batch(rows, ["to", "contexts", "keys", "which", "docs", "starts", "checks"], [pa.int32(), pa.list_(pa.binary()), *[pa.binary()] * 5])

    def in_shards(it):
        number, which, doc, base, lists = {}, [], [], [], []
        for b in it:
            for r in b.to_pylist():
                if r["contexts"] is not None:
                    own = np.array([number.setdefault(c, len(number)) for c in zip(np.frombuffer(r["keys"], np.uint64).tolist(), r["contexts"], strict=True)], dtype=np.int64)
                    which.append(own[np.frombuffer(r["which"], np.int32)])
                    doc.append(np.frombuffer(r["docs"], np.int64))
                    base.append(np.frombuffer(r["starts"], np.int64))
                else:
                    lists.append([np.frombuffer(r[c], kind) for c, kind in (("keys", np.uint64), ("docs", np.int64), ("starts", np.int64), ("checks", np.uint32))])
        found = [classes(list(number), *map(np.concatenate, (which, doc, base)))] if which else []
        found += [merged(lists)] if lists else []
        del number, which, doc, base, lists
        if found:
            d, s, e = spans(*map(np.concatenate, zip(*found, strict=True)), length)
            yield answer(d, s, e)
            del found, d, s, e
        give_back()

    def classes(contexts: list[tuple[int, bytes]], which: np.ndarray, doc: np.ndarray, base: np.ndarray):
        """(document, start) of strings of the shard that an earlier document has; contexts of one anchor go together."""
        own = np.full(len(contexts), np.iinfo(np.int64).max)
        np.minimum.at(own, which, doc)
        table = np.full((len(contexts), length - gram + 1), np.iinfo(np.int64).max)
        order = sorted(range(len(contexts)), key=lambda i: contexts[i][0])
        part, size = [], 0
        for j, i in enumerate(order):
            part.append(i)
            size += len(contexts[i][1])
            if j + 1 == len(order) or size >= SHARD_BYTES and contexts[order[j + 1]][0] != contexts[i][0]:
                got = least_documents([contexts[x][1] for x in part], own[part], length)
                table[part, : got.shape[1]] = got
                part, size = [], 0
        found = []
        for i in range(0, len(which), 1 << 16):
            late, at = doc[i : i + (1 << 16)], base[i : i + (1 << 16)]
            row, column = np.nonzero(table[which[i : i + (1 << 16)]] < late[:, None])
            found.append((late[row], at[row] + column))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def merged(lists):
        """The same for strings that came as sorted lists: each list is looked up in the merged list of all, by both hashes."""
        key = np.unique(np.concatenate([k for k, *_ in lists]))
        own = [np.searchsorted(key, k).astype(np.uint64) << np.uint64(32) | c for k, _, _, c in lists]
        both = np.unique(np.concatenate(own))
        least = np.full(len(both), np.iinfo(np.int64).max)
        for o, (_, d, _, _) in zip(own, lists, strict=True):
            np.minimum.at(least, np.searchsorted(both, o), d)
        late = [d > least[np.searchsorted(both, o)] for o, (_, d, _, _) in zip(own, lists, strict=True)]
        return tuple(np.concatenate([x[i][ok] for x, ok in zip(lists, late, strict=True)]) for i in (1, 2))

    with_text = batches(texts.join(open_, "doc_id").select("doc_id", "base", "text", "cold", "hot"))
    strings = with_text.mapInArrow(tidy(send_strings), "to int, contexts array<binary>, keys binary, which binary, docs binary, starts binary, checks binary")
    found = strings.repartitionById(n, F.col("to")).mapInArrow(in_shards, blob).repartitionById(n, F.col("to"))
    found = found.mapInArrow(spans_of, "doc_id long, spans binary").select("doc_id", F.array("spans").alias("spans"))
    return found.join(shared.where(F.size("full") > 0).select("doc_id", "full"), "doc_id", "full_outer")


def cut(docs: DataFrame, finish, kind: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs as a column `row` (all but the text) and `text`, and the columns of `kind` that finish(text in UTF-8, spans)
    gives for each row.

    Strings are judged on the input, also in spans that go. Null text is empty. A row with a null doc_id neither loses
    anything nor makes others lose. Rows of one doc_id do not make each other lose, and each loses what its own text
    shares with smaller doc_ids. An empty table stays empty; other columns are kept as they are.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*others).alias("row"), F.col("text").cast("string").alias("text")))
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "base", "text")
    gone = removed(texts, length, gram, hot)
    both = rows.join(gone, "doc_id", "left").select("row", "text", "base", "spans", "full")

    def run(it):
        for b in it:
            out = []
            texts = [None if t is None else t.encode() for t in b.column(1).to_pylist()]
            for t, base, lists, full in zip(texts, *(c.to_pylist() for c in b.columns[2:]), strict=True):
                data = t or b""
                at = own_places(np.concatenate([np.frombuffer(x, np.int64) for x in full or []] or [np.zeros(0, np.int64)]), base, data)
                near = np.stack([np.maximum(0, at - length + gram), np.minimum(at + length, len(data))], axis=1)
                found = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 2) for x in lists or [])])
                found = found[(found[:, 0] >= base) & (found[:, 0] < base + len(data))] - base
                pairs = np.concatenate([near[near[:, 1] - near[:, 0] >= length], found])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                merged: list[list[int]] = []
                for a, z in pairs.tolist():
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    elif a < z:
                        merged.append([a, z])
                out.append(finish(data, merged))
            added = record_batch(out, names, kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *added.columns], names=["row", "text", *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kind))
    names, kinds = schema.names, schema.types
    return batches(both).mapInArrow(tidy(run), f"row {both.schema['row'].dataType.simpleString()}, text string, {kind}")


def left_over(data: bytes, gone: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, z in gone:
        out.append(data[at:a])
        at = z
    return b"".join([*out, data[at:]])


def dedup(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the bytes kept and the spans [start, end) removed; see cut()."""

    def finish(data, gone):
        kept = left_over(data, gone)
        return len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, gone

    done = cut(docs, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>", **settings)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")


def digests(docs: DataFrame, **settings) -> DataFrame:
    """dedup() without the bytes themselves."""

    def finish(data, gone):
        kept = left_over(data, gone)
        return len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()

    ids = docs.select("doc_id", "text")
    return cut(ids, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **settings).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """docs without repeated strings. What is left of a character that a span cuts goes too; a document of which nothing
    is left goes, one that was empty or null before stays."""

    def finish(data, gone):
        return (left_over(data, gone).decode("utf-8", "ignore") if gone else None, bool(gone))

    done = cut(docs, finish, "left_text string, changed boolean", **settings)
    done = done.where(~F.col("changed") | F.col("left_text").rlike(r"\S"))
    text = F.when(F.col("changed"), F.col("left_text")).otherwise(F.col("text")).alias("text")
    return done.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
