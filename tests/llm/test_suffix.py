import hashlib
import random

import numpy as np
from sluice.llm import suffix_dedup as d


def plain(rows, length):
    """doc_id -> (bytes, removed flags), by looking every string up in every earlier document."""
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            if i is not None and any(j is not None and j < i and data[s : s + length] in (u or "").encode() for j, u in rows):
                gone[s : s + length] = True
        out[i] = (data, gone)
    return out


def corpus(rng, n):
    letters = "abcdé \n"
    word = lambda m: "".join(rng.choice(letters) for _ in range(m))
    shared = [word(rng.randint(30, 140)) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            t = rng.choice(rows)[1]
        elif rows and kind < 0.4:
            t = list(rng.choice(rows)[1])
            for _ in range(2):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(letters)
            t = "".join(t)
        else:
            t = word(rng.randint(0, 90)) + rng.choice(shared) * rng.randint(0, 2) + word(rng.randint(0, 60))
        rows.append((i, t))
    return rows


def test_suffix_ranks():
    rng = np.random.default_rng(3)
    for _ in range(20):
        rows = rng.integers(1, 4, (5, 40)).astype(np.uint16)
        for r, n in enumerate(rng.integers(1, 41, 5)):
            rows[r, n:] = 0
        rank = d.suffix_ranks(rows, 40).ravel()
        strings = [bytes(rows[r, c:].astype(np.uint8)).rstrip(b"\0") for r in range(5) for c in range(40)]
        want = sorted(strings)
        assert [want.index(x) for x in strings] == rank.tolist()


def test_common_prefixes():
    rng = np.random.default_rng(4)
    rows = rng.integers(1, 3, (6, 30)).astype(np.uint16)
    sizes = np.full(6, 30)
    rows[4, :18] = rows[2, 12:]
    sizes[4], rows[4, 18:] = 18, 0
    order = np.argsort(d.suffix_ranks(rows, 30), axis=None, kind="stable")
    got = d.common_prefixes(rows, sizes, order, 20)
    text = lambda i: rows[i // 30, i % 30 : sizes[i // 30]].tolist()
    for at in range(1, len(order)):
        a, b = text(order[at - 1]), text(order[at])
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[at] == min(n, 20)


def test_dedup_equals_plain(spark):
    for seed, settings in ((1, {}), (2, {"length": 20, "gram": 6}), (3, {"length": 20, "gram": 6, "hot": 3}), (4, {"hot": 1})):
        rows = [*corpus(random.Random(seed), 70), (200, None), (201, "")]
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k int, spans string")
        want = plain(rows, settings.get("length", 50))
        got = {r.doc_id: r for r in d.dedup(docs, **settings).collect()}
        assert got.keys() == want.keys()
        for i, (data, gone) in want.items():
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)


def test_edges(spark):
    long = "xyz " * 40
    docs = spark.createDataFrame([(None, long), (1, long), (2, long), (2, long), (3, "short"), (4, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_removed) for r in d.digests(docs).collect())
    assert got == [(-1, 0), (1, 0), (2, 160), (2, 160), (3, 0), (4, 0)]
    kept = d.keep_first(docs)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 4] and kept.columns == docs.columns
    assert d.digests(docs.limit(0)).count() == 0


def test_repeats_within_first_document(spark):
    """A string that an earlier document has in other surroundings goes from every place of a document that repeats it."""
    rng = random.Random(6)
    word = lambda m: "".join(rng.choice("abcdé \n") for _ in range(m))
    line = "".join(rng.choice("abcdefgh") for _ in range(59)) + "\n"
    rows = [(1, "a" * 60), (2, "a" * 700), (3, word(20) + line + word(20)), (4, line * 6), (5, word(90) + line * 2 + word(70) + line * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({}, {"hot": 1}, {"length": 20, "gram": 6}):
        want = plain(rows, settings.get("length", 50))
        got = {r.doc_id: r for r in d.dedup(docs, **settings).collect()}
        assert got.keys() == want.keys()
        for i, (data, gone) in want.items():
            assert (got[i].n_removed, bytes(got[i].kept)) == (int(gone.sum()), bytes(b for b, g in zip(data, gone, strict=True) if not g))
        assert got[2].n_removed == 700 and got[2].n_spans == 1
