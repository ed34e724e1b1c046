import random

import numpy as np
from sluice.llm import jaccard_join as j


def plain_sets(text, words):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def plain_components(rows, words, num, den):
    sets = [(i, plain_sets(t, words)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and len(x & y) * den >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(rng, n=260):
    words = [f"w{i}" for i in range(400)]
    rows, kept = [], []
    passage = [rng.choice(words) for _ in range(30)]
    for i in range(n):
        kind = rng.random()
        if kept and kind < 0.45:
            w = list(rng.choice(kept))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1) or [w[at]]
        elif kind < 0.7:
            w = passage + [rng.choice(words) for _ in range(rng.randint(1, 40))]
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200]))]
        kept.append(w)
        rows.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w) + rng.choice(["", "\n", " \t"])))
    return rows


def test_shingles_are_those_of_plain_sets():
    rng = random.Random(1)
    for i, t in [*corpus(rng, 60), (0, None), (0, ""), (0, " \n\t "), (0, "É é É é x\x0by z")]:
        assert len(j.shingles(t, 4)) == len(plain_sets(t, 4))
    assert (j.shingles("A b\tC d", 4) == j.shingles(" a B\nc D ", 4)).all()


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(0)
    for num, den in ((85, 100), (8, 10)):
        s = j.Similarity(num, den)
        for n in [*range(1, 70), 100, 127, 128, 150, 255, 256, 300, 511, 513, 900]:
            for _ in range(6):
                x = rng.integers(0, 2**63, n).astype(np.uint64)
                y = x.copy()
                cut = rng.integers(0, max(1, n // 5) + 1)
                y = np.unique(np.concatenate([y[cut:], rng.integers(0, 2**63, rng.integers(0, n // 8 + 2)).astype(np.uint64)]))
                x = np.unique(x)
                if len(y) and s.linked(x, y):
                    assert (len(x) == len(y) and (x == y).all()) or len(np.intersect1d(j.keys(x, s), j.keys(y, s)))


def test_join_equals_plain(spark):
    for seed, words, num, den, crowd in ((1, 4, 85, 100, 64), (2, 5, 8, 10, 64), (3, 4, 85, 100, 2)):
        rows = [*corpus(random.Random(seed)), (900, None), (901, ""), (902, " "), (903, "only"), (904, "ONLY")]
        docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, run long, label int")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.join(docs, words, num, den, crowd).collect()}
        assert got == plain_components(rows, words, num, den)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (7, "A b c d")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in j.join(docs).collect()) == [(-1, 1, None), (2, 1, 2), (2, 1, 2), (7, 1, 2)]
    assert j.join(docs.limit(0)).count() == 0


def test_components(spark):
    from sluice.llm.components import components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (103, 102), (5, 5), (1, 2)]
    got = {r.doc_id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
