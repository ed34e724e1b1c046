import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from sluice.llm import periodic
from sluice.llm.queries import op11_periodic_runs


def plain_runs(words, least, exponent):
    """Every stretch with a period, period by period."""
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        t = 0
        while t + p < n:
            a = t
            while t + p < n and words[t] == words[t + p]:
                t += 1
            b = t + p
            smaller = any(words[a : b - q] == words[a + q : b] for q in range(1, p))
            if t > a and b - a >= max(least, exponent * p) and not smaller:
                out.append((a, b - a, p))
            t = max(t, a + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
    w = [chr(97 + rng.randrange(k)) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 3), (2, 2)])
def test_runs_equal_all_periods(least, exponent):
    rng = random.Random(3)
    for _ in range(300):
        rows = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        counts, runs, kept = periodic.of_texts([" ".join(w) for w in rows], least, exponent)
        for w, c, r, k in zip(rows, counts, runs, kept, strict=True):
            want = plain_runs(w, least, exponent)
            assert [tuple(x) for x in r.tolist()] == want and c == len(w)
            gone = {i for s, m, p in want for i in range(s + p, s + m)}
            assert k == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_results_do_not_rest_on_hashes(monkeypatch):
    """With a prime so small that hashes of unlike words are often equal, runs are the same."""
    rng = random.Random(5)
    texts = [" ".join(random_words(rng) + random_words(rng) * 3) for _ in range(40)]
    want = periodic.of_texts(texts, 6, 4)[1]
    calls = []
    whole = periodic.Row.extension

    def careless(self, i, j):
        self.lists = [0] * (self.n + 1), [1] * self.n  # every hash is equal to every other
        calls.append(i)
        return whole(self, i, j)

    monkeypatch.setattr(periodic.Row, "extension", careless)
    got = periodic.of_texts(texts, 6, 4)[1]
    assert calls and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_one_word_many_times():
    counts, runs, kept = periodic.of_texts(["x " * 50_000, "a b " * 20_000 + "c"], 6, 4)
    assert counts == [50_000, 40_001] and runs[0].tolist() == [[0, 50_000, 1]] and runs[1].tolist() == [[0, 40_000, 2]]
    assert kept == ["x", "a b c"]


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(random_words(rng))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "a\x1cb a\x1cb a b\x85 " * 5), (None, "x y " * 9), (None, None), (305, "q\tq\x0bq\x0cq\rq\nq"), (305, "q"), (-7, "né " * 30)]
    extra = [(i, t, "en", 1, "w", 2) for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, n int, words string, h int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(plain_query(*r)) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert periodic.digests(periodic.find(docs.limit(0))).count() == 0


def test_query_on_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [d for d in docs if len((d.text or "").split()) < 350]
    assert len(short) > 100 and all(plain_query(d.doc_id, d.text) in got for d in short)
