import math
import random

import numpy as np
from sluice.llm import whitening
from sluice.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def plain(rows, k=4):
    """Grids and the fit by numpy over all rows at once, sums by Python's integers."""
    fine = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, len(sums))
    out = []
    for i, x in fine:
        w = (np.array(x) - np.array(sums) / n) @ v[:, :k] / np.sqrt(e[:k])
        out += [(i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w[c], e[c] / e.sum()) for c in range(k)]
    return out


def agree(got, want):
    got = sorted(got, key=lambda r: (r.component, r.deviation, r.vec_id is None, r.vec_id or 0))
    want = sorted(want, key=lambda r: (r[1], r[3], r[0] is None, r[0] or 0))
    assert [(r.vec_id, r.component, r.n, int(r.deviation)) for r in got] == [r[:4] for r in want]
    for c in {r.component for r in got}:
        a, b = np.array([r.whitened for r in got if r.component == c]), np.array([r[4] for r in want if r[1] == c])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8
        assert all(math.isclose(r.explained, w[5], rel_tol=1e-9) for r, w in zip(got, want, strict=True))
    assert all(r.identity_error < 1e-9 for r in got)


def test_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0.5, 1 + d) for d in range(6)]) for i in range(300)]
    rows += [(i + 1000, list(rows[7][1])) for i in range(150)] + [(None, list(rows[8][1])), (3, list(rows[9][1])), (3, list(rows[9][1]))]
    rows += [(2000, None), (2001, []), (2002, [None] * 6), (2003, [math.nan] + [0.0] * 5), (2004, [math.inf] + [1.0] * 5), (2005, [-0.0] * 6), (2006, [-0.001] * 6)]
    agree(whitening.whiten(frame(spark, rows)).collect(), plain(rows))
    agree(whitening.whiten(frame(spark, [(i, v and v[:3]) for i, v in rows])).collect(), plain([(i, v and v[:3]) for i, v in rows]))


def test_query_on_driver_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint"
    agree(got.collect(), plain(rows))


def test_without_spread_and_without_rows(spark):
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(frame(spark, [(i, [float(i), 0.0, 1.0]) for i in range(5)])).collect()
    assert len(line) == 15 and all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line)
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_unlike_lengths_and_great_numbers(spark):
    rows = [(i, [float(i * i), float(-i), 1.0 + i % 2]) for i in range(20)] + [(50, [1.0, 2.0]), (51, [1e30, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(20))
    agree(got, plain(rows[:20]))
    far = [(i, [float(2**40 + i * 2**30), float(i % 3)]) for i in range(9)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, far)).collect()}
    assert got == {r[0]: r[3] for r in plain(far)} and max(got.values()) > 2**63


def test_exact_sums_do_not_overflow():
    x = np.full((100, 2), 2**61, dtype=np.int64)
    x[:, 1] = -(2**61) + 1
    assert whitening.exact_sums(x) == [100 * 2**61, 100 * (1 - 2**61)]
