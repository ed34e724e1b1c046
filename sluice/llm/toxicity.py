"""Toxicity grades by ordinal regression: one weight vector, ordered thresholds, expected severity.

Grades from the labels table: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a text of poor quality.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text

BUCKETS = 1 << 18
#: The regression is fitted on about so many labelled documents of each grade; all their words count, likelihood ratios and
#: the L1 penalty choose among them.
SAMPLE_PER_GRADE = 4_000
GRADES = 3
#: Words are weighed whose likelihood ratio (doubled logarithm) is as great; L1 penalties to choose from, as parts of the toxic
#: documents' share; folds by which that is done; steps of the descent.
LEAST_RATIO, PENALTIES, FOLDS, STEPS = 3.0, (0.009, 0.003), 4, 150
#: Of documents that are not toxic so many, at most, may lie above the cut on the folds.
MOST_FALSE = 0.005
WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the words of the whole text, lower-cased, letters only."""
    from zlib import crc32

    words = set(WORD.findall(text.lower()))
    return np.unique(np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words), dtype=np.int64, count=len(words)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    rows: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # ascending: P(grade > j) = sigmoid(w.x - thresholds[j])

    def table(self) -> np.ndarray:
        w = np.zeros(BUCKETS)
        w[self.rows] = self.weights
        return w

    def above(self, score: float) -> np.ndarray:
        return sigmoid(score - self.thresholds)


def likelihood(s: float, y: int, first: float, gaps: np.ndarray) -> tuple[float, float, np.ndarray]:
    """P(grade = y) at score s, and the slopes of its negative logarithm by the score and by (first, gaps): the thresholds are
    first, first + e^gaps[0] and so on."""
    edges = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    up = np.concatenate([[1.0], sigmoid(s - edges), [0.0]])  # P(grade >= j)
    slope = up * (1 - up)
    p = max(up[y] - up[y + 1], 1e-9)
    by_edge = np.zeros(GRADES - 1)
    if y > 0:
        by_edge[y - 1] += slope[y] / p
    if y < GRADES - 1:
        by_edge[y] -= slope[y + 1] / p
    return p, -(slope[y] - slope[y + 1]) / p, np.concatenate([[by_edge.sum()], [by_edge[j + 1 :].sum() * np.exp(gaps[j]) for j in range(GRADES - 2)]])


def slopes(s: np.ndarray, y: np.ndarray, first: float, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """likelihood() for many scores at once: the slopes of the negative logarithms by each score, and the mean slope by
    (first, gaps)."""
    edges = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    n, at = len(s), np.arange(len(s))
    up = np.concatenate([np.ones((n, 1)), sigmoid(s[:, None] - edges), np.zeros((n, 1))], axis=1)
    slope = up * (1 - up)
    p = np.maximum(up[at, y] - up[at, y + 1], 1e-9)
    by_edge = np.array([(np.where(y == j + 1, slope[:, j + 1], 0) / p - np.where(y == j, slope[:, j + 1], 0) / p).mean() for j in range(GRADES - 1)])
    return -(slope[at, y] - slope[at, y + 1]) / p, np.concatenate([[by_edge.sum()], [by_edge[j + 1 :].sum() * np.exp(gaps[j]) for j in range(GRADES - 2)]])


def telling(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Which buckets are found more often in toxic documents than chance lets expect: by the likelihood ratio of their counts,
    LEAST_RATIO or more, so that words of a single document are none."""
    k1, k0 = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, t in zip(rows, toxic, strict=True) if t == kind)]), minlength=BUCKETS).astype(float) for kind in (True, False))
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    share = (k1 + k0) / max(n1 + n0, 1.0)
    ratio = np.zeros(BUCKETS)
    for seen, expected in ((k1, n1 * share), (k0, n0 * share), (n1 - k1, n1 * (1 - share)), (n0 - k0, n0 * (1 - share))):
        ratio += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return (k1 * n0 > k0 * n1) & (ratio >= LEAST_RATIO)


def descend(rows: list[np.ndarray], y: np.ndarray, penalty: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and thresholds (first, gaps) by accelerated proximal gradients of the mean negative logarithm of the likelihood
    plus the L1 norm of the weights times `penalty` times the share of toxic documents; only telling() buckets take part."""
    chosen = telling(rows, y > 0)
    kept = [r[chosen[r]] for r in rows]
    n, sizes = len(rows), [len(r) for r in kept]
    columns, entry = np.unique(np.concatenate([np.zeros(0, np.int64), *kept]), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    score = lambda w: np.bincount(row, weights=w[entry], minlength=n)
    back = lambda g: np.bincount(entry, weights=g[row], minlength=len(columns))
    first, gaps = 2.0, np.full(GRADES - 2, 0.0)
    w = ahead = np.zeros(len(columns))
    out = np.zeros(BUCKETS)
    if not len(columns):
        return out, first, gaps
    v = np.ones(len(columns))
    for _ in range(20):  # half of it bounds the gradient, since a logarithm of two sigmoids bends by a half at most
        v = back(score(v / np.linalg.norm(v)))
    steepest, lasso, t = np.linalg.norm(v) / n / 2, penalty * float((y > 0).mean()), 1.0
    for _ in range(STEPS):
        for _ in range(3):
            by_score, by_edge = slopes(score(ahead), y, first, gaps)
            first, gaps = first - 4 * by_edge[0], np.clip(gaps - 4 * by_edge[1:], -4, 4)
        moved = ahead - back(by_score) / n / steepest
        moved = np.sign(moved) * np.maximum(np.abs(moved) - lasso / steepest, 0)
        further = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = moved + (t - 1) / further * (moved - w), moved, further
    out[columns] = w
    return out, first, gaps


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(F1, cut): where documents above the cut are toxic with the greatest harmonic mean of precision and recall, of the cuts
    that no more than a share of MOST_FALSE of the others exceed; half way between the scores that it parts."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(toxic[order])
    ends = np.flatnonzero(np.append(s[1:] < s[:-1], True))
    few = ends + 1 - hits[ends] <= MOST_FALSE * (len(s) - toxic.sum())
    ends = ends[few] if few.any() else ends[:1]
    f1 = 2 * hits[ends] / (ends + 1 + toxic.sum())
    at = ends[int(f1.argmax())]
    return float(f1.max()), float((s[at] + s[at + 1]) / 2 if at + 1 < len(s) else s[at] - 1)


def fit_sample(data: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. The penalty, and the score from which on a document is toxic, are those that do best on folds
    that were held out; thresholds are moved as one so that the first stands there, and so stay ordered."""
    y, rows = np.array([g for g, _ in data], dtype=np.int64), [nz for _, nz in data]
    if not len(y):
        return np.zeros(BUCKETS), np.full(GRADES - 1, 40.0)
    fold = np.arange(len(rows)) % FOLDS
    best = (-1.0, 0.0, PENALTIES[-1])
    if all((y[fold != k] > 0).any() and (y[fold == k] > 0).any() for k in range(FOLDS)):
        for penalty in PENALTIES:
            scores = np.zeros(len(rows))
            for k in range(FOLDS):
                inside = np.flatnonzero(fold != k)
                w, first, _ = descend([rows[i] for i in inside], y[inside], penalty)
                scores[fold == k] = [w[rows[i]].sum() - first for i in np.flatnonzero(fold == k)]
            best = max(best, (*best_cut(scores, y > 0), penalty))
    w, first, gaps = descend(rows, y, best[2])
    return w, first + best[1] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_GRADE) -> Model:
    """Learns from the labelled documents. A null toxic label is unlabelled, a null quality good; a document with two
    labels counts for both."""
    texts = id_text(docs)
    grade = F.when(F.col("toxic") > 0, F.when(F.coalesce(F.col("quality"), F.lit(1)) > 0, 1).otherwise(2)).otherwise(0)
    graded = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    sizes = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if set(sizes) <= {0}:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.full(GRADES - 1, 40.0))

    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col("grade") == g, min(1.0, sample / n)).otherwise(share)
    most = 2 * sample * GRADES  # a bound for repeated ids too
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)

    def sparse(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype("<u4").tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "grade", "nz"])

    found = batches(F.broadcast(chosen).join(texts, "doc_id").select("doc_id", "grade", "text")).mapInArrow(sparse, "doc_id long, grade int, nz binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "nz").limit(most).collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["grade"]))
    weights, thresholds = fit_sample([(r["grade"], np.frombuffer(r["nz"], "<u4").astype(np.int64)) for r in rows])
    used = np.flatnonzero(weights)
    return Model(used, weights[used], thresholds)


def grade(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, severity (the expected grade, 0 to 2), grade (the likeliest) and toxic (grade 1 or 2 likelier than 0).

    Null and empty texts have no features and get what the thresholds alone say. Without toxic labels all severities
    are about 0. Repeated rows have equal results; an empty table gives none; further columns are ignored.
    """
    model = model or fit(docs, labels)

    def run(it):
        w = model.table()
        for b in it:
            above = np.array([model.above(float(w[features(t)].sum())) for t in b.column(1).to_pylist()]).reshape(-1, GRADES - 1)
            each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "toxic"])

    return batches(id_text(docs)).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")
