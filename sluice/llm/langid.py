"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with L1 and L2 penalties, then calibrated by one temperature.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back

BUCKETS = 1 << 16
#: The classifier is fitted on about so many documents of each language; document frequencies come from all of them.
SAMPLE_PER_LANGUAGE = 1_000
MAX_LANGUAGES = 512
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Buckets of all character 1-, 2- and 3-grams of the lower-cased text; runs of other characters count as one blank."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    x = np.where(letters()[x], x, 0).astype(np.uint32)
    x = np.concatenate([np.zeros(1, np.uint32), x, np.zeros(1, np.uint32)])
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    a, b, c = x * np.uint32(0x9E3779B1), x * np.uint32(0x85EBCA77), x * np.uint32(0xC2B2AE3D)
    h = np.concatenate([a[x != 0], (a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F))), (a[:-2] ^ (b[1:-1] + np.uint32(0x165667B1)) ^ (c[2:] << np.uint32(7)))])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts), or None for a text without letters."""
    if not text:
        return None
    c = np.bincount(grams(text), minlength=BUCKETS)
    nz = np.flatnonzero(c)
    return (nz, c[nz]) if any(map(str.isalpha, text)) else None


def weigh(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    nz, n = found
    x = (1 + np.log(n)) * idf[nz]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal with per-coordinate rates; L1 keeps most weights at exactly 0."""

    def __init__(self, rows: int, columns: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((rows, columns)), np.zeros((rows, columns))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, rows, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[rows]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] = n + g * g


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    rows: np.ndarray  # buckets with a weight
    weights: np.ndarray
    temperature: float

    def table(self) -> np.ndarray:
        w = np.zeros((BUCKETS, len(self.languages)), dtype=np.float64)
        w[self.rows] = self.weights
        return w


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on a grid in the logarithm."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 241))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, epochs: int = 3) -> Model:
    """Learns from text and lang of documents that have both and are not held out.

    Document frequencies cover all of them; the weights come from at most about `sample` of each language, chosen by a
    hash of the id, of which a fifth serves to find the temperature only.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    per = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in per)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros(0, dtype=np.int64), np.zeros((0, 0)), 1.0)

    def frequencies(it):
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in it:
            for t in b.column(0).to_pylist():
                if found := counts(t):
                    df[found[0]] += 1
                    n += 1
        nz = np.flatnonzero(df)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(nz, -1), pa.int32()), pa.array(np.append(df[nz], n))], names=["bucket", "n"])

    df = batches(known.select("text")).mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    total = max(1, int(df.n[df.bucket == -1].sum()))
    seen = np.zeros(BUCKETS)
    seen[df.bucket[df.bucket >= 0]] = df.n[df.bucket >= 0]
    idf = np.where(seen > 0, np.log((1 + total) / (1 + seen)) + 1, 0.0)

    share = F.lit(0.0)
    for r in per:
        share = F.when(F.col("lang") == r["lang"], min(1.0, sample / r["count"])).otherwise(share)
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.where(mark < share * (1 << 30)).select("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).alias("fold"), "doc_id", "text")

    def features(it):
        for b in it:
            found = [counts(t) for t in b.column(3).to_pylist()]
            keep = [i for i, f in enumerate(found) if f]
            columns = [c.take(pa.array(keep, pa.int64())) for c in b.columns[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([found[i][0].astype("<u2").tobytes() for i in keep], pa.binary()), pa.array([found[i][1].astype("<u4").tobytes() for i in keep], pa.binary())], names=["lang", "fold", "doc_id", "nz", "n"])
        give_back()

    found = batches(chosen).mapInArrow(features, "lang string, fold long, doc_id long, nz binary, n binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "nz").limit(2 * sample * len(languages)).collect()  # a bound for repeated ids too
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["lang"]))
    at = {name: i for i, name in enumerate(languages)}
    data = [(at[r["lang"]], r["fold"], np.frombuffer(r["nz"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in rows]
    data = [(y, fold, nz, weigh((nz, n), idf)) for y, fold, nz, n in data]
    leader = FollowTheLeader(BUCKETS, len(languages))
    train = [d for d in data if d[1] != 0] or data
    for _ in range(epochs):
        for y, _, nz, x in train:
            w = leader.weights(nz)
            p = softmax(x @ w)
            p[y] -= 1
            leader.step(nz, w, x[:, None] * p)
    w = leader.weights()
    check = [d for d in data if d[1] == 0] or data
    heat = temperature(np.array([x @ w[nz] for _, _, nz, x in check]), np.array([d[0] for d in check])) if check else 1.0
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    return Model(languages, idf, used, w[used], heat)


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """A column `row` with all columns of docs, lang_pred and score.

    Whole texts are read. A text that is null or has no letter is `und` with score 1, as is every text when no language
    was learned (score 0). Ties go to the first language by name. Repeated rows have equal results; an empty table gives none.
    """

    def run(it):
        w = model.table() if model.languages else None
        for b in it:
            names, scores = [], []
            for t in b.column(1).to_pylist():
                found = counts(t)
                if found is None or w is None:
                    names.append(UNKNOWN)
                    scores.append(1.0 if found is None else 0.0)
                    continue
                p = softmax(weigh(found, model.idf) @ w[found[0]] / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])
        b = found = w = None
        give_back()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return batches(rows).mapInArrow(run, f"row {kind}, lang_pred string, score double")


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; the model is fitted on docs unless one is given."""
    model = model or fit(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(ids, model).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows of docs whose language is recognised: not `und`, and with a score of at least `least`."""
    model = fit(docs)
    return annotate(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
