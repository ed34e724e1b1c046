"""Whitening of embeddings: exact integer sums, a second pass of centred outer products, eigenvectors, a broadcast projection."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, save

#: Steps per unit: an entry c becomes floor(SCALE * c).
SCALE = 256
#: Entries of the rows that are centred and multiplied at once.
BLOCK = 1 << 22
#: Entries below it, once scaled, fit 64 bits with room for a sum's halves.
LIMIT = 2.0**62


def grid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the vector's entries as whole steps, in bytes: little-endian 64-bit integers.

    Rows whose vector is null, empty or holds a null, a NaN, an infinity or an entry of 2^54 or more, without sign, are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LIMIT))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull()).where((F.size("v") > 0) & fit)

    def run(it):
        for b in it:
            column = b.column(1)
            x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype("<i8")
            ends = (column.offsets.to_numpy() - column.offsets[0].as_py()) * 8
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(x)])], names=["vec_id", "x"])

    return batches(rows).mapInArrow(run, "vec_id long, x binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype="<i8").reshape(-1, dim)


def exact_sums(x: np.ndarray) -> list[int]:
    """The sum of each column as a Python integer: upper and lower halves are summed apart, so that neither overflows."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(h << 32) + l for h, l in zip(high.tolist(), low.tolist(), strict=True)]


def most_common_size(x: DataFrame) -> int | None:
    """The most frequent number of entries among the distinct vectors, the greatest of equally frequent ones."""
    top = x.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return top and top["size"] // 8


class Fit:
    """n and the exact sums S per dimension of the distinct vectors; eigenvalues, greatest first; eigenvectors as columns."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: the whole part of the mean is taken off as integers first."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n*x - S)^2, in 64-bit integers where these hold it, else in Python's."""
        dim = x.shape[1]
        reach = [self.n * max(abs(int(a)), abs(int(b))) + abs(s) for a, b, s in zip(x.min(axis=0), x.max(axis=0), self.sums, strict=True)]
        if sum(r * r for r in reach) < 2**63:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        return [sum((self.n * v - self.sums[k]) ** 2 for k, v in enumerate(row)) for row in x.reshape(-1, dim).tolist()]

    def scaled(self, k: int) -> np.ndarray:
        """The first k components, each over the square root of its eigenvalue; a component without spread is NaN."""
        values = self.values[:k]
        none = values <= self.values[0] * len(self.sums) * np.finfo(float).eps
        return self.vectors[:, :k] / np.sqrt(np.where(none, np.nan, values))


def tree_sum(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of arrays of doubles, one in bytes in each row of parts, added in a tree over executors: the driver gets
    few of them however many rows there are."""
    total = parts.rdd.treeAggregate(None, lambda a, r: np.frombuffer(r[0]) if a is None else a + np.frombuffer(r[0]), lambda a, b: a if b is None else b if a is None else a + b, depth=3)
    return (np.zeros(int(np.prod(shape))) if total is None else total).reshape(shape)


def summed(x: DataFrame, dim: int, of_block) -> np.ndarray:
    """The sum of of_block(rows as integers) over blocks of all rows of x, one partial sum a task."""
    shape = of_block(np.zeros((0, dim), dtype=np.int64)).shape

    def run(it):
        total, held, n = np.zeros(shape), [], 0
        for b in it:
            held.append(matrix(b.column(0), dim))
            n += len(b) * dim
            if n >= BLOCK:
                total += of_block(np.concatenate(held))
                held, n = [], 0
        if held:
            total += of_block(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return tree_sum(batches(x.select("x")).mapInArrow(run, "part binary"), shape)


def fit(x: DataFrame, dim: int) -> Fit:
    """Mean and covariance over all rows of x, a saved table of distinct vectors of `dim` entries. Nothing but sums of
    `dim` entries and of `dim` x `dim` reaches the driver; they do not grow with the rows."""

    def sums(it):
        total, n = [0] * dim, 0
        for b in it:
            n += len(b)
            total = [a + c for a, c in zip(total, exact_sums(matrix(b.column(0), dim)), strict=True)]
        values = [Decimal(v) for v in (n, *total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "v"])

    parts = batches(x.select("x")).mapInArrow(sums, "i int, v decimal(38,0)")
    n, *total = (int(r.v) for r in parts.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).orderBy("i").collect())
    found = Fit(n, total, np.zeros(0), np.zeros((0, 0)))

    def outer(rows: np.ndarray) -> np.ndarray:
        centred = found.centred(rows)
        return centred.T @ centred

    values, vectors = np.linalg.eigh(summed(x, dim, outer) / n)
    found.values, found.vectors = values[::-1], vectors[:, ::-1]
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained,
    identity_error.

    Entries c become x = floor(256 * c). Rows whose vector is null, empty or holds a null or an entry that is not finite are
    left out. The fit is over each distinct x once, n of them with sums S: components are the unit eigenvectors of its
    covariance (divisor n) by falling eigenvalue e, at most as many as there are entries. deviation is the sum of
    (n*x - S)^2, exact, null where 38 digits do not hold it; whitened is x - S/n on the component over sqrt(e); explained is e over the sum of all eigenvalues;
    identity_error is the greatest entry, without sign, of the covariance of the whitened fit less the identity.

    Equal and repeated rows, and null vec_ids, stay rows. A component without spread (fewer distinct vectors than
    components, or a constant direction) has null for whitened and, if there is no spread at all, for explained, and
    identity_error leaves it out; it is null if no component has spread. Vectors of unlike lengths share no space: the most
    frequent length among distinct vectors (of equally frequent ones the greatest) is the table's, others are left out like
    null ones. An empty table gives no rows; further columns are ignored.
    """
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    x = grid(df, id_col, vector_col)
    distinct = save(x.select("x").distinct(), "vectors")
    dim = most_common_size(distinct)
    if dim is None:
        return spark.createDataFrame([], schema)
    found = fit(distinct.where(F.octet_length("x") == 8 * dim), dim)
    k = min(components, dim)
    project = found.scaled(k)
    spread = np.flatnonzero(~np.isnan(project[0]))
    flat = np.nan_to_num(project)

    def moments(rows: np.ndarray) -> np.ndarray:
        w = found.centred(rows) @ flat
        return np.concatenate([w.sum(axis=0, keepdims=True), w.T @ w])

    mean, *second = summed(distinct.where(F.octet_length("x") == 8 * dim), dim, moments) / found.n
    error = np.abs(np.array(second) - np.outer(mean, mean) - np.eye(k))[np.ix_(spread, spread)].max(initial=0.0) if len(spread) else None
    trace = float(found.values.sum())
    shares = [float(e) / trace if trace > 0 else None for e in found.values[:k]]
    shared = spark.sparkContext.broadcast((found, project))  # dim x k numbers and the fit, however many rows there are

    def run(it):
        found, project = shared.value
        for b in it:
            rows = matrix(b.column(1), dim)
            m = len(rows)
            whitened = (found.centred(rows) @ project).reshape(-1)
            values = [Decimal(v) if v < 10**38 else None for v in found.deviations(rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, found.n), pa.int64()), pa.array(values, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(whitened, pa.float64(), mask=np.isnan(whitened)), pa.array(shares * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return batches(x.where(F.octet_length("x") == 8 * dim)).mapInArrow(run, schema)
