"""Operator 12, embedding whitening with mixed-precision eigenvectors.

Vectors that are null, or hold a null or non-finite entry, go.  Every other entry ``c`` becomes the integer
``x = floor(64 c) + OFFSET``.  One pass sums the x-vectors; a second centres every vector at the rounded mean and multiplies
(integers, so exact: the rest of the centring is exact too); sums are per (row, column) pair, so no key grows hot and
only dimension x dimension numbers, which do not depend on the number of rows, reach the driver.

*Components.*  The covariance is held as unevaluated pairs of doubles (about 106 bits).  Eigenvectors found in float32 are
corrected by Ogita-Aishima iterations: with ``R = I - X'X`` and ``S = X'VX`` in pairs, ``X += X E`` where
``E[i,j] = (S[i,j] + l[j] R[i,j]) / (l[j] - l[i])``, which squares the error each time.  The products of pairs are sums of
exact BLAS products of short slices.  Eigenvalues closer than the iteration's own error bound are a cluster: there E only
orthogonalises (``R / 2``), and a sub-solve of ``X_c' V X_c`` less its mean eigenvalue, in which the small gaps are large,
turns the cluster's vectors before the next iteration.  Equal eigenvalues keep any orthonormal basis.

A component's sign makes its largest entry positive.  Components are those of positive eigenvalue, ``COMPONENTS`` at most.

Defined results: an entry of 2**40 or more has no exact integer form here, and its vector goes as a non-finite one does;
of vectors of different lengths only the commonest length stays (ties: the longer); rows that repeat an id, or a vector,
are rows of their own; a null id stays null; without variance, or without rows, there are no components and no rows; a
``deviation`` beyond a long is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .registry import query

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = 2.0 ** 40
EXACT = 1 << 53                # integers below are exact doubles
ROWS = 4096                    # vectors multiplied at once


# ------------------------------------------------------------- pairs of doubles (value = hi + lo)

def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(p, q):
    s, e = two_sum(p[0], q[0])
    return two_sum(s, e + (p[1] + q[1]))


def halves(a):
    t = a * 134217729.0        # 2**27 + 1
    hi = t - (t - a)
    return hi, a - hi


def times(p, q):
    """Entry by entry."""
    a, b = p[0] * q[0], None
    (x, y), (u, v) = halves(p[0]), halves(q[0])
    b = ((x * u - a) + x * v + y * u) + y * v
    return two_sum(a, b + (p[0] * q[1] + p[1] * q[0]))


def slices(p, axis: int, bits: int, count: int) -> list[np.ndarray]:
    """``p`` as a sum of matrices of at most ``bits`` bits below the largest entry of each row (axis 1) or column (0)."""
    hi, lo = p[0].copy(), p[1].copy()
    out = []
    for _ in range(count):
        top = np.abs(hi).max(axis=axis, keepdims=True)
        if not top.any():
            break
        step = np.where(top > 0, 2.0 ** (np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 53 - bits), 0.0)
        part = (hi + step) - step
        out.append(part)
        hi, lo = two_sum(hi - part, lo)
    return out


def matmul(p, q):
    """Product of two pair matrices: BLAS products of slices, each without rounding, added in pairs, smallest first."""
    bits = (53 - max(1, ceil(log2(p[0].shape[1])))) // 2
    count = -(-108 // bits)
    left, right = slices(p, 1, bits, count), slices(q, 0, bits, count)
    out = (np.zeros((p[0].shape[0], q[0].shape[1])),) * 2
    for i, j in sorted(((i, j) for i in range(len(left)) for j in range(len(right)) if i + j < count), key=sum, reverse=True):
        out = add(out, (left[i] @ right[j], 0.0))
    return out


def rotated(p, q: np.ndarray):
    return matmul(p, (q, np.zeros_like(q)))


# ------------------------------------------------------------- the eigenproblem

def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more rising values whose neighbours are at most ``near`` apart."""
    order = np.argsort(values, kind="stable")
    breaks = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, breaks) if len(run) > 1]


def eigenvectors(v, rounds: int = 40):
    """(eigenvalues, eigenvectors) of the symmetric pair matrix ``v``, largest eigenvalue first, rounded to double."""
    size = len(v[0])
    scale = 2.0 ** -ceil(log2(max(np.abs(v[0]).max(), 1e-300)))
    v = (v[0] * scale, v[1] * scale)
    norm = np.abs(v[0]).sum(1).max()
    x = np.linalg.eigh(v[0].astype(np.float32))[1].astype(np.float64)
    x = (x, np.zeros_like(x))
    eye = (np.eye(size), np.zeros((size, size)))
    off = ~np.eye(size, dtype=bool)
    before = np.inf
    for _ in range(rounds):
        xt = (x[0].T, x[1].T)
        r = add(eye, tuple(-t for t in matmul(xt, x)))
        s = matmul(xt, matmul(v, x))
        diag = (np.diag(s[0]).copy(), np.diag(s[1]).copy())
        rd = (np.diag(r[0]).copy(), np.diag(r[1]).copy())
        one_more = add((np.ones(size), np.zeros(size)), add(rd, times(rd, rd)))     # 1 / (1 - r) to the third order
        value = times(diag, one_more)
        gap = add((value[0][None, :], value[1][None, :]), (-value[0][:, None], -value[1][:, None]))[0]
        error = np.linalg.norm((s[0] * off)) + norm * np.linalg.norm(r[0])
        near = 2 * error + norm * 2.0 ** -96
        top = add(s, times((value[0][None, :] + 0 * s[0], value[1][None, :] + 0 * s[0]), r))[0]
        apart = np.abs(gap) > near
        e = np.where(apart, top / np.where(apart, gap, 1.0), r[0] / 2)
        x = add(x, rotated(x, e))
        for run in clusters(value[0] + value[1], near):
            own = (x[0][:, run], x[1][:, run])
            small = matmul((own[0].T, own[1].T), matmul(v, own))
            mean = float(np.diag(small[0]).mean())
            small = add(small, (-mean * np.eye(len(run)), np.zeros((len(run),) * 2)))[0]
            if np.abs(small).max() <= norm * 2.0 ** -92:
                continue                                                 # equal as far as the pairs can tell
            own = rotated(own, np.linalg.eigh((small + small.T) / 2)[1])
            x[0][:, run], x[1][:, run] = own
        change = np.abs(e).max()
        if change < 2.0 ** -60 or (change < 2.0 ** -50 and change >= before):
            break
        before = change
    order = np.argsort(-(value[0] + value[1]), kind="stable")
    vectors = x[0][:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(size)])
    return value[0][order] / scale, vectors


def exact_pair(top: int, bottom: int) -> tuple[float, float]:
    """top / bottom as hi + lo; Python's division of integers rounds correctly."""
    hi = top / bottom
    a, b = hi.as_integer_ratio()
    return hi, (top * b - a * bottom) / (bottom * b)


# ------------------------------------------------------------- passes over the vectors

def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(_id, _v)``: vectors of finite entries below 2**40, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    return vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_v").isNotNull() & fine)


def groups_of_rows(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their integer vectors without OFFSET as a matrix) per vector length, at most ROWS rows at once."""
    lists = batch.column(batch.schema.get_field_index("_v"))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    for n in np.unique(size) if width is None else [width]:
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), ROWS):
            own = rows[at: at + ROWS]
            yield own, np.floor(SCALE * flat[first[own][:, None] + np.arange(n)]).astype(np.int64)


def as_decimals(values) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))


def sums(rows: DataFrame) -> DataFrame:
    """(width, i, n, total): entry i of the vectors of each length, summed."""
    def run(batches):
        count, total = {}, {}
        for batch in batches:
            for _, x in groups_of_rows(batch):
                w = x.shape[1]
                count[w] = count.get(w, 0) + len(x)
                total[w] = total.get(w, 0) + x.sum(0).astype(object)     # LARGEST * 64 * ROWS < 2**63
        for w in count:
            yield pa.RecordBatch.from_arrays([pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()),
                                              pa.array([count[w]] * w, pa.int64()), as_decimals(total[w])],
                                             names=["width", "i", "n", "total"])
    parts = rows.mapInArrow(run, "width int, i int, n long, total decimal(38,0)")
    return parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y'y of integers as Python integers; BLAS on parts small enough to be exact."""
    largest = int(np.abs(y).max(initial=0))
    if largest < 1 << 24:
        step = max(1, (EXACT - 1) // max(1, largest * largest))
        return sum((f.T @ f).astype(np.int64).astype(object) for f in (y[a: a + step].astype(np.float64) for a in range(0, len(y), step)))
    hi, lo = y >> 24, y & ((1 << 24) - 1)                                # |hi| <= 2**23
    out = 0
    for a in range(0, len(y), 32):
        h, low = hi[a: a + 32].astype(np.float64), lo[a: a + 32].astype(np.float64)
        hh, hl, ll = ((p.T @ q).astype(np.int64).astype(object) for p, q in ((h, h), (h, low), (low, low)))
        out = out + (hh << 48) + ((hl + hl.T) << 24) + ll
    return out


def products(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """(i, j, total) for i <= j: centred entries i and j multiplied and summed, exactly."""
    width = len(centre)

    def run(batches):
        gram, held, bound = 0, np.zeros((width, width), np.int64), 0
        for batch in batches:
            for _, x in groups_of_rows(batch, width):
                y = x - centre
                most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
                if most >= EXACT:
                    gram = gram + exact_gram(y)
                    continue
                f = y.astype(np.float64)
                if bound + most >= 1 << 62:
                    gram, held, bound = gram + held.astype(object), held * 0, 0
                held, bound = held + (f.T @ f).astype(np.int64), bound + most
        gram = gram + held.astype(object)
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), as_decimals(gram[i, j])], names=["i", "j", "total"])
    parts = rows.mapInArrow(run, "i int, j int, total decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("total").alias("total"))


class Whitening:
    """A fitted whitening: everything ``transform`` needs, a few numbers per dimension and component."""

    def __init__(self, n: int, centre: np.ndarray, rest: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.centre, self.rest = n, centre, rest                 # mean of x - OFFSET = centre + rest / n
        self.values, self.vectors, self.trace = values, vectors, trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n (x - mean) of integer vectors without OFFSET, as integers (Python's where a long could overflow)."""
        y = x - self.centre
        most = int(np.abs(y).max(initial=0)) * self.n + int(max(map(abs, self.rest), default=0))
        if most < 1 << 62:
            return y * np.int64(self.n) - self.rest.astype(np.int64)
        return y.astype(object) * self.n - self.rest

    def project(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame) -> Whitening | None:
    """Fit on all of ``usable``'s rows; None where there is no variance."""
    per_entry = C.stored(sums(rows), "whitening-sums")
    widest = per_entry.where("i = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return None
    n, width = widest["n"], widest["width"]
    total = {r["i"]: int(r["total"]) for r in per_entry.where(F.col("width") == width).collect()}
    total = np.array([total[i] for i in range(width)], object)
    centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)          # nearest integer
    rest = np.array([t - n * int(c) for t, c in zip(total, centre)], object)
    gram = np.zeros((width, width), object)
    for r in products(rows, centre).collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = int(r["total"])
    top = n * gram - np.outer(rest, rest)                                          # n^2 times the covariance, exact
    hi, lo = np.zeros((width, width)), np.zeros((width, width))
    for i in range(width):
        for j in range(i + 1):
            hi[i, j], lo[i, j] = hi[j, i], lo[j, i] = exact_pair(int(top[i, j]), n * n)
    trace = int(np.trace(top)) / (n * n)
    if trace <= 0:
        return None
    values, vectors = eigenvectors((hi, lo))
    keep = int((values > trace * 2.0 ** -80).sum())
    keep = min(keep, COMPONENTS)
    return Whitening(n, centre, rest, values[:keep], vectors[:, :keep], trace)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity; their sums take part, so that what is left of
    their mean is subtracted too."""
    width, k = len(w.centre), len(w.values)

    def run(batches):
        gram = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in groups_of_rows(batch, width):
                p = np.concatenate([w.project(w.centred(x)), np.ones((len(x), 1))], axis=1)
                gram += p.T @ p
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(gram[i, j])], names=["i", "j", "total"])
    got = rows.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    gram = np.zeros((k + 1, k + 1))
    for r in got.collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["total"]
    mean = gram[:k, k] / w.n
    return float(np.abs(gram[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = "_id long, component int, n long, deviation long, whitened double, explained double"


def transform(rows: DataFrame, w: Whitening) -> DataFrame:
    """One row per vector and component."""
    width, k = len(w.centre), len(w.values)
    explained = w.values / w.trace

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id"))
            for own, x in groups_of_rows(batch, width):
                z = w.centred(x)
                if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * width < 1 << 63:
                    deviation = pa.array((z * z).sum(1), pa.int64())
                else:
                    far = [int(t) for t in (z.astype(object) ** 2).sum(1)]
                    deviation = pa.array([t if t < 1 << 63 else None for t in far], pa.int64())
                row = pa.array(np.repeat(np.arange(len(own)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)).take(row), pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()),
                     pa.array(np.full(len(row), w.n), pa.int64()), deviation.take(row), pa.array(w.project(z).ravel()),
                     pa.array(np.tile(explained, len(own)))], names=[f.split()[0] for f in WHITENED.split(", ")])

    return rows.mapInArrow(run, WHITENED)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Fit and apply: ``(id, component, n, deviation, whitened, explained, identity_error)``."""
    rows = usable(vectors, id_col, vec_col)
    w = fit(rows)
    if w is None:
        return rows.sparkSession.createDataFrame([], WHITENED + ", identity_error double").withColumnRenamed("_id", id_col)
    return transform(rows, w).withColumn("identity_error", F.lit(identity_error(rows, w))).withColumnRenamed("_id", id_col)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    return whiten(C.table(spark, sf_dir, "embeddings"))
