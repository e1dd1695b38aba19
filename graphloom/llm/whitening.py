"""Whitening of embeddings from an exact scatter matrix.

Entries become whole numbers. Each task multiplies its block of vectors by itself modulo several primes, in double-precision matrix products whose sums stay below 2^53
and so are exact. Residues are added up by Spark, and Chinese remainders give the scatter matrix of all vectors as whole numbers of any size. Covariances follow
from it without rounding but the last, and their eigenvectors from LAPACK in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An entry c is the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100000
#: Primes are below this; so many rows are multiplied at once that sums of products of residues are exact doubles.
PRIME_LIMIT = 1 << 21
ROWS = (1 << 53) // PRIME_LIMIT**2
LONG = 1 << 63


def primes(product: int) -> list[int]:
    """The largest primes below PRIME_LIMIT, as many as it takes for their product to exceed product."""
    out, at, reached = [], PRIME_LIMIT - 1, 1
    while reached <= product:
        if all(at % d for d in range(3, math.isqrt(at) + 1, 2)):
            out.append(at)
            reached *= at
        at -= 2
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues."""
    product = math.prod(moduli)
    x = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % product
    return x - product if 2 * x > product else x


class Fit(NamedTuple):
    """Whitening of vectors of one length: their number and sums, eigenvalues (falling) and unit eigenvectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def numbers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole numbers of each vector that has neither null nor non-finite entries nor any whose number is no long. Empty vectors go, having no component."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < LONG / SCALE / 2))  # false for NaN, which is above all numbers, and infinity
    x = F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT)
    return vectors.select(F.col(id_col).alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(sound).select("vec_id", x.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], limit: int = ROWS) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of runs of rows of one length."""
    for batch in batches:
        x = batch.column("x")
        size = np.diff(x.offsets.to_numpy())
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            for k in range(0, len(at), limit):
                own = pa.array(at[k : k + limit])
                yield batch.column("vec_id").take(own), x.take(own).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scatter(x: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length of vectors: n, sums and the exact matrix of sums of products. Each task sends one row for each cell and prime; what the driver gets is bounded by the cells."""
    most = x.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).collect()  # a row for each length
    moduli = {r.dim: primes(2 * r.n * max(int(r.most), 1) ** 2 + 1) for r in most}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for _, block in matrices(batches):
            dim = block.shape[1]
            for k, p in enumerate(moduli[dim]):
                r = np.empty((len(block), dim + 1))
                r[:, :dim] = block % p
                r[:, dim] = 1  # the last row and column hold sums, the corner the count
                now = np.fmod(r.T @ r, p)
                sums[dim, k] = np.fmod(sums[dim, k] + now, p) if (dim, k) in sums else now
        for (dim, k), matrix in sums.items():
            i, j = np.triu_indices(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(matrix[i, j].astype(np.int64))], ["dim", "k", "i", "j", "r"])

    cells = x.mapInArrow(run, "dim int, k int, i int, j int, r long").groupBy("dim", "i", "j", "k").agg(F.sum("r").alias("r"))
    found: dict[tuple[int, int, int], dict[int, int]] = {}
    for c in cells.collect():
        found.setdefault((c.dim, c.i, c.j), {})[c.k] = c.r
    out = {}
    for dim, p in moduli.items():
        whole = [[0] * (dim + 1) for _ in range(dim + 1)]
        for i in range(dim + 1):
            for j in range(i, dim + 1):
                whole[i][j] = whole[j][i] = remaindered([found[dim, i, j][k] % q for k, q in enumerate(p)], p)
        out[dim] = whole[dim][dim], whole[dim][:dim], [row[:dim] for row in whole[:dim]]
    return out


def fit(x: DataFrame) -> dict[int, Fit]:
    """A Fit for each length of vectors. n^2 times a covariance is a whole number; dividing it rounds once."""
    out = {}
    for dim, (n, sums, products) in scatter(x).items():
        cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / n**2 for j in range(dim)] for i in range(dim)])
        values, vectors = np.linalg.eigh(cov)
        trace = (n * sum(products[i][i] for i in range(dim)) - sum(s * s for s in sums)) / n**2
        out[dim] = Fit(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), trace)
    return out


def components(f: Fit, most: int) -> int:
    """Components that have variance (beyond rounding), most at most."""
    return int((f.values[:most] > 8 * len(f.values) * np.finfo(float).eps * max(f.values[0], 0)).sum())


def projected(block: np.ndarray, f: Fit, count: int) -> np.ndarray:
    """Whitened values: rows less the mean, which is split into a whole number and a fraction so that nothing cancels."""
    base = [s // f.n for s in f.sums]
    rest = np.array([(s - f.n * b) / f.n for s, b in zip(f.sums, base, strict=True)])
    return ((block - np.array(base)) - rest) @ (f.vectors[:, :count] / np.sqrt(f.values[:count]))


def deviations(block: np.ndarray, f: Fit) -> list[int | None]:
    """Sums of (n x - sum)^2 of each row, exact; None where one is above all longs."""
    base = [s // f.n for s in f.sums]
    rest = [s - f.n * b for s, b in zip(f.sums, base, strict=True)]
    d = block - np.array(base)
    squares = sum(r * r for r in rest)
    if float(np.abs(d).max(initial=1)) ** 2 * d.shape[1] * max(f.n, 1) < 2**62:
        a, b = (d * d).sum(1).tolist(), (d @ np.array(rest, np.int64)).tolist()  # below 2^63, as rests are below n
    else:
        exact = [[int(v) for v in row] for row in d]
        a, b = ([sum(v * w for v, w in zip(row, other, strict=True)) for row, other in zip(exact, others, strict=True)] for others in (exact, [rest] * len(exact)))
    out = [f.n * f.n * u - 2 * f.n * v + squares for u, v in zip(a, b, strict=True)]
    return [v if v < LONG else None for v in out]


def identity_errors(x: DataFrame, fits: dict[int, Fit], most: int) -> dict[int, float]:
    """For each length: the largest entry of the whitened values' covariance less the identity. Each task centres its own values before it multiplies; tasks are merged by their means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for _, block in matrices(batches, 1 << 14):
            f = fits[block.shape[1]]
            w = projected(block, f, components(f, most))
            held[block.shape[1]] = merged(held.get(block.shape[1]), (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        rows = [(dim, n, mean.tolist(), m2.ravel().tolist()) for dim, (n, mean, m2) in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["dim", "n", "mean", "m2"])

    held: dict[int, tuple] = {}
    # a row of some hundred bytes for each task and length
    for r in x.mapInArrow(run, "dim int, n long, mean array<double>, m2 array<double>").collect():
        held[r.dim] = merged(held.get(r.dim), (r.n, np.array(r.mean), np.array(r.m2).reshape(len(r.mean), len(r.mean))))
    return {dim: float(np.abs(m2 / n - np.eye(len(mean))).max(initial=0)) for dim, (n, mean, m2) in held.items()}


def merged(a: tuple | None, b: tuple) -> tuple:
    """Number, mean and centred scatter of two sets together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each vector and component (of `most` with the largest eigenvalues): vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or have null or non-finite entries, or entries whose number exceeds a long, are left out. Vectors of each length are whitened among themselves.
    Components without variance have no rows, so equal vectors, or a single one, give none. deviation is null where it exceeds a long. Repeated rows and ids count each;
    other columns aren't read. An empty table gives an empty result.
    """
    x = numbers(vectors, id_col, vector)
    fits = fit(x)
    errors = identity_errors(x, fits, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in matrices(batches, 1 << 14):
            f = fits[block.shape[1]]
            count = components(f, most)
            rows = len(block)
            if count:
                repeated = pa.array(np.repeat(np.arange(rows), count))
                of = [
                    ids.take(repeated), pa.array(np.tile(np.arange(1, count + 1), rows), pa.int32()), pa.array(np.full(rows * count, f.n)), pa.array(deviations(block, f), pa.int64()).take(repeated),
                    pa.array(projected(block, f, count).ravel()), pa.array(np.tile(f.values[:count] / f.trace, rows)), pa.array(np.full(rows * count, errors[block.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(of, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, f"vec_id {dict(x.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
