"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it: a pass over the rows
multiplies it with a thin block Q, as XᵀXQ of the centred rows summed over all partitions.  A
round applies a Chebyshev polynomial of the covariance by its three-term recurrence (one pass a
degree), which stays small on the unwanted part of the spectrum and grows fast above it, then
orthonormalises the block (QR) and takes its Rayleigh-Ritz pairs.  It ends when the residual of
every wanted pair certifies it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convrec.llm.common import cut
from convrec.llm.vectors import usable


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # (dims, components), unit columns by falling eigenvalue
    values: np.ndarray
    trace: float
    passes: int
    residual: float


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` whole numbers each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """``(id, x)``: floor(scale * c) + shift of every component of the usable rows."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    whole = F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long"))
    return rows.filter(usable(F.col("v"))).select("id", whole.alias("x"))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly, the rest in doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The sum over all partitions of ``part(x)``, a matrix of ``width`` columns.  A task adds its
    batches up and emits one row per matrix row; Spark adds the tasks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = part(_rows(b.column(0), dims))
                total = m if total is None else total + m
        if total is not None:
            i = np.repeat(np.arange(len(total)), width)
            j = np.tile(np.arange(width), len(total))
            arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "s"])

    cells = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    got = cells.toPandas()  # dims * width numbers
    out = np.zeros((int(got["i"].max()) + 1 if len(got) else 0, width))
    out[got["i"], got["j"]] = got["s"]
    return out


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums of every component (summed as decimals: no overflow)."""
    parts = rows.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    got = {r["d"]: (int(r["s"]), r["n"]) for r in parts.collect()}  # one row per dimension
    return (got[0][1] if got else 0), [got[d][0] for d in range(dims)]


def leading_pairs(
    rows: DataFrame, n: int, sums: list[int], k: int, extra: int = 8, degree: int = 10, tolerance: float = 1e-13, rounds: int = 60, seed: int = 7
) -> Whitening:
    """The k leading eigenpairs of the covariance of ``rows`` (id, x), or as many as its rank."""
    dims = len(sums)
    width = min(dims, k + extra)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return summed(rows, q.shape[1], part, dims) / n

    def lowest(steps: int = 10) -> float:
        """A bound below the spectrum: the least Ritz value of a few Lanczos steps less the norm of
        what they leave."""
        basis = [np.random.default_rng(seed + 1).standard_normal(dims)]
        basis[0] /= np.linalg.norm(basis[0])
        t = np.zeros((steps, steps))
        rest = 0.0
        for j in range(steps):
            w = times(basis[j][:, None])[:, 0]
            t[j, j] = basis[j] @ w
            for b in basis + basis:
                w -= (b @ w) * b
            rest = float(np.linalg.norm(w))
            if j + 1 == steps or rest <= 1e-12 * abs(t[0, 0]):
                break
            t[j, j + 1] = t[j + 1, j] = rest
            basis.append(w / rest)
        m = len(basis)
        return max(0.0, float(np.linalg.eigvalsh(t[:m, :m])[0]) - rest)

    trace = float(summed(rows, 1, lambda x: np.square(centred(x, n, sums)).sum(axis=0)[:, None], dims).sum() / n)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    aq = times(q)
    low = lowest(min(10, dims)) if width < dims else 0.0
    residual = last = np.inf
    for _ in range(rounds):
        e, z = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        e, z = e[::-1], z[:, ::-1]
        q, aq = q @ z, aq @ z
        wanted = int((e[:k] > 1e-12 * max(trace, 1e-300)).sum())
        residual = float(np.linalg.norm(aq - q * e, axis=0)[:wanted].max(initial=0.0) / max(e[0], 1e-300))
        settled = residual <= 1e-10 and residual > last / 2  # as far as sums in doubles go
        if residual <= tolerance or settled or not wanted or width == dims:
            break
        last = residual
        # the interval to damp: from the bound below the spectrum to the smallest Ritz value
        high = max(e[-1], 1e-12 * e[0])
        bottom = min(low, 0.99 * high)
        middle, half = (high + bottom) / 2, (high - bottom) / 2
        grow = half / (e[0] - middle)
        before, now, rate = q, (aq - middle * q) * (grow / half), grow
        for _ in range(degree - 1):
            following = 1 / (2 / grow - rate)
            before, now = now, (times(now) - middle * now) * (2 * following / half) - before * (rate * following)
            rate = following
        q = np.linalg.qr(now)[0]
        aq = times(q)
    else:
        if residual > 1e-9:
            raise RuntimeError(f"eigenvectors not certified after {rounds} rounds: residual {residual}")
    return Whitening(n, sums, q[:, :wanted], e[:wanted], trace, passes, residual)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 32, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: every usable row
    projected on each of the k leading components of the covariance of all of them, over the
    square root of its eigenvalue.

    ``deviation`` is the row's sum of (n*x - S)^2 over the dimensions, exact.  ``identity_error``
    is measured in a last pass: the largest entry by which the covariance of the whitened rows
    departs from the identity.  The driver holds dims x (k + 8) numbers.

    Defined cases: null vector, null or non-finite component: no part; rows that repeat an id,
    and rows without one, are rows like any other; vectors of different length: missing
    components count as 0 before the shift; components without variance (eigenvalue 0, as when n is
    small) are left out, so identical rows give an empty result; a deviation beyond 64 bits is
    null; empty table: empty result; other columns are ignored."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_col, vec_col, scale, shift)
    dims = rows.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    fill = F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x"))
    rows = cut(rows.select("id", F.concat("x", fill).alias("x")))
    n, sums = column_sums(rows, dims)
    model = leading_pairs(rows, n, sums, k)
    parts = len(model.values)
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    project = model.vectors / np.sqrt(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ project
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    second = summed(rows, parts, moments, dims) / n
    error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(parts)).max())
    explained = model.values / model.trace

    def deviations(x: np.ndarray) -> list[int | None]:
        low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
        most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums))
        if most < 1 << 63:
            return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
        exact = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 2048):
                some = b.slice(begin, 2048)
                x = _rows(some.column(1), dims)
                w = centred(x, n, sums) @ project
                at = pa.array(np.repeat(np.arange(len(x)), parts))
                many = len(x) * parts
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(at),
                        pa.array(np.tile(np.arange(1, parts + 1), len(x)), pa.int32()),
                        pa.array(np.full(many, n), pa.int64()),
                        pa.array(deviations(x), pa.int64()).take(at),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(many, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
