"""Embedding whitening by shifted CholeskyQR.

The centred rows are orthogonalised by repeated distributed passes: each pass
solves the rows through the triangular factors found so far, adds up their Gram
matrix, and its Cholesky factor joins the list. The first factor is of the Gram
matrix plus a shift, so that nearly dependent dimensions don't break it; later
passes make up for the shift. The factors' product is R of the centred rows, and
its singular value decomposition gives the covariance's eigenvectors and values
without squaring the condition number.

Entries become the integers ``floor(64 c) + 1000000`` (held within +-2^40). Sums
and deviations are exact; rows are centred by the exact mean's whole and
fractional part before anything is multiplied.

Only d x d matrices reach the driver, however many rows there are: tasks send
one Gram matrix each, whose rows are added up in two levels.

Defined cases: vectors that are null or empty, or hold null or non-finite
entries, are dropped; so are those whose length is not the commonest (of equally
common ones, the longest); repeated rows and null ids take part like any other;
directions without variance (up to rounding) give no component, so one vector,
or only equal ones, give an empty result, and so does an empty table; a
deviation beyond 64 bits is null; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, OFFSET, MOST = 64.0, 1_000_000, 1 << 40
COMPONENTS = 32
#: Passes at most; directions of a Gram matrix below NULL are noise, within DONE of 1 orthonormal.
PASSES, NULL, DONE = 8, 1e-14, 1e-10
#: Tasks' matrices are added up in so many groups first.
SALTS = 64


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, integers)`` of the usable vectors of column 1."""
    lists = batch.column(1)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become nan
    starts = np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        c = values.reshape(-1, d) if len(rows) * d == len(values) else values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(c).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * c[good]) + OFFSET, -MOST, MOST).astype(np.int64)
            yield d, rows[good], x


@dataclass
class Centre:
    """Exact mean of the fit list: ``whole + part / n`` per dimension."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.d = len(self.sums)
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([s % self.n for s in self.sums], np.int64)

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places of the fit list's rows and their ``x - whole``."""
        for d, rows, x in _by_length(batch):
            if d == self.d:
                return rows, x - self.whole
        return np.zeros(0, np.int64), np.zeros((0, self.d), np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.part / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of ``(n x - S)^2`` of each row, exact."""
        if not len(x):
            return pa.array([], pa.int64())
        if self.d * (self.n * (float(np.abs(x).max()) + 1)) ** 2 < 2.0**62:
            z = x * self.n - self.part
            return pa.array((z * z).sum(axis=1))
        z = x.astype(object) * self.n - self.part.astype(object)
        return pa.array([v if v < 1 << 63 else None for v in (z * z).sum(axis=1)], pa.int64())


def solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``q`` with ``q r = y`` for an upper triangular r."""
    q = np.empty_like(y, order="F")
    for j in range(y.shape[1]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor, of the shifted matrix at first or where the matrix itself has none."""
    d = len(gram)
    norm = float(np.linalg.norm(gram, 2))
    shift = 11 * (min(n, 1 << 20) * d + d * (d + 1)) * 2.0**-53 * norm
    for s in [shift * 10.0**k for k in range(-3, 12)] if not shifted else [shift * 10.0**k for k in range(12)]:
        try:
            return np.linalg.cholesky(gram + s * np.eye(d)).T if shifted else np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            shifted = True
    raise ValueError("the Gram matrix is not finite")


def _gram(source: DataFrame, centre: Centre, columns: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over the fit list of the outer products of ``columns(centred rows)``, d x d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            q = columns(centre.centred(centre.rows(batch)[1]))
            total += q.T @ q
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "cells"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        cells = np.stack(part.column("cells").to_numpy()).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "cells": pa.array([cells], pa.list_(pa.float64()))})

    kind = "i int, salt int, cells array<double>"
    parts = source.mapInArrow(run, "i int, cells array<double>").withColumn("salt", F.spark_partition_id() % SALTS)
    rows = parts.groupBy("i", "salt").applyInArrow(add, kind).groupBy("i").applyInArrow(add, kind).collect()  # d rows of d
    out = np.zeros((d, d))
    for r in rows:
        out[r.i] = r.cells
    return (out + out.T) / 2


def _centre(source: DataFrame) -> Centre | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for d, rows, x in _by_length(batch):
                n[d] = n.get(d, 0) + len(rows)
                sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), x.sum(axis=0).tolist(), strict=True)]
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n[d]]), pa.array([[str(s) for s in sums[d]]], pa.list_(pa.string()))], ["d", "n", "sums"])

    parts = cut(source.mapInArrow(run, "d int, n long, sums array<string>"))
    top = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    if top is None:
        return None
    cells = parts.filter(F.col("d") == top.d).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return Centre(top.n, [int(r.s) for r in cells.orderBy("i").collect()])


@dataclass
class Whitening:
    """Components (columns), falling eigenvalues and the trace of the covariance of the fit list."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y @ self.components) / np.sqrt(self.values)


def _source(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long"), F.col(f"`{column}`").cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None where nothing varies."""
    source = _source(vectors, column)
    centre = _centre(source)
    if centre is None:
        return None
    factors: list[np.ndarray] = []
    trace = 0.0
    for k in range(PASSES):
        known = list(factors)

        def through(y: np.ndarray, known: list[np.ndarray] = known) -> np.ndarray:
            for r in known:
                y = solve(y, r)
            return y

        gram = _gram(source, centre, through, centre.d)
        if k == 0:
            trace = float(np.trace(gram)) / centre.n
            if trace == 0:
                return None
        factors.append(_factor(gram, centre.n, k == 0))
        left = np.linalg.eigvalsh(gram)
        if k and np.all((np.abs(left - 1) < DONE) | (left < NULL)):
            break
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, s, vt = np.linalg.svd(r)
    most = min(components, int((s > SCALE * centre.d * 2.0**-53 * s[0]).sum()))
    return Whitening(centre, np.ascontiguousarray(vt[:most].T), s[:most] ** 2 / centre.n, trace)


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per usable vector and component."""
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(vectors, components, column)
    if found is None:
        return vectors.sparkSession.createDataFrame([], kind)
    source, centre, m = _source(vectors, column), found.centre, len(found.values)
    error = float(np.abs(_gram(source, centre, found.project, m) / centre.n - np.eye(m)).max())
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = centre.rows(batch)
            k = len(rows)
            each = np.repeat(np.arange(k), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * m, centre.n)),
                    centre.deviation(x).take(pa.array(each)),
                    pa.array(found.project(centre.centred(x)).ravel()),
                    pa.array(np.tile(explained, k)),
                    pa.array(np.full(k * m, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(run, kind)
