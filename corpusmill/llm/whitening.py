"""Whitening of embeddings by principal components from a cyclic Jacobi method.

Entries are put on a grid of whole numbers, so counts, sums and the scatter are exact whatever way rows
are dealt: tasks centre their rows on the rounded mean and multiply integers, Spark adds the tasks' parts
entry by entry, and the driver, which sees one number for each pair of dimensions, takes out what the rounding of the
mean left in. There, symmetric Jacobi rotations sweep over all pairs of dimensions until no entry off the
diagonal counts beside its two diagonal ones, a test relative to the entries, so that small eigenvalues
are as accurate as large ones. The whitening matrix (dimensions times components) is sent to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, table

COMPONENTS = 32
#: An entry c stands for the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers up to here are exact in a double.
EXACT = 2**53
#: Sweeps after which a matrix that doesn't settle is an error.
SWEEPS = 60
DECIMAL = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < infinite), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _matrix(column: pa.Array, rows: int, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, width)


def _grid(column: pa.Array, rows: int, width: int) -> np.ndarray:
    """Whole numbers of the entries, without the offset."""
    z = np.floor(SCALE * _matrix(column, rows, width))
    if np.abs(z).max(initial=0) + OFFSET >= EXACT:
        raise ValueError("an entry is too large for the grid")
    return z.astype(np.int64)


def _products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` in whole numbers: as doubles where those are exact, as Python's integers beyond."""
    if z.size and int(np.abs(z).max()) ** 2 * len(z) < EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = z.astype(object)
    return o.T @ o


def _summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], kind: pa.DataType, sql: str) -> dict[int, object]:
    """Sums of the arrays that ``run`` yields, by place: tasks send one row, Spark adds the places up."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in run(batches):
            held = [Decimal(int(v)) for v in values] if sql.startswith("decimal") else values
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(kind))], names=["part"])

    placed = rows.mapInArrow(parts, f"part array<{sql}>").select(F.posexplode("part").alias("place", "v"))
    return {r["place"]: r["v"] for r in placed.groupBy("place").agg(F.sum("v").cast(sql).alias("v")).collect()}  # a row for each place


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix.

    A sweep meets every pair of dimensions once, in rounds of disjoint pairs (dimensions sit at a round
    table and move on by one seat), so that the rotations of a round are applied together.
    """
    n = len(matrix)
    a, u = np.array(matrix, dtype=np.float64), np.eye(n)
    seats = list(range(n)) + ([-1] if n % 2 else [])  # -1: an empty seat
    half, eps = len(seats) // 2, np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        settled = True
        for _ in range(max(1, len(seats) - 1)):
            pairs = [(x, y) for x, y in zip(seats[:half], seats[: half - 1 : -1], strict=True) if x >= 0 and y >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = (np.array([x[i] for x in pairs], dtype=np.int64) for i in (0, 1))
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > eps * np.sqrt(np.abs(dp * dq))
            if not turn.any():
                continue
            settled = False
            p, q, off, dp, dq = p[turn], q[turn], off[turn], dp[turn], dq[turn]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, u):
                cols_p, cols_q = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            a[p, q] = a[q, p] = 0.0
        if settled:
            values = np.diag(a)
            order = np.argsort(-values, kind="stable")
            return values[order], u[:, order]
    raise ArithmeticError("the rotations don't settle")


@dataclass
class Whitening:
    """What ``fit`` found: exact count and sums on the grid, eigenvalues, eigenvectors and the share each explains."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, rows: DataFrame) -> DataFrame:
        """(vec_id, deviation, whitened array) of ``rows(vec_id, v)`` with usable vectors of the fitted length."""
        n, width = self.n, len(self.sums)
        centre = self.centre
        left = np.array([s - n * (int(c) + OFFSET) for s, c in zip(self.sums, centre, strict=True)], dtype=np.int64)  # at most n / 2 each
        matrix = self.vectors / np.sqrt(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = _grid(batch["v"], batch.num_rows, width) - centre
                most = n * (int(np.abs(z).max()) + 1)
                if most * most * width < 2**63:
                    y = n * z - left
                    deviation = pa.array((y * y).sum(axis=1))
                else:
                    y = n * z.astype(object) - left
                    exact = (y * y).sum(axis=1)
                    if max(exact) >= 2**63:
                        raise OverflowError("a deviation exceeds a long")
                    deviation = pa.array(exact.tolist(), pa.int64())
                w = (y.astype(np.float64) / n) @ matrix
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

        return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of ``rows(vec_id, v)``, or None for an empty table.

    Covariances have the divisor n. Components without variance (beside the largest, in double precision)
    are left out. Vectors of different lengths are an error.
    """
    sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if not sizes["n"]:
        return None
    if sizes["low"] != sizes["high"]:
        raise ValueError(f"vectors have from {sizes['low']} to {sizes['high']} entries")
    n, width = sizes["n"], sizes["high"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros(width, dtype=object)
        for batch in batches:
            if batch.num_rows:
                out = out + _grid(batch["v"], batch.num_rows, width).astype(object).sum(axis=0)
        yield out

    found = _summed(rows, totals, DECIMAL, "decimal(38,0)")
    grid = [int(found[i]) for i in range(width)]
    centre = np.array([(2 * s + n) // (2 * n) for s in grid], dtype=np.int64)  # rounded means
    upper = np.triu_indices(width)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((width, width), dtype=object)
        for batch in batches:
            if batch.num_rows:
                out = out + _products(_grid(batch["v"], batch.num_rows, width) - centre)
        yield out[upper]

    found = _summed(rows, scatter, DECIMAL, "decimal(38,0)")
    left = [s - n * int(c) for s, c in zip(grid, centre, strict=True)]
    covariance = np.zeros((width, width))
    for place, (i, j) in enumerate(zip(*upper, strict=True)):
        covariance[i, j] = covariance[j, i] = (n * int(found[place]) - left[i] * left[j]) / (n * n)  # integers up to the one division
    values, vectors = jacobi(covariance)
    there = values > values[0] * width * np.finfo(np.float64).eps
    there[components:] = False
    whole = float(np.trace(covariance))
    return Whitening(n, [s + n * OFFSET for s in grid], centre, values[there], vectors[:, there], values[there] / whole if whole else values[there])


def identity_error(applied: DataFrame, n: int, width: int) -> float:
    """The largest entry, in size, of the whitened rows' covariance less the identity."""
    means = applied.select(F.posexplode("whitened").alias("place", "v")).groupBy("place").agg((F.sum("v") / n).alias("m")).collect()  # a row for each component
    centre = np.zeros(width)
    for r in means:
        centre[r["place"]] = r["m"]
    upper = np.triu_indices(width)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch["whitened"], batch.num_rows, width) - centre
                out += w.T @ w
        yield out[upper]

    found = _summed(applied.select("whitened"), scatter, pa.float64(), "double")
    return max(abs(found[place] / n - (i == j)) for place, (i, j) in enumerate(zip(*upper, strict=True)))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, ws: Workspace | None = None) -> DataFrame:
    """A row for each usable vector and component, see ``SCHEMA``.

    Null and empty vectors, and those with null or non-finite entries, are dropped; null keys stay null;
    repeated rows count, and come out, as often as they occur; extra columns are ignored. An empty table, or
    one of equal vectors, has no components and gives no rows.
    """
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "whitening")
    rows = vectors.filter(usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    model = fit(rows, components)
    width = 0 if model is None else len(model.values)
    if not width:
        return spark.createDataFrame([], SCHEMA)
    applied = ws.save(model.apply(rows), "whitened")
    error = identity_error(applied, model.n, width)
    shares = F.array(*(F.lit(float(e)) for e in model.explained))
    out = applied.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(table(spark, sf_dir, "embeddings"))
