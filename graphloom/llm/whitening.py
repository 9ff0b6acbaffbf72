"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors become whole numbers (``SCALE`` times an entry, rounded down, plus ``SHIFT``), written once; their number n and sums S are exact. The covariance
is never formed: a pass over the rows multiplies the centred rows X with a block Q of at most ``BLOCK`` columns and sums Xᵀ(XQ), task by task, then slot by slot, so that the
driver gets a few blocks. There the new block is made orthogonal by QR against the blocks so far, and Rayleigh-Ritz on all of them gives values and vectors; the
residuals of the Ritz vectors are the next block. Keeping the blocks is what makes a flat spectrum converge: with one block the error shrinks by the ratio of two neighbouring eigenvalues a pass, with all of them as the
Krylov space grows, and the blocks span the whole space after width / BLOCK passes. Once they have ``MOST_COLUMNS`` columns the best half is kept. The iteration ends when the residuals of all k components are at most ``TOLERANCE`` of the
largest value; a last pass takes their residuals, and the covariance of the whitened rows, from the rows once more.

Rows whose vector is null, or has null, NaN, infinite or more than 2**40-fold entries, go, as do vectors that have not the commonest length (of two, the smaller). A component
without variance (below 1e-13 of the trace) has null ``whitened`` and explains 0. A deviation that no long holds is null. Repeated rows and ids count each; null ids stay. Empty tables give
empty results. Vectors of up to some 10,000 entries are meant: tasks and driver hold MOST_COLUMNS of them. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS, BLOCK, MOST_COLUMNS = 8, 16, 512
TOLERANCE, MOST_PASSES = 1e-13, 400
#: Larger entries (times SCALE) are taken as broken.
LARGEST = 1 << 50
#: So many partial sums come to the driver at most.
SLOTS = 64


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list, their sums, the trace of their covariance, values and vectors (columns) of its first components, how far they miss
    (a share of the largest value), and the passes made."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    identity_error: float
    passes: int


def whole_numbers(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x: the rows that are not dropped for their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            batch = batch.filter(pc.and_(pc.is_valid(column), pc.greater(pc.fill_null(pc.list_value_length(column), 0), 0)))
            column = batch.column(1)
            if not batch.num_rows:
                continue
            flat = column.flatten()
            entries = np.floor(SCALE * np.asarray(pc.fill_null(flat, float("nan"))))
            first = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(column)))))
            good = np.isfinite(entries) & (np.abs(entries) <= LARGEST)
            x = np.where(good, entries, 0).astype(np.int64) + SHIFT
            keep = np.logical_and.reduceat(good, first[:-1])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "x"]).filter(pa.array(keep))

    return rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[embedding].cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, x array<long>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def sums_of(x: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their exact sums (one row an entry comes to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                low, high = (m & 0xFFFFF).sum(0), (m >> 20).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(np.append(low, len(m))), pa.array(np.append(high, 0))], ["i", "low", "high"])

    wide = "decimal(38,0)"
    found = x.select("x").mapInArrow(run, "i long, low long, high long").groupBy("i").agg(F.sum(F.col("low").cast(wide) + F.col("high").cast(wide) * 1048576).alias("s")).collect()
    sums = {r.i: int(r.s) for r in found}
    return sums.get(width, 0), np.array([sums.get(i, 0) for i in range(width)], object)


def centred(m: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once where n*x fits 63 bits."""
    if n * max(int(np.abs(m).max(initial=0)), 1) < 1 << 62:
        return (m * n - sums.astype(np.int64)) / n
    return m - (sums / n).astype(np.float64)


def _summed(x: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all batches of what make gives for the centred rows of one (size numbers): summed in a task, then in a slot of tasks, then here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_rows = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, any_rows = total + make(_matrix(batch.column(0))), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS]), pa.array([total.tobytes()])], ["slot", "held"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for held in batch.column("held"):
                total = total + np.frombuffer(held.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["held"])

    parts = x.select("x").mapInArrow(run, "slot long, held binary").groupBy("slot").applyInArrow(meet, "held binary").collect()
    return sum((np.frombuffer(r.held) for r in parts), np.zeros(size))


def fit(x: DataFrame, width: int, components: int = COMPONENTS, block: int = BLOCK, most_columns: int = MOST_COLUMNS) -> Whitening:
    """x: rows of whole-number vectors of one width."""
    n, sums = sums_of(x, width)
    k = min(components, width)
    block = min(max(block, k), width)
    if not n:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0, 0)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        """Xᵀ(XQ) / n over the rows, and the trace of the covariance."""

        def make(m: np.ndarray) -> np.ndarray:
            c = centred(m, n, sums)
            return np.append((c.T @ (c @ q)).ravel(), np.einsum("ij,ij->", c, c))

        total = _summed(x, make, width * q.shape[1] + 1) / n
        return total[:-1].reshape(width, -1), float(total[-1])

    rng = np.random.default_rng(0)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    new, passes, last, slow = rng.standard_normal((width, block)), 0, np.inf, 0
    while True:
        new = new[:, : width - basis.shape[1]]
        for _ in range(3):  # once is not enough in floating point; columns that vanish are drawn anew
            new = new - basis @ (basis.T @ new)
            new, r = np.linalg.qr(new)
            gone = np.abs(np.diag(r)) < 1e-10 * max(np.abs(np.diag(r)).max(), 1e-300)
            new[:, gone] = rng.standard_normal((width, int(gone.sum())))
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        image, trace = product(new)
        passes += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        wanted = turn[:, : max(block, k)]
        rest = images @ wanted - (basis @ wanted) * value[: wanted.shape[1]]
        error = float(np.linalg.norm(rest[:, :k], axis=0).max() / max(value[0], 1e-300)) if trace > 0 else 0.0
        slow = slow + 1 if error > last / 2 else 0
        last = min(last, error)
        # Sums of many rows may leave a little more than the tolerance: then no pass makes it less.
        if error <= TOLERANCE or basis.shape[1] >= width or (error <= 100 * TOLERANCE and slow >= 3):
            break
        if passes >= MOST_PASSES:
            raise RuntimeError(f"the components miss by {error} after {passes} passes")
        if basis.shape[1] + block > most_columns:
            held = turn[:, : most_columns // 2]
            basis, images = basis @ held, images @ held
        new = rest
    values, vectors = value[:k], np.linalg.qr(basis @ turn[:, :k])[0]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    scale = np.where(values > 1e-13 * trace, np.sqrt(np.maximum(values, 1e-300)), np.inf)

    def check(m: np.ndarray) -> np.ndarray:
        c = centred(m, n, sums)
        p = c @ vectors
        w = p / scale
        return np.concatenate([(c.T @ p).ravel(), (w.T @ w).ravel()])

    total = _summed(x, check, width * k + k * k) / n
    residual = float(np.linalg.norm(total[: width * k].reshape(width, k) - vectors * values, axis=0).max() / max(values[0], 1e-300)) if trace > 0 else 0.0
    miss = np.abs(total[width * k :].reshape(k, k) - np.diag(np.isfinite(scale).astype(float)))
    return Whitening(n, sums, trace, np.where(np.isfinite(scale), values, 0.0), vectors, residual, float(miss.max()), passes + 1)


def deviations(m: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of the squares of n*x - S, exact; none where a long does not hold it."""
    if n * max(int(np.abs(m).max(initial=0)), 1) < 1 << 62:
        d = m * n - sums.astype(np.int64)
        near = np.einsum("ij,ij->i", d.astype(np.float64), d.astype(np.float64))
        if near.max(initial=0) < 2.0**62:
            return np.einsum("ij,ij->i", d, d).tolist()
    exact = ((m.astype(object) * n - sums) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each vector and component; residual and passes tell of the fit."""
    x, _ = written(whole_numbers(rows, vec_id, embedding), "vectors")
    lengths = cut(x.groupBy(F.size("x").alias("width")).count())
    widest = lengths.orderBy(F.desc("count"), "width").first()
    width = widest.width if widest else 1
    if lengths.limit(2).count() > 1:
        x = x.where(F.size("x") == width)
    w = fit(x, width, components, block, most_columns)
    k = len(w.values)
    live = w.values > 0
    turn = w.vectors / np.where(live, np.sqrt(np.where(live, w.values, 1.0)), 1.0)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            scores = centred(m, w.n, w.sums) @ turn
            r, at = len(m), np.repeat(np.arange(len(m)), k)
            full = lambda v: pa.array(np.full(r * k, v))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), full(np.int64(w.n)), pa.array(deviations(m, w.n, w.sums), pa.int64()).take(pa.array(at)),
                pa.array(scores.ravel(), mask=~np.tile(live, r)), pa.array(np.tile(explained, r)), full(w.identity_error), full(w.residual), full(np.int32(w.passes)),
            ], names)

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, passes int"
    names = [c.split()[0] for c in schema.split(", ")]
    return x.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
