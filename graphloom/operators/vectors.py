"""Vector search through an index: lists of coarse cells with product-quantised residuals, and an exact rerank of the candidates.

Centroids and codebooks are fitted on at most ``SAMPLE`` vectors (those with the least hash of their number, so a rerun takes the same); every vector is
in the index: its cell, and a byte for each ``PIECE`` entries of what its cell's centroid leaves of it. How many cells a query looks into, and how many candidates are compared exactly, are the
least that reach ``TARGET`` of the true neighbours of held-out vectors among the sample, so they depend on how the vectors lie and not on a constant: where nothing is clustered, most cells are read.

Lists are dealt by ranges of (cell, number), so that a large cell is many tasks' work and a query reads the files of its cells only. Similarity is the cosine; vectors without length score 0."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.retrieval import FEW_QUERIES, PLACES, _keep, top
from graphloom.operators.shared import cut, written

SAMPLE, HELD_OUT, TARGET = 20_000, 100, 0.97
PIECE, CODES, ITERATIONS, MOST_CELLS = 4, 256, 12, 1024


@dataclass(frozen=True)
class VectorIndex:
    """centres (cell, entry), books (piece, code, entry), lists (cell, doc, code), vectors (doc, e), and how far a search goes."""

    centres: np.ndarray
    books: np.ndarray
    lists: DataFrame
    vectors: DataFrame
    probes: int
    depth: float  # of the candidates in the probed cells, the share that is compared exactly, or so many times k if that is more

    def encode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _encode(e, self.centres, self.books)


def _unit(e: np.ndarray) -> np.ndarray:
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k-means; an empty one is put on a random point."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(ITERATIONS):
        of = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def _pieces(e: np.ndarray) -> np.ndarray:
    """(row, piece, entry), the last piece filled up with zeros."""
    pad = -e.shape[1] % PIECE
    return np.pad(e, ((0, 0), (0, pad))).reshape(len(e), -1, PIECE)


def _encode(e: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = (e @ centres.T - (centres**2).sum(1) / 2).argmax(1)
    rest = _pieces(e - centres[cell])
    near = np.einsum("npe,pce->npc", rest, books) - (books**2).sum(2) / 2
    return cell, near.argmax(2).astype(np.uint8)


def _rough(q: np.ndarray, cell: int, code: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(query, row): the products of queries with what the codes of one cell stand for."""
    table = np.einsum("qpe,pce->qpc", _pieces(q), books)
    return (q @ centres[cell])[:, None] + sum(table[:, p, code[:, p]] for p in range(code.shape[1]))


def _reach(e: np.ndarray, k: int, centres: np.ndarray, books: np.ndarray, rng: np.random.Generator) -> tuple[int, float]:
    """The least probes and depth with which held-out vectors find TARGET of their k nearest among e."""
    asks = e[rng.choice(len(e), min(HELD_OUT, len(e)), replace=False)]
    k = min(k, len(e))
    exact = asks @ e.T
    true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    cell, code = _encode(e, centres, books)
    order = np.argsort(np.argsort(-(asks @ centres.T), axis=1), axis=1)  # place of each cell for each query
    need = np.take_along_axis(order[:, cell], true, axis=1)
    probes = int(np.quantile(need, TARGET**0.5, method="higher")) + 1
    rough = np.empty_like(exact)
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        rough[:, at] = _rough(asks, c, code[at], centres, books)
    rough[order[:, cell] >= probes] = -np.inf
    place = np.argsort(np.argsort(-rough, axis=1), axis=1)
    found = np.where(np.take_along_axis(order[:, cell], true, axis=1) < probes, np.take_along_axis(place, true, axis=1), -1)
    return probes, float(np.quantile(found[found >= 0], TARGET**0.5, method="higher") + 1) / k


def vector_index(rows: DataFrame, vec: str = "vec_id", column: str = "embedding", k: int = 30) -> VectorIndex:
    """rows: vectors of one width, without nulls. k: how many neighbours searches will ask for."""
    vectors = written(rows.select(F.col(vec).cast("long").alias("doc"), F.col(column).cast("array<double>").alias("e")), "vectors")
    sample = np.array([r.e for r in vectors.orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).select("e").collect()])
    if not len(sample):
        return VectorIndex(np.zeros((0, 1)), np.zeros((1, CODES, PIECE)), vectors.select(F.lit(0).alias("cell"), "doc", F.lit(b"").alias("code")), vectors, 0, 1.0)
    rng, sample = np.random.default_rng(0), _unit(sample)
    centres = _means(sample, min(MOST_CELLS, max(1, round(len(sample) ** 0.5))), rng)
    rest = _pieces(sample - centres[(sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)])
    books = np.stack([_means(np.ascontiguousarray(rest[:, p]), CODES, rng) for p in range(rest.shape[1])])
    probes, depth = _reach(sample, k, centres, books, rng)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                cell, code = _encode(e, centres, books)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "doc", "code"])

    lists = vectors.mapInArrow(run, "cell int, doc long, code binary")
    files = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return VectorIndex(centres, books, written(lists.repartitionByRange(files, "cell", "doc").sortWithinPartitions("cell", "doc"), "lists"), vectors, probes, depth)


def nearest(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """queries: q, v. As retrieval.cosine(), of what the index finds: q, doc, score, rank."""
    blocks, out = max(1, -(-queries.count() // FEW_QUERIES)), None
    for block in range(blocks):
        # About FEW_QUERIES rows, by the query's hash.
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select(F.col("q").cast("long").alias("q"), F.col("v").cast("array<double>").alias("v")).orderBy("q").collect()
        if rows and len(index.centres):
            found = _search(index, np.array([r.q for r in rows]), _unit(np.array([r.v for r in rows])), k)
            out = found if out is None else out.union(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "q long, doc long, score double")
    return top(out, ["q"], k, F.desc("score"), "doc")


def _search(index: VectorIndex, names: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    centres, books = index.centres, index.books
    most = max(2 * k, int(np.ceil(index.depth * k)))
    probed = np.zeros((len(asked), len(centres)), bool)
    np.put_along_axis(probed, np.argsort(-(asked @ centres.T), axis=1, kind="stable")[:, : index.probes], True, axis=1)
    cells = np.flatnonzero(probed.any(0)).tolist()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            cell, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
            for c in np.unique(cell):
                at, who = np.flatnonzero(cell == c), np.flatnonzero(probed[:, c])
                score = _rough(asked[who], c, code[at], centres, books)
                kept.append(_keep(np.repeat(who, len(at)), np.tile(doc[at], len(who)), score.ravel(), most))
                if len(kept) > 16:
                    kept = [_keep(*map(np.concatenate, zip(*kept, strict=True)), most)]
        if kept:
            q, doc, score = _keep(*map(np.concatenate, zip(*kept, strict=True)), most)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(doc), pa.array(score)], ["i", "doc", "rough"])

    lists = index.lists.where(F.col("cell").isin(cells)) if len(cells) < len(centres) else index.lists
    near = top(lists.mapInArrow(look, "i long, doc long, rough double"), ["i"], most, F.desc("rough"), "doc").select("i", "doc")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i = batch.column(0).to_numpy()
                e = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1))
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), batch.column(1), pa.array(np.round(np.einsum("ij,ij->i", e, asked[i]), PLACES))], ["q", "doc", "score"])

    # At most FEW_QUERIES * most pairs.
    return index.vectors.join(F.broadcast(cut(near)), "doc").select("i", "doc", "e").mapInArrow(judge, "q long, doc long, score double")
