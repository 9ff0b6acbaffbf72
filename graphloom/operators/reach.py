"""The tables that many starts reach, as bitmaps: no row for a start and a table is written or moved.

Tables are numbered, those with most steps into them first, and cut into chunks of ``WIDTH`` numbers. A node's set is a row a chunk, with bits up to the
last table in it, so sets of common tables are short. A walk from all starts at once finds the steps that lie within their reach; sets are carried against these, a round a hop; what a node's followers send is merged by OR before it
is moved and after, and only sets that the last round has changed are sent on. What asks for single tables (how many starts reach each, which tables
a cluster shares) counts bits batch by batch and moves the counts.

Starts without tables have no row; empty inputs give empty results; repeated rows and steps change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.repos import numbered
from graphloom.operators.shared import cut
from graphloom.operators.traverse import distances

#: Tables of a chunk: as many bits as Spark's bitmap functions hold.
WIDTH = 32_768
#: Masks of so many chunks (16 MB) are sent to all tasks; more are joined, and by then chunks are many.
FEW_CHUNKS = 4096


@dataclass(frozen=True)
class Reached:
    """sets: id (a start), chunk, bits; tables: table, number."""

    sets: DataFrame
    tables: DataFrame
    width: int = WIDTH


def _chunked(tables: DataFrame, width: int, *by: str) -> DataFrame:
    """tables: number. Their bits, a row a chunk and each of by, and how many bytes hold one."""
    at = (F.col("number") % width).cast("long")
    return tables.groupBy(*by, F.floor(F.col("number") / width).alias("chunk")).agg(F.bitmap_construct_agg(at).alias("bits"), (F.floor(F.max(at) / 8) + 1).cast("int").alias("top"))


def _trim(sets: DataFrame) -> DataFrame:
    return sets.withColumn("bits", F.substring("bits", F.lit(1), F.col("top")))


def reached_tables(forward: DataFrame, starts: DataFrame, tables: DataFrame, max_depth: int, width: int = WIDTH) -> Reached:
    """forward: here, there (steps by key); starts: key, id; tables: key, table. What each start reaches in at most so many steps."""
    tables = tables.distinct()
    near = distances(forward, starts.select(F.col("key").alias("id")).distinct(), max_depth - 1)
    steps = cut(near.select(F.col("id").alias("here"), "depth").join(forward, "here").select(F.col("here").alias("before"), F.col("there").alias("key"), "depth").distinct())
    into = steps.groupBy("key").agg(F.count("*").alias("n"))
    order = tables.join(into, "key", "left").withColumn("o", F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "table")).drop("n")
    places = cut(numbered(order, "o").select("key", "table", "number"))
    state = cut(_trim(_chunked(places, width, "key")))
    changed = state
    for k in range(1, max_depth + 1):
        # k steps before a table, so a start that is further off than what is left of the hops has no use for the set.
        sent = changed.join(steps.where(F.col("depth") <= max_depth - k), "key").select(F.col("before").alias("key"), "chunk", "bits", "top", F.lit(None).cast("binary").alias("old"))
        both = state.select("key", "chunk", "bits", "top", F.col("bits").alias("old")).union(sent)
        met = both.groupBy("key", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("top").alias("top"), F.first("old", ignorenulls=True).alias("old"))
        met = cut(_trim(met))
        state, changed = met.drop("old"), met.where(~F.col("bits").eqNullSafe(F.col("old"))).drop("old")
        if not changed.limit(1).count():
            break
    return Reached(cut(state.join(starts.select("key", "id").distinct(), "key").select("id", "chunk", "bits")), places.select("table", "number"), width)


def _set_bits(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all bits that are set: the row and the table's number."""
    held = [np.flatnonzero(np.unpackbits(np.frombuffer(b.as_py(), np.uint8), bitorder="little")) for b in batch.column("bits")]
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    return row, np.concatenate([np.zeros(0, np.int64), *held]) + batch.column("chunk").to_numpy()[row] * width


def table_counts(reached: Reached, sets: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """table, n (and by, a string column of the sets): how many starts reach each table."""
    width = reached.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number = _set_bits(batch, width)
            group = batch.column("by").dictionary_encode()
            code = group.indices.to_numpy().astype(np.int64)[row]
            found, n = np.unique(np.stack([code, number]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(found[0])), pa.array(found[1]), pa.array(n.astype(np.int64))], ["by", "number", "n"])

    rows = (reached.sets if sets is None else sets).select(F.col(by).alias("by") if by else F.lit("").alias("by"), "chunk", "bits")
    counts = rows.mapInArrow(run, "by string, number long, n long").groupBy("by", "number").agg(F.sum("n").alias("n")).join(reached.tables, "number")
    return counts.select(*([F.col("by").alias(by)] if by else []), "table", "n")


def without(reached: Reached, left_out: DataFrame) -> DataFrame:
    """The sets without some tables (table); starts that have no other keep no row."""
    gone = _chunked(reached.tables.join(left_out.select("table").distinct(), "table", "left_semi"), reached.width)
    masks = cut(gone.select("chunk", F.col("bits").alias("mask")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for bits, mask in zip(batch.column("bits"), batch.column("mask"), strict=True):
                held = np.frombuffer(bits.as_py(), np.uint8)
                kept.append((held & ~np.frombuffer(mask.as_py(), np.uint8)[: len(held)]).tobytes() if mask.is_valid else bits.as_py())
            some = pa.array([any(k) for k in kept], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(kept, pa.binary())], ["id", "chunk", "bits"]).filter(some)

    small = masks.count() <= FEW_CHUNKS
    return reached.sets.join(F.broadcast(masks) if small else masks, "chunk", "left").select("id", "chunk", "bits", "mask").mapInArrow(run, "id string, chunk long, bits binary")


def shared_links(sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """u, v, numbers of tables: links that bring together all tables of a set's chunk, each once; and of each row of a set, with its id, the first table: id, u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number = _set_bits(batch, width)
            head = np.searchsorted(row, np.arange(len(batch)))
            other = np.ones(len(row), bool)
            other[head[head < len(row)]] = False
            pairs = np.unique(np.stack([number[head[row[other]]], number[other]]), axis=1)
            have = np.unique(row)
            ids = pa.concat_arrays([batch.column("id").take(pa.array(have)), pa.nulls(pairs.shape[1], pa.string())])
            u = np.concatenate([number[head[have]], pairs[0]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(u), pa.array(np.concatenate([np.full(len(have), -1), pairs[1]]))], ["id", "u", "v"])

    return sets.select("id", "chunk", "bits").mapInArrow(run, "id string, u long, v long").distinct()
