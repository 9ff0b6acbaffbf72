"""Connected components of a table of links, by alternating large-star and small-star steps.

Each round is two joins and aggregations on the links and cuts the lineage in the shared folder, so lost executors
cost one round; only two numbers (count and checksum of the links) reach the driver. A round has as many tasks as its links need, and none deals rows anew where one task is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _shared
from graphloom.llm._shared import cut, narrowed


def components(links: DataFrame) -> DataFrame:
    """links: long u, v. Returns node, root: for each linked node the smallest node that it reaches."""
    u, v = F.col("u"), F.col("v")
    edges = cut(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        near = F.broadcast if 2 * state[0] <= _shared.TASK_ROWS else lambda table: table
        edges = narrowed(edges, state[0])
        both = narrowed(edges.union(edges.select(v.alias("u"), u.alias("v"))), 2 * state[0])
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(near(least), "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(least), "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(narrowed(small.where(u != v).distinct(), 2 * state[0]))
        last, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    return narrowed(edges.select(u.alias("node"), v.alias("root")).union(edges.select(v, v)), 2 * state[0]).distinct()
