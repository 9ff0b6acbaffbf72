"""The cleansed graph of a folder, written once a session, with the steps of walks in buckets of where they start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.cleanse import impact_graph
from graphloom.operators.shared import bucketed, written
from graphloom.operators.traverse import distances, pairs
from graphloom.sources.tables import Tables


@dataclass(frozen=True)
class Prepared:
    """nodes and edges; names (key, id) of all ids; forward and reverse (here, there) by key: integers instead of ids."""

    nodes: DataFrame
    edges: DataFrame
    names: DataFrame
    forward: DataFrame
    reverse: DataFrame
    seed: int

    def key(self, column: str = "id"):
        return F.xxhash64(F.col(column), F.lit(self.seed))

    def reach(self, starts: DataFrame, reverse: bool = True, max_depth: int = 10, most: int | None = None) -> DataFrame:
        """id, depth of the nodes that are reached from starts (id), these not included. Ids that are no nodes are walked through, and left out."""
        found = self.depths(starts, reverse, max_depth, most).where("depth > 0")
        return self.nodes.withColumn("key", self.key()).join(found, "key").drop("key")

    def depths(self, starts: DataFrame, reverse: bool = True, max_depth: int = 10, most: int | None = None) -> DataFrame:
        """key, depth; starts have depth 0."""
        walk = self.reverse if reverse else self.forward
        return distances(walk, starts.select(self.key().alias("id")), max_depth, most).withColumnRenamed("id", "key")


_MADE: dict[tuple[str, str, bool], Prepared] = {}


def prepared(t: Tables, certain_only: bool = False) -> Prepared:
    """Made at the first call of a session for a folder. Tables of a folder are taken not to change while a session lasts."""
    name = (t.spark.sparkContext.applicationId, t.folder, certain_only)
    if name not in _MADE:
        nodes, edges = impact_graph(t.nodes, t.edges, certain_only=certain_only)
        nodes, edges = written(nodes, "nodes"), written(edges, "edges")
        ids = written(nodes.select("id").union(edges.select("source")).union(edges.select("target")).distinct(), "ids")
        seed = 0
        while ids.groupBy(F.xxhash64("id", F.lit(seed))).count().where("count > 1").limit(1).count():  # two ids with one key
            seed += 1
        both = edges.select(F.xxhash64("source", F.lit(seed)).alias("source"), F.xxhash64("target", F.lit(seed)).alias("target"))
        made = (bucketed(pairs(both, reverse), f"graphloom_steps_{int(reverse)}", "here") for reverse in (False, True))
        _MADE[name] = Prepared(nodes, edges, ids.select(F.xxhash64("id", F.lit(seed)).alias("key"), "id"), *made, seed)
    return _MADE[name]
