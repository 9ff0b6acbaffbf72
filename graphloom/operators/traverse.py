"""Walks over the edges: one join a hop, on the frontier only. Only the new frontier is written at a hop; a small one goes to the edges, not they to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.kinds import DEPTH_DECAY, FANOUT, community_factor, edge_quality
from graphloom.operators.cleanse import first_by
from graphloom.operators.shared import cut

#: A frontier of so many rows at most is sent to all tasks.
FEW = 100_000


def _near(frontier: DataFrame, n: int) -> DataFrame:
    return F.broadcast(frontier) if n <= FEW else frontier


def _all(seen: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, seen)


def pairs(edges: DataFrame, reverse: bool) -> DataFrame:
    """here, there: the steps of a walk, each once."""
    here, there = ("target", "source") if reverse else ("source", "target")
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()


def distances(walk: DataFrame, starts: DataFrame, max_depth: int = 10, most: int | None = None) -> DataFrame:
    """walk: here, there; starts: id. Returns id and depth of all that is reached; starts have depth 0.

    With `most`, no hop is walked once more than so many are visited (a hop that has begun is finished)."""
    frontier = cut(starts.select("id", F.lit(0).alias("depth")).distinct())
    n = visited = frontier.count()
    seen = [frontier]
    for depth in range(1, max_depth + 1):
        if not n or (most is not None and visited > most):
            break
        found = walk.join(_near(frontier.select(F.col("id").alias("here")), n), "here").select(F.col("there").alias("id")).distinct()
        frontier = cut(found.join(_all(seen).select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        n = frontier.count()
        visited += n
        seen.append(frontier)
    return _all(seen)


def steps(edges: DataFrame, reverse: bool) -> DataFrame:
    """Edges as (here, there, kind, confidence, src, ord) in the direction of a walk."""
    here, there = ("target", "source") if reverse else ("source", "target")
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there"), "kind", "confidence", "src", "ord")


def reach(walk: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """walk: what steps() gives, best written in buckets of `here`; starts: id. Returns id, depth, and via_edge, confidence, src of the first discovery; starts have depth 0.

    Of several discoveries in one hop the first counts: turn holds the ordinals of the edges on the way, so it compares finders in the
    order in which they were found themselves, then their edges."""
    frontier = cut(starts.select("id", F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("turn"), F.lit(None).cast("string").alias("via_edge"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("src")).distinct())
    n, seen = frontier.count(), [frontier]
    for depth in range(1, max_depth + 1):
        if not n:
            break
        found = walk.join(_near(frontier.select(F.col("id").alias("here"), F.col("turn").alias("by")), n), "here").join(_all(seen).select(F.col("id").alias("there")), "there", "left_anti")
        turn = F.concat("by", F.array("ord"))
        best = found.groupBy("there").agg(F.min(F.struct(turn.alias("turn"), "here", "kind", "confidence", "src")).alias("b"))
        frontier = cut(best.select(F.col("there").alias("id"), F.lit(depth).alias("depth"), "b.turn", F.col("b.kind").alias("via_edge"), "b.confidence", "b.src"))
        n = frontier.count()
        seen.append(frontier)
    return _all(seen).drop("turn")


def path_steps(nodes: DataFrame, edges: DataFrame, reverse: bool = True, communities: DataFrame | None = None) -> DataFrame:
    """here, there, q (what a step multiplies a score by), ok (it is certain): of the first FANOUT edges of each node, those between nodes.

    communities: id, community; a step between two different ones counts less."""
    walk = steps(edges, reverse).withColumn("rn", F.row_number().over(Window.partitionBy("here").orderBy("ord"))).where(F.col("rn") <= FANOUT)
    walk = walk.join(nodes.select(F.col("id").alias("there")), "there", "left_semi")
    factor = F.lit(1.0)
    if communities is not None:
        for side in ("here", "there"):
            walk = walk.join(communities.select(F.col("id").alias(side), F.col("community").alias(f"_{side}")), side, "left")
        factor = community_factor(F.col("_here"), F.col("_there"))
    return walk.select("here", "there", (edge_quality(F.col("confidence"), F.col("src"), F.col("kind")) * factor * DEPTH_DECAY).alias("q"), (F.coalesce("confidence", F.lit(1.0)) >= 0.7).alias("ok"), "ord")


def best_paths(walk: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """The best product of steps (here, there, q, ok, ord) from a start to each node: id, score, depth, certain, hops.

    A hop improves some nodes, and only those are walked on from; what was best before is read as it was written."""
    moved = cut(starts.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("depth"), F.lit(True).alias("certain"), F.array().cast("array<string>").alias("hops")))
    n, made = moved.count(), [moved]
    for _ in range(max_depth):
        if not n:
            break
        tried = walk.join(_near(moved.select(F.col("id").alias("here"), "score", "depth", "certain", "hops"), n), "here")
        tried = tried.select(F.col("there").alias("id"), (F.col("score") * F.col("q")).alias("score"), (F.col("depth") + 1).alias("depth"), (F.col("certain") & F.col("ok")).alias("certain"), F.concat("hops", F.array("there")).alias("hops"), "ord", "here")
        tried = tried.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "depth", "here", "ord", "certain", "hops")).alias("b")).select("id", (-F.col("b.s")).alias("score"), "b.depth", "b.certain", "b.hops")
        old = _all(made).groupBy("id").agg(F.max("score").alias("_old"))
        moved = cut(tried.join(old, "id", "left").where(F.col("_old").isNull() | (F.col("score") > F.col("_old"))).drop("_old"))
        n = moved.count()
        made.append(moved)
    return first_by(_all(made), ["id"], F.desc("score"), "depth").where("depth > 0")
