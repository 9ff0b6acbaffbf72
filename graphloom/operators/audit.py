"""Structural checks of a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.kinds import is_certain


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which."""
    ids = nodes.select("id").distinct()
    s = ids.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
    t = ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    met = edges.join(s, "source", "left").join(t, "target", "left")
    side = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "both").when(F.col("_s").isNull(), "source").otherwise("target")
    return met.where("_s IS NULL OR _t IS NULL").withColumn("missing", side).drop("_s", "_t")


def audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """issue, kind, n."""
    count = lambda df, issue: df.groupBy(F.lit(issue).alias("issue"), "kind").agg(F.count("*").alias("n"))
    twice = edges.groupBy("source", "target", "kind").agg(F.count("*").alias("c")).where("c > 1")
    doubled = nodes.groupBy("id").agg(F.min("kind").alias("kind"), F.count("*").alias("c")).where("c > 1").agg(F.lit("duplicate_node").alias("issue"), F.min("kind").alias("kind"), F.count("*").alias("n"))
    return count(dangling(nodes, edges), "dangling").union(count(twice, "duplicate_edge")).union(count(edges.where(~is_certain(F.col("confidence"))), "low_confidence")).union(count(edges.where("src IS NULL"), "no_provenance")).union(doubled)


def link_status(frontend, backend, valid, linked):
    return F.when(frontend == 0, "no_frontend_api").when(backend == 0, "frontend_without_backend_endpoints").when(valid == 0, "frontend_backend_unlinked").when(linked < frontend, "partial_frontend_linkage").otherwise("linked")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many frontend calls have a calls_api edge to a backend endpoint, and what that says."""
    ends = nodes.where(F.col("kind").isin("frontend_api_call", "backend_endpoint")).select("id", "kind").distinct()
    counts = ends.select(F.when(F.col("kind") == "frontend_api_call", 1).otherwise(0).alias("fr"), F.when(F.col("kind") == "backend_endpoint", 1).otherwise(0).alias("ba"), F.lit(0).alias("raw"), F.lit(0).alias("ok"), F.lit(None).cast("string").alias("source"))
    calls = edges.where("kind = 'calls_api'").select("source", "target")
    f = ends.where("kind = 'frontend_api_call'").select(F.col("id").alias("source"), F.lit(1).alias("f"))
    b = ends.where("kind = 'backend_endpoint'").select(F.col("id").alias("target"), F.lit(1).alias("b"))
    valid = F.col("f").isNotNull() & F.col("b").isNotNull()
    edge = calls.join(f, "source", "left").join(b, "target", "left").select(F.lit(0).alias("fr"), F.lit(0).alias("ba"), F.lit(1).alias("raw"), valid.cast("int").alias("ok"), F.when(valid, F.col("source")).alias("source"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    both = counts.union(edge).agg(total("fr").alias("frontend"), total("ba").alias("backend"), total("raw").alias("raw_edges"), total("ok").alias("valid_edges"), F.countDistinct("source").alias("linked"))
    return both.select("frontend", "backend", "raw_edges", "valid_edges", "linked", F.when(F.col("frontend") > 0, F.round(F.col("linked") / F.col("frontend"), 4)).otherwise(1.0).alias("ratio"), link_status(F.col("frontend"), F.col("backend"), F.col("valid_edges"), F.col("linked")).alias("status"))
