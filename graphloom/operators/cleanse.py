"""From stored rows to the graph that is asked: soft rows, duplicates and registry edges go, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.kinds import is_certain, is_soft_edge, is_soft_node


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key, the first in an order; ties do not arise if the order ends in an ordinal."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: a frontend_module yields to any other kind, else the first stays."""
    return first_by(nodes, ["id"], (F.col("kind") == "frontend_module").cast("int"), "ord")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row of (source, target, kind): with provenance before without, then by confidence, then the first."""
    return first_by(edges, ["source", "target", "kind"], F.col("src").isNull().cast("int"), F.desc(F.coalesce("confidence", F.lit(1.0))), "ord")


def impact_graph(nodes: DataFrame, edges: DataFrame, include_soft: bool = False, certain_only: bool = False) -> tuple[DataFrame, DataFrame]:
    if not include_soft:
        nodes, edges = nodes.where(~is_soft_node(F.col("kind"))), edges.where(~is_soft_edge(F.col("kind")))
    nodes = dedup_nodes(nodes)
    if certain_only:
        edges = edges.where(is_certain(F.col("confidence")))
    registry = nodes.where((F.col("kind") == "frontend_api_call") & F.col("url_registry")).select(F.col("id").alias("target"), F.lit("contains").alias("kind"))
    return nodes, dedup_edges(edges).join(registry, ["target", "kind"], "left_anti")
