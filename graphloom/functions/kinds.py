"""Kinds of nodes and edges, and expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, layers and weights of the graph.
SOFT_NODES = ("business_domain", "arch_layer", "inferred_api_call", "community")
SOFT_EDGES = ("belongs_to_domain", "plays_role", "calls_api_inferred", "in_community")
LAYERS = {
    "frontend": ("frontend_route", "frontend_component", "frontend_module", "frontend_api_call"),
    "backend": ("backend_endpoint", "backend_function"),
    "database": ("db_table", "db_column"),
}
CERTAIN = 0.7
SOURCE_WEIGHTS = {"ast": 1.0, "framework": 1.0, "bridge": 1.0, "regex": 0.7, "llm": 0.5, "manual": 1.0}
SOURCE_DEFAULT = 0.85
KIND_WEIGHTS = {"imports": 0.85, "renders": 0.9, "mentions": 0.6, "relates_to": 0.6, "changed_by": 0.7}
DEPTH_DECAY, FANOUT, OTHER_COMMUNITY = 0.9, 60, 0.8
ROLE_RANKS = {"controller": 0, "gateway": 0, "adapter": 1, "service": 2, "repository": 3}


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def is_soft_node(kind: Column) -> Column:
    return kind.isin(*SOFT_NODES)


def is_soft_edge(kind: Column) -> Column:
    return kind.isin(*SOFT_EDGES)


def is_certain(confidence: Column) -> Column:
    """No confidence counts as full confidence."""
    return F.coalesce(confidence, F.lit(1.0)) >= CERTAIN


def layer_of(kind: Column) -> Column:
    out = F.lit("other")
    for layer, kinds in LAYERS.items():
        out = F.when(kind.isin(*kinds), layer).otherwise(out)
    return out


def edge_quality(confidence: Column, src: Column, kind: Column) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) * lookup(src, SOURCE_WEIGHTS, SOURCE_DEFAULT) * lookup(kind, KIND_WEIGHTS, 1.0)


def community_factor(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), OTHER_COMMUNITY).otherwise(1.0)
