"""Scoped memories: who sees what, which of several on one topic holds, and what fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.cleanse import first_by

# Orders of scopes.
PERSONAL_FIRST = {"personal": 0, "team": 1, "project": 2, "org": 3}
ORG_FIRST = {"org": 0, "project": 1, "team": 2, "personal": 3}
GROUPS = ("redline", "task", "project", "personal", "org")


def place_in(scope: Column, order: dict[str, int]) -> Column:
    out = F.lit(99)
    for k, v in order.items():
        out = F.when(scope == k, v).otherwise(out)
    return out


def conflict_rank(policy: dict[str, int] = PERSONAL_FIRST) -> list[Column]:
    """Redlines first, and among them the org's order whatever the policy."""
    red = F.col("is_redline")
    return [F.when(red, 0).otherwise(1), F.when(red, place_in(F.col("scope"), ORG_FIRST)).otherwise(place_in(F.col("scope"), policy))]


def resolve_conflicts(entries: DataFrame, keys: list[str], policy: dict[str, int] = PERSONAL_FIRST) -> DataFrame:
    """One entry a topic; entries without a topic do not conflict."""
    topics = first_by(entries.where("topic_key IS NOT NULL AND topic_key <> ''"), [*keys, "topic_key"], *conflict_rank(policy), "id")
    return entries.where("topic_key IS NULL OR topic_key = ''").unionByName(topics)


def visible(entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """Active entries of the org's scopes that a caller sees; without scopes, nothing is seen."""
    return entries.where("status = 'active'").join(scopes, ["org_id", "scope", "scope_ref"], "left_semi")


def keyword_hits(content: Column, terms: list[str]) -> Column:
    text = F.lower(content)
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def keyword_order(terms: list[str], task: str | None = None) -> list[Column]:
    current = F.when(F.col("task_id") == task, 0).otherwise(1) if task else F.lit(1)
    return [F.when(F.col("is_redline"), 0).otherwise(1), current, -keyword_hits(F.col("content"), terms), F.desc("created_at"), F.col("id")]


def context_group(task: str | None) -> Column:
    out = F.when(F.col("is_redline"), "redline")
    if task:
        out = out.when(F.col("task_id") == task, "task")
    return out.when(F.col("scope").isin("project", "personal", "org"), F.col("scope")).otherwise("org")


def context_plan(entries: DataFrame, keys: list[str], order: list[Column], task: str | None = None, budget: int = 8) -> DataFrame:
    """Redlines stay; what is left of the budget is filled by group, then by order."""
    g = entries.withColumn("group", context_group(task))
    red = F.sum(F.when(F.col("group") == "redline", 1).otherwise(0)).over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys, F.col("group") == "redline").orderBy(place_in(F.col("group"), {x: i for i, x in enumerate(GROUPS)}), *order))
    return g.withColumn("_red", red).withColumn("_place", place).where((F.col("group") == "redline") | (F.col("_place") <= budget - F.col("_red"))).drop("_red", "_place")
