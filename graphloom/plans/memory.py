"""Plans over scoped memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.memory import conflict_rank, context_group, context_plan, keyword_hits, keyword_order, resolve_conflicts, visible
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

_ORD = "CASE WHEN is_redline THEN 0 ELSE 1 END, CASE WHEN is_redline THEN CASE scope WHEN 'org' THEN 0 WHEN 'project' THEN 1 WHEN 'team' THEN 2 WHEN 'personal' THEN 3 ELSE 99 END ELSE CASE scope WHEN 'personal' THEN 0 WHEN 'team' THEN 1 WHEN 'project' THEN 2 WHEN 'org' THEN 3 ELSE 99 END END"
_WIN = f", win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, topic_key ORDER BY {_ORD}, id) AS rn FROM memories) WHERE topic_key IS NULL OR rn = 1)"
_HITS = "CAST(contains(lower(content), 'purchase') AS INT) + CAST(contains(lower(content), 'user') AS INT)"
_KEY = f"CASE WHEN is_redline THEN 0 ELSE 1 END, CASE WHEN task_id = 't3' THEN 0 ELSE 1 END, -({_HITS}), created_at DESC, id"
_GROUP = "CASE WHEN is_redline THEN 'redline' WHEN task_id = 't3' THEN 'task' WHEN scope IN ('project', 'personal', 'org') THEN scope ELSE 'org' END"
_SEEN = ", seen AS (SELECT * FROM memories WHERE status = 'active' AND org_id = 'o1' AND ((scope = 'org' AND scope_ref = 'org') OR (scope = 'project' AND scope_ref = 'p1') OR (scope = 'personal' AND scope_ref = 'u7')))"
TERMS = ["purchase", "user"]


def scopes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("o1", "org", "org"), ("o1", "project", "p1"), ("o1", "personal", "u7")], "org_id string, scope string, scope_ref string")


@query("agg-36", with_derived(_WIN + " SELECT id, topic_key FROM win", "memories"))
def conflicts(t: Tables) -> DataFrame:
    return resolve_conflicts(t.memories, ["org_id"]).select("id", "topic_key")


@query("scl-37", with_derived(f" SELECT id, CASE WHEN is_redline THEN 0 ELSE 1 END AS a, {_ORD.split(', ', 1)[1]} AS b FROM memories", "memories"))
def rank_of_entries(t: Tables) -> DataFrame:
    a, b = conflict_rank()
    return t.memories.select("id", a.alias("a"), b.alias("b"))


@query("agg-30", with_derived("SELECT scope, scope_ref, count(*) AS n FROM memories WHERE status = 'active' GROUP BY 1, 2", "memories"))
def memory_counts(t: Tables) -> DataFrame:
    return t.memories.where("status = 'active'").groupBy("scope", "scope_ref").agg(F.count("*").alias("n"))


@query("flt-10", with_derived(_SEEN + " SELECT id FROM seen", "memories"))
def scope_where(t: Tables) -> DataFrame:
    return visible(t.memories, scopes(t)).select("id")


@query("top-13", with_derived("SELECT id FROM memories WHERE status = 'active' AND org_id = 'o1' AND scope = 'org' ORDER BY created_at DESC, id LIMIT 50", "memories"))
def scope_listing(t: Tables) -> DataFrame:
    return t.memories.where("status = 'active' AND org_id = 'o1' AND scope = 'org'").orderBy(F.desc("created_at"), "id").limit(50).select("id")


@query("scl-31", with_derived(f"SELECT id, {_HITS} AS hits FROM memories", "memories"))
def hits(t: Tables) -> DataFrame:
    return t.memories.select("id", keyword_hits(F.col("content"), TERMS).alias("hits"))


@query("top-11", with_derived(_SEEN + f" SELECT id, row_number() OVER (PARTITION BY org_id, scope, scope_ref ORDER BY {_KEY}) AS place FROM seen", "memories"))
def keyword_rank(t: Tables) -> DataFrame:
    return visible(t.memories, scopes(t)).select("id", F.row_number().over(Window.partitionBy("org_id", "scope", "scope_ref").orderBy(*keyword_order(TERMS, "t3"))).alias("place"))


@query("ret-18", with_derived(_SEEN + f" SELECT org_id, id FROM seen ORDER BY {_KEY} LIMIT 20", "memories"))
def keyword_scorer(t: Tables) -> DataFrame:
    return visible(t.memories, scopes(t)).orderBy(*keyword_order(TERMS, "t3")).limit(20).select("org_id", "id")


@query("scl-38", with_derived(f"SELECT id, {_GROUP} AS grp FROM memories", "memories"))
def groups(t: Tables) -> DataFrame:
    return t.memories.select("id", context_group("t3").alias("grp"))


_PLAN = _SEEN + f", g AS (SELECT *, {_GROUP} AS grp FROM seen), o AS (SELECT *, sum(CASE WHEN grp = 'redline' THEN 1 ELSE 0 END) OVER () AS red, row_number() OVER (PARTITION BY grp = 'redline' ORDER BY CASE grp WHEN 'redline' THEN 0 WHEN 'task' THEN 1 WHEN 'project' THEN 2 WHEN 'personal' THEN 3 ELSE 4 END, {_KEY}) AS place FROM g)"


@query("top-12", with_derived(_PLAN + " SELECT id, grp FROM o WHERE grp = 'redline' OR place <= 40 - red", "memories"))
def context_budget(t: Tables) -> DataFrame:
    return context_plan(visible(t.memories, scopes(t)), ["org_id"], keyword_order(TERMS, "t3"), "t3", 40).select("id", F.col("group").alias("grp"))


@query("ret-16", with_derived(_SEEN + f", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, scope_ref ORDER BY created_at DESC, id) AS k FROM seen) WHERE k <= 50), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY {_ORD}, id) AS rn FROM l) WHERE topic_key IS NULL OR rn = 1) SELECT id, row_number() OVER (ORDER BY {_KEY}) AS place FROM w ORDER BY 2 LIMIT 20", "memories"))
def memory_recall(t: Tables) -> DataFrame:
    listed = visible(t.memories, scopes(t)).withColumn("k", F.row_number().over(Window.partitionBy("scope", "scope_ref").orderBy(F.desc("created_at"), "id"))).where("k <= 50")
    kept = resolve_conflicts(listed, ["org_id"])
    first = kept.orderBy(*keyword_order(TERMS, "t3")).limit(20)
    return first.select("id", F.row_number().over(Window.orderBy(*keyword_order(TERMS, "t3"))).alias("place"))  # of 20 rows


@query("agg-37", with_derived("SELECT owner, CASE max(CASE scope WHEN 'org' THEN 3 WHEN 'team' THEN 2 ELSE 1 END) WHEN 3 THEN 'org' WHEN 2 THEN 'team' ELSE 'own' END AS role FROM memories GROUP BY owner", "memories"))
def highest_role(t: Tables) -> DataFrame:
    rank = F.when(F.col("scope") == "org", 3).when(F.col("scope") == "team", 2).otherwise(1)
    return t.memories.groupBy("owner").agg(F.element_at(F.array(F.lit("own"), F.lit("team"), F.lit("org")), F.max(rank)).alias("role"))


@query("str-17", with_derived("SELECT id, CASE WHEN status = 'active' AND created_at < TIMESTAMP '2024-01-15' THEN 'archived' ELSE status END AS status FROM memories", "memories"))
def ttl_archive(t: Tables) -> DataFrame:
    gone = (F.col("status") == "active") & (F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return t.memories.select("id", F.when(gone, "archived").otherwise(F.col("status")).alias("status"))


@query("str-22", with_derived("SELECT org_id, topic_key, count(*) AS n, string_agg(content, chr(10) ORDER BY id) AS summary FROM memories WHERE topic_key IS NOT NULL AND NOT is_redline AND status = 'active' GROUP BY 1, 2 HAVING count(*) >= 3", "memories"))
def topic_compaction(t: Tables) -> DataFrame:
    live = t.memories.where("topic_key IS NOT NULL AND NOT is_redline AND status = 'active'")
    fused = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]))
    return live.groupBy("org_id", "topic_key").agg(F.count("*").alias("n"), fused.alias("summary")).where("n >= 3")


@query("str-18", with_derived("SELECT id, CASE WHEN id % 6 = 0 AND NOT is_redline THEN 'superseded' ELSE status END AS status, CAST(NULL AS BIGINT) AS supersedes FROM memories UNION ALL SELECT id + 100000000, 'active', id FROM memories WHERE id % 6 = 0 AND NOT is_redline", "memories"))
def supersede(t: Tables) -> DataFrame:
    m, old = t.memories, (F.col("id") % 6 == 0) & ~F.col("is_redline")
    kept = m.select("id", F.when(old, "superseded").otherwise(F.col("status")).alias("status"), F.lit(None).cast("long").alias("supersedes"))
    return kept.union(m.where(old).select(F.col("id") + 100_000_000, F.lit("active"), "id"))


@query("str-20", with_derived("SELECT id, CASE WHEN status = 'active' THEN 'archived' ELSE status END AS status FROM memories WHERE owner = 'u7'", "memories"))
def archive(t: Tables) -> DataFrame:
    return t.memories.where("owner = 'u7'").select("id", F.when(F.col("status") == "active", "archived").otherwise(F.col("status")).alias("status"))


@query("set-06", with_derived("SELECT org_id, owner, count(DISTINCT scope || ':' || scope_ref) AS scopes FROM memories GROUP BY 1, 2", "memories"))
def visible_scopes(t: Tables) -> DataFrame:
    return t.memories.groupBy("org_id", "owner").agg(F.countDistinct(F.concat_ws(":", "scope", "scope_ref")).alias("scopes"))
