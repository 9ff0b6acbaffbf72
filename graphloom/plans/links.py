"""Plans that join: linking across sources, anti joins, diffs, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.audit import dangling
from graphloom.operators.links import by_operation, by_url, link_calls
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

_SIDES = """, f AS (SELECT * FROM nodes WHERE kind = 'frontend_api_call'), b AS (SELECT * FROM nodes WHERE kind = 'backend_endpoint'),
ops AS (SELECT coalesce(service, '') AS service, operation_id, min(id) AS target, count(*) AS n FROM b WHERE operation_id IS NOT NULL GROUP BY 1, 2),
op AS (SELECT f.id, o.target, CASE WHEN o.n = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM f JOIN ops o ON coalesce(f.service, '') = o.service AND f.operation_id = o.operation_id),
c AS (SELECT f.id, f.url_registry AS open, upper(coalesce(f.http_method, 'POST')) AS m, b.id AS target, upper(coalesce(b.http_method, 'POST')) AS em, coalesce(b.service, '') AS service FROM f JOIN b ON f.url = b.url),
fit AS (SELECT *, max(CASE WHEN em = m THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS any_fit FROM c),
pool AS (SELECT * FROM fit WHERE open OR any_fit = 0 OR em = m),
url AS (SELECT id, min(target) AS target, CASE WHEN count(*) = 1 THEN CASE WHEN bool_or(open OR em = m) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END WHEN count(DISTINCT service) > 1 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM pool GROUP BY id)"""


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.nodes.where("kind = 'frontend_api_call'"), t.nodes.where("kind = 'backend_endpoint'")


@query("jn-01", with_derived(_SIDES + " SELECT id AS source, target, confidence, 'operation' AS how FROM op UNION ALL SELECT id, target, confidence, 'url' FROM url WHERE id NOT IN (SELECT id FROM op)", "nodes"))
def front_back_link(t: Tables) -> DataFrame:
    return link_calls(*sides(t))


@query("lin-35", with_derived(_SIDES + " SELECT confidence, count(*) AS n FROM (SELECT confidence FROM op UNION ALL SELECT confidence FROM url WHERE id NOT IN (SELECT id FROM op)) GROUP BY confidence", "nodes"))
def link_pass(t: Tables) -> DataFrame:
    return link_calls(*sides(t)).groupBy("confidence").agg(F.count("*").alias("n"))


@query("jn-02", with_derived(_SIDES + " SELECT * FROM op", "nodes"))
def operation_match(t: Tables) -> DataFrame:
    return by_operation(*sides(t))


@query("jn-03", with_derived(_SIDES + " SELECT * FROM url", "nodes"))
def url_match(t: Tables) -> DataFrame:
    return by_url(*sides(t))


@query("jn-04", with_derived(", m AS (SELECT file, min(id) AS source FROM nodes WHERE kind = 'frontend_component' AND file IS NOT NULL GROUP BY file), a AS (SELECT DISTINCT file, id FROM nodes WHERE kind IN ('frontend_api_call', 'frontend_component')) SELECT DISTINCT m.source, a.id AS target, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM m JOIN a ON a.file = m.file WHERE a.id <> m.source", "nodes"))
def module_bridge(t: Tables) -> DataFrame:
    modules = t.nodes.where("kind = 'frontend_component' AND file IS NOT NULL").groupBy("file").agg(F.min("id").alias("source"))
    calls = t.nodes.where(F.col("kind").isin("frontend_api_call", "frontend_component")).select("file", F.col("id").alias("target"))
    return modules.join(calls, "file").where("source <> target").select("source", "target", F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence")).distinct()


@query("jn-11", with_derived("SELECT DISTINCT n.id FROM (SELECT target AS id FROM edges WHERE source = 'shop:db_table:n3' UNION SELECT source FROM edges WHERE target = 'shop:db_table:n3') x JOIN nodes n ON n.id = x.id", "nodes", "edges"))
def neighbours(t: Tables) -> DataFrame:
    e, here = t.edges, "shop:db_table:n3"
    ends = e.where(F.col("source") == here).select(F.col("target").alias("id")).union(e.where(F.col("target") == here).select("source")).distinct()
    return t.nodes.join(ends, "id", "left_semi").select("id").distinct()


@query("jn-12", with_derived(", d AS (SELECT id, count(*) AS k FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT e.ord, a.k + b.k AS degree FROM edges e LEFT JOIN d a ON a.id = e.source LEFT JOIN d b ON b.id = e.target", "edges"))
def degree_joins(t: Tables) -> DataFrame:
    e = t.edges.select("source", "target", "ord")
    d = e.select(F.col("source").alias("id")).union(e.select("target")).groupBy("id").agg(F.count("*").alias("k"))
    return e.join(d.select(F.col("id").alias("source"), F.col("k").alias("a")), "source", "left").join(d.select(F.col("id").alias("target"), F.col("k").alias("b")), "target", "left").select("ord", (F.col("a") + F.col("b")).alias("degree"))


@query("jn-14", "SELECT md5(c_name) AS token_hash, c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 AND md5(c_name) < '1'")
def token_lookup(t: Tables) -> DataFrame:
    active = t.customer.where("c_acctbal > 0").withColumn("token_hash", F.md5(F.col("c_name").cast("binary"))).where("token_hash < '1'")
    return active.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("token_hash", "c_custkey", "r_name")


@query("jn-34", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations")
def session_messages(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("pos"))


@query("jn-17", with_derived("SELECT ord, CASE WHEN source NOT IN (SELECT id FROM nodes) AND target NOT IN (SELECT id FROM nodes) THEN 'both' WHEN source NOT IN (SELECT id FROM nodes) THEN 'source' ELSE 'target' END AS missing FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)", "nodes", "edges"))
def dangling_edges(t: Tables) -> DataFrame:
    return dangling(t.nodes, t.edges).select("ord", "missing")


@query("jn-19", with_derived("SELECT source, target, least(confidence, 0.99::DOUBLE) AS confidence FROM edges WHERE kind = 'belongs_to_domain' AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)", "nodes", "edges"))
def referential_check(t: Tables) -> DataFrame:
    ids = t.nodes.select("id").distinct()
    soft = t.edges.where("kind = 'belongs_to_domain'")
    kept = soft.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.select("source", "target", F.least("confidence", F.lit(0.99)).alias("confidence"))


@query("jn-23", "SELECT 'p' || CAST(c_nationkey AS STRING) AS pid FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def orphan_projects(t: Tables) -> DataFrame:
    known = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return t.customer.select("c_nationkey").distinct().join(known, "c_nationkey", "left_anti").select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("pid"))


_OLD_NEW = "o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 > 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 > 0)"


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents
    old = d.where("doc_id % 7 > 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.where("doc_id % 11 > 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return old, new


def _diff(old: DataFrame, new: DataFrame) -> DataFrame:
    met = old.withColumnRenamed("h", "a").join(new.withColumnRenamed("h", "b"), "doc_id", "full_outer")
    what = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return met.select("doc_id", what.alias("what")).where("what IS NOT NULL")


_DIFF = f"WITH {_OLD_NEW} SELECT * FROM (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.h IS NULL THEN 'deleted' WHEN o.h IS NULL THEN 'added' WHEN o.h <> n.h THEN 'changed' END AS what FROM o FULL JOIN n ON o.doc_id = n.doc_id) WHERE what IS NOT NULL"


@query("jn-25", _DIFF)
def manifest_diff(t: Tables) -> DataFrame:
    return _diff(*_snapshots(t))


@query("jn-26", _DIFF.replace("SELECT * FROM (SELECT coalesce", "SELECT what, count(*) AS n FROM (SELECT coalesce") + " GROUP BY what")
def file_diff(t: Tables) -> DataFrame:
    return _diff(*_snapshots(t)).groupBy("what").agg(F.count("*").alias("n"))


@query("jn-24", f"WITH {_OLD_NEW} SELECT count(*) = count(o.doc_id) AND count(*) = count(n.doc_id) AS proven, count(*) - count(o.doc_id) AS extra, count(*) - count(n.doc_id) AS missing FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def id_set_proof(t: Tables) -> DataFrame:
    old, new = _snapshots(t)
    met = old.withColumnRenamed("h", "a").join(new.withColumnRenamed("h", "b"), "doc_id", "full_outer")
    return met.agg(((F.count("*") == F.count("a")) & (F.count("*") == F.count("b"))).alias("proven"), (F.count("*") - F.count("a")).alias("extra"), (F.count("*") - F.count("b")).alias("missing"))


@query("jn-28", with_derived("SELECT e.source AS id, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS domains FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'belongs_to_domain' GROUP BY e.source", "nodes", "edges"))
def soft_membership(t: Tables) -> DataFrame:
    e = t.edges.where("kind = 'belongs_to_domain'").select("source", F.col("target").alias("id"))
    return e.join(t.nodes.select("id", "name"), "id").groupBy(F.col("source").alias("id")).agg(F.concat_ws(",", F.sort_array(F.collect_set("name"))).alias("domains"))


@query("jn-29", with_derived("SELECT m.id, m.name FROM edges e JOIN nodes d ON d.id = e.target AND lower(d.name) = 'building' JOIN nodes m ON m.id = e.source WHERE e.kind = 'belongs_to_domain'", "nodes", "edges"))
def domain_members(t: Tables) -> DataFrame:
    d = t.nodes.where("lower(name) = 'building'").select(F.col("id").alias("target"))
    e = t.edges.where("kind = 'belongs_to_domain'").join(d, "target").select(F.col("source").alias("id"))
    return e.join(t.nodes.select("id", "name"), "id").select("id", "name")


@query("jn-35", "SELECT r_name AS org, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def users_of_org(t: Tables) -> DataFrame:
    asia = t.region.where("r_name = 'ASIA'").join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("org"), "c_custkey", "c_name")


@query("jn-36", "WITH r AS (SELECT p_partkey, md5(p_name) AS fp FROM part), c AS (SELECT md5(p_name) AS fp, min(p_brand) AS label FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT r.p_partkey, coalesce(c.label, 'new') AS label, c.fp IS NOT NULL AS cached FROM r LEFT JOIN c USING (fp)")
def label_cache(t: Tables) -> DataFrame:
    fp = F.md5(F.col("p_name").cast("binary")).alias("fp")
    cache = t.part.where("p_partkey % 3 = 0").groupBy(fp).agg(F.min("p_brand").alias("label"))
    return t.part.select("p_partkey", fp).join(cache, "fp", "left").select("p_partkey", F.coalesce("label", F.lit("new")).alias("label"), F.col("label").isNotNull().alias("cached"))

