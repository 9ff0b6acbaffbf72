"""Plans of analyses: soft labels, clusters, facts of files, links by use, memberships, evaluation of answers, chunks of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.kinds import LAYERS
from graphloom.operators import analysis as ops
from graphloom.operators.audit import link_status
from graphloom.operators.community import louvain, modularity
from graphloom.operators.reach import Reached, reached_tables, table_counts
from graphloom.plans.graph import GRAPH
from graphloom.plans.registry import query
from graphloom.sources.prepared import prepared
from graphloom.sources.tables import Tables, with_derived

_FRONT = ", ".join(f"'{k}'" for k in LAYERS["frontend"])
_ROLES = ("controller", "service", "repository", "adapter", "util", "gateway")
_ROLE = "['" + "', '".join(_ROLES) + "'][1 + CAST(ord % 7 AS INT)]"


def roles(t: Tables) -> DataFrame:
    """A role for most nodes of files: what a layer analyzer has found."""
    role = F.try_element_at(F.array(*map(F.lit, _ROLES)), (F.col("ord") % 7 + 1).cast("int"))
    return t.nodes.where("file IS NOT NULL AND kind <> 'frontend_module'").select("id", "name", "file", role.alias("role")).where("role IS NOT NULL")


_RL = f", rl AS (SELECT id, name, file, {_ROLE} AS role FROM nodes WHERE file IS NOT NULL AND kind <> 'frontend_module' AND ord % 7 < 6)"


@query("jn-05", """WITH s AS (SELECT 'web/p' || CAST(o_custkey % 60 AS STRING) || '.vue' AS file, arg_min('o' || CAST(o_orderkey AS STRING), (CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END, o_orderkey)) AS source FROM orders GROUP BY 1),
c AS (SELECT name, arg_min(api, k) AS api, arg_min(file, k) AS file FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE 'GET_' || CAST(c_custkey % 500 AS STRING) END AS name, 'c' || CAST(c_custkey AS STRING) AS api, 'web/p' || CAST(c_custkey % 500 % 60 AS STRING) || '.vue' AS file, c_custkey AS k FROM customer) WHERE name <> 'x' GROUP BY name),
u AS (SELECT DISTINCT 'web/p' || CAST(o_custkey % 60 AS STRING) || '.vue' AS file, 'GET_' || CAST(o_orderkey % 700 AS STRING) AS name FROM orders) SELECT DISTINCT s.source, c.api AS target FROM u JOIN c USING (name) JOIN s ON s.file = u.file WHERE c.file <> u.file""")
def api_usage(t: Tables) -> DataFrame:
    """Pages (orders) name constants of addresses (customers); a file may declare a constant itself."""
    file = F.concat(F.lit("web/p"), (F.col("o_custkey") % 60).cast("string"), F.lit(".vue"))
    sources = t.orders.select(file.alias("file"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "frontend_module").otherwise("frontend_component").alias("kind"), F.col("o_orderkey").alias("ord"))
    files = t.orders.select(file.alias("file"), F.concat(F.lit("call(urls.GET_"), (F.col("o_orderkey") % 700).cast("string"), F.lit(", x)")).alias("text"))
    number = F.col("c_custkey") % 500
    name = F.when(F.col("c_custkey") % 9 == 0, "x").otherwise(F.concat(F.lit("GET_"), number.cast("string")))
    constants = t.customer.select(name.alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("api"), F.concat(F.lit("web/p"), (number % 60).cast("string"), F.lit(".vue")).alias("file"), F.col("c_custkey").alias("ord"))
    return ops.usage_edges(files, sources, constants).select("source", "target")


_R3 = "['viewer', 'member', 'admin'][1 + {} % 3]"
_MEMBER = f"""WITH tm AS (SELECT c_custkey AS u, c_nationkey AS team, {_R3.format('c_custkey')} AS role FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 5) % 25, {_R3.format('(c_custkey + 1)')} FROM customer WHERE c_custkey % 2 = 0),
org AS (SELECT c_custkey AS u, n_regionkey AS org FROM customer JOIN nation ON n_nationkey = c_nationkey), mt AS (SELECT tm.u, team, role FROM tm JOIN nation ON n_nationkey = team JOIN org ON org.u = tm.u AND org.org = n_regionkey),
pa AS (SELECT s_suppkey % 10 AS p, CASE WHEN s_suppkey % 2 = 0 THEN 'user' ELSE 'team' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 7 ELSE s_nationkey END AS who, {_R3.format('s_suppkey')} AS role FROM supplier),
ac AS (SELECT c_custkey AS u, pa.role FROM customer JOIN pa ON pa.p = c_custkey % 10 AND kind = 'user' AND who = c_custkey UNION ALL SELECT c_custkey, pa.role FROM customer JOIN mt ON mt.u = c_custkey JOIN pa ON pa.p = c_custkey % 10 AND kind = 'team' AND who = mt.team)"""


@query("jn-13", f"""{_MEMBER} SELECT c_custkey, (SELECT string_agg(CAST(team AS STRING) || ':' || role, ',' ORDER BY team) FROM mt WHERE mt.u = c_custkey) AS teams, (SELECT ['viewer', 'member', 'admin'][max(CASE role WHEN 'viewer' THEN 1 WHEN 'member' THEN 2 ELSE 3 END)] FROM ac WHERE ac.u = c_custkey) AS project_role FROM customer""")
def membership(t: Tables) -> DataFrame:
    """Of each user: the teams of the own org, and the highest role on a project, given to the user or to one of those teams."""
    from graphloom.functions.rules import ROLES

    three = lambda c: F.element_at(F.array(*map(F.lit, ROLES)), (c % 3 + 1).cast("int"))
    u = F.col("c_custkey")
    teams = t.customer.select(u.alias("u"), F.col("c_nationkey").alias("team"), three(u).alias("role")).union(t.customer.where("c_custkey % 2 = 0").select(u, (F.col("c_nationkey") + 5) % 25, three(u + 1)))
    home = t.nation.select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("org"))
    org = t.customer.join(home, F.col("c_nationkey") == F.col("team")).select(u.alias("u"), "org")
    mine = teams.join(home, "team").join(org, ["u", "org"]).select("u", "team", "role")
    given = t.supplier.select((F.col("s_suppkey") % 10).alias("p"), F.when(F.col("s_suppkey") % 2 == 0, "user").otherwise("team").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 7).otherwise(F.col("s_nationkey")).alias("who"), three(F.col("s_suppkey")).alias("role"))
    principals = t.customer.select(u.alias("u"), F.lit("user").alias("kind"), u.alias("who")).union(mine.select("u", F.lit("team"), F.col("team").cast("long")))
    access = principals.withColumn("p", F.col("u") % 10).join(given, ["p", "kind", "who"])
    rank = F.element_at(F.create_map(*(x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v)))), F.col("role"))
    top = access.groupBy("u").agg(F.max_by("role", rank).alias("project_role"))
    told = mine.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("team", "role"))), lambda x: F.concat_ws(":", x["team"].cast("string"), x["role"])), ",").alias("teams"))
    return t.customer.select(u, u.alias("u")).join(told, "u", "left").join(top, "u", "left").select("c_custkey", "teams", "project_role")


@query("jn-15", "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS title, count(*) AS messages FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 50 OFFSET 10")
def session_list(t: Tables) -> DataFrame:
    """The newest first, one page."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    every = t.conversations.groupBy("conv_id").agg(first.alias("f"), F.count("*").alias("messages"))
    return every.orderBy(F.desc("conv_id")).offset(10).limit(50).select("conv_id", F.col("f.text").alias("title"), "messages")


_RANK = "CASE {} WHEN 'controller' THEN 0 WHEN 'gateway' THEN 0 WHEN 'adapter' THEN 1 WHEN 'service' THEN 2 WHEN 'repository' THEN 3 END"


@query("jn-16", with_derived(f"{GRAPH}{_RL}, v AS (SELECT e.source, a.role AS from_role, e.target, b.role AS to_role, e.kind AS via, n.name AS nm FROM e JOIN rl a ON a.id = e.source JOIN rl b ON b.id = e.target JOIN n ON n.id = e.source WHERE e.kind IN ('calls', 'imports') AND {_RANK.format('a.role')} > {_RANK.format('b.role')}) SELECT source, from_role, target, to_role, via, (SELECT count(*) FROM v) AS total FROM (SELECT *, row_number() OVER (ORDER BY from_role, to_role, nm, source, target, via) AS rn FROM v) WHERE rn <= 200", "nodes", "edges"))
def arch_violations(t: Tables) -> DataFrame:
    """The first 200 by roles and name, and how many there are."""
    g = prepared(t)
    found = ops.arch_violations(g.nodes, g.edges, roles(t))
    total = found.agg(F.count("*").alias("total"))
    first = found.orderBy("from_role", "to_role", "from", "source", "target", "via").limit(200)
    return first.crossJoin(F.broadcast(total)).select("source", "from_role", "target", "to_role", "via", "total")


@query("jn-18", with_derived(f"{GRAPH}, c AS (SELECT source, max(coalesce(confidence, 1)) AS best FROM e WHERE kind = 'calls_api' GROUP BY source) SELECT id, bucket, place FROM (SELECT n.id, CASE WHEN c.source IS NULL THEN 'dangling' ELSE 'uncertain' END AS bucket, row_number() OVER (PARTITION BY c.source IS NULL ORDER BY n.file, n.line, n.id) AS place FROM n LEFT JOIN c ON c.source = n.id WHERE n.kind = 'frontend_api_call' AND (c.source IS NULL OR c.best < CAST(0.7 AS DOUBLE))) WHERE place <= 200", "nodes", "edges"))
def contract_drift(t: Tables) -> DataFrame:
    g = prepared(t)
    return ops.contract_drift(g.nodes, g.edges).select("id", "bucket", "place")


@query("jn-27", with_derived(f"SELECT DISTINCT file FROM nodes WHERE kind IN ({_FRONT}) AND file IS NOT NULL AND file NOT IN (SELECT n.file FROM nodes n JOIN edges e ON e.source = n.id WHERE e.kind IN ('calls_api', 'calls_api_inferred') AND n.file IS NOT NULL)", "nodes", "edges"))
def blind_files(t: Tables) -> DataFrame:
    return ops.blind_files(t.nodes, t.edges)


@query("jn-30", "WITH m AS (SELECT c_custkey AS id, c_nationkey AS c FROM customer) SELECT id, other, n > 50 AS truncated FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rn, count(*) OVER (PARTITION BY a.id) AS n FROM m a JOIN m b ON a.c = b.c AND a.id <> b.id WHERE a.id % 100 = 0) WHERE rn <= 50")
def node_community(t: Tables) -> DataFrame:
    """The other members of a node's community, 50 at most. The first 51 members hold the first 50 others of each, so no more are joined."""
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("c"))
    few = c.withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where("rn <= 51").select("c", F.col("id").alias("other"))
    met = c.where("id % 100 = 0").join(few, "c").where("id <> other").join(c.groupBy("c").agg((F.count("*") > 51).alias("truncated")), "c")
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("other"))).where("rn <= 50").select("id", "other", "truncated")


@query("jn-31", with_derived(f"{_RL} SELECT id, role FROM rl WHERE role <> 'util'", "nodes"))
def roles_of_nodes(t: Tables) -> DataFrame:
    layers = t.spark.createDataFrame([(f"shop:arch_layer:{r}", r) for r in _ROLES if r != "util"], "target string, role string")
    edges = roles(t).select("id", F.concat(F.lit("shop:arch_layer:"), "role").alias("target"))
    return edges.join(F.broadcast(layers), "target").select("id", "role")


@query("jn-32", with_derived(f"{_RL} SELECT id, name, row_number() OVER (PARTITION BY file ORDER BY name, id) AS place FROM rl WHERE role = 'service'", "nodes"))
def layer_members(t: Tables) -> DataFrame:
    """Members of a role by name, in each file."""
    return roles(t).where("lower(role) = 'service'").select("id", "name", F.row_number().over(Window.partitionBy("file").orderBy("name", "id")).alias("place"))


@query("agg-07", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no_frontend_api' WHEN 1 THEN 'frontend_without_backend_endpoints' WHEN 2 THEN 'frontend_backend_unlinked' WHEN 3 THEN 'partial_frontend_linkage' ELSE 'linked' END AS status FROM orders")
def link_statuses(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    at = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    return t.orders.select("o_orderkey", link_status(at(0, 4, 4, 4, 4), at(3, 0, 3, 3, 3), at(0, 0, 0, 2, 4), at(0, 0, 0, 2, 4)).alias("status"))



@query("agg-08", with_derived("""SELECT project_id, 'duplicate_edge' AS issue, kind, count(*) AS n FROM (SELECT project_id, source, target, kind FROM store_edges GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL UNION ALL SELECT project_id, 'low_confidence', kind, count(*) FROM store_edges WHERE coalesce(confidence, 1) < CAST(0.7 AS DOUBLE) GROUP BY ALL UNION ALL SELECT project_id, 'no_provenance', kind, count(*) FROM store_edges WHERE src IS NULL GROUP BY ALL""", "store_edges"))
def audit_all(t: Tables) -> DataFrame:
    """The checks of every project's edges at once."""
    e = t.store_edges
    twice = e.groupBy("project_id", "source", "target", "kind").agg(F.count("*").alias("c")).where("c > 1")
    count = lambda df, issue: df.groupBy("project_id", F.lit(issue).alias("issue"), "kind").agg(F.count("*").alias("n"))
    return count(twice, "duplicate_edge").union(count(e.where("coalesce(confidence, 1) < 0.7D"), "low_confidence")).union(count(e.where("src IS NULL"), "no_provenance"))


@query("agg-09", with_derived("SELECT 'p1' AS project, 'foreign' AS what, project_id AS value FROM (SELECT DISTINCT project_id FROM store_nodes WHERE project_id <> 'p1') UNION ALL SELECT 'p1', 'soft_plugin', plugin FROM (SELECT DISTINCT plugin FROM store_nodes WHERE kind = 'business_domain' UNION SELECT DISTINCT plugin FROM store_edges WHERE kind = 'belongs_to_domain')", "store_nodes", "store_edges"))
def audit_facts(t: Tables) -> DataFrame:
    """What a store of one project should not hold: rows of others; and the plugins that made soft rows."""
    from graphloom.functions.kinds import is_soft_edge, is_soft_node

    foreign = t.store_nodes.where("project_id <> 'p1'").select(F.lit("foreign").alias("what"), F.col("project_id").alias("value"))
    soft = t.store_nodes.where(is_soft_node(F.col("kind"))).select(F.lit("soft_plugin"), "plugin").union(t.store_edges.where(is_soft_edge(F.col("kind"))).select(F.lit("soft_plugin"), "plugin"))
    return foreign.union(soft).distinct().select(F.lit("p1").alias("project"), "what", "value")


def _domains(t: Tables) -> tuple[DataFrame, DataFrame]:
    return ops.soft_axis(t.nodes, t.edges, "business_domain", "belongs_to_domain", ("frontend_api_call", "db_table"))


_AXIS = """, m AS (SELECT d.id AS target, d.name, e.source, coalesce(u.file, e.source) AS unit FROM edges e JOIN nodes d ON d.id = e.target AND d.kind = 'business_domain' LEFT JOIN (SELECT id, min(file) AS file FROM nodes GROUP BY id) u ON u.id = e.source WHERE e.kind = 'belongs_to_domain'),
lb AS (SELECT target, name, count(DISTINCT source) AS members, count(DISTINCT unit) AS files FROM m GROUP BY ALL), ax AS (SELECT (SELECT count(*) FROM nodes WHERE kind = 'business_domain') AS soft_nodes, count(*) FILTER (WHERE id IN (SELECT source FROM m)) AS labelled, count(*) AS eligible FROM (SELECT DISTINCT id FROM nodes WHERE kind IN ('frontend_api_call', 'db_table')))"""


@query("agg-10", with_derived(_AXIS + " SELECT name, members, files, round(files / (SELECT sum(files) FROM lb)::DOUBLE, 6) AS share FROM lb UNION ALL SELECT NULL, labelled, eligible, round(labelled / eligible::DOUBLE, 6) FROM ax", "nodes", "edges"))
def soft_axis(t: Tables) -> DataFrame:
    labels, axis = _domains(t)
    return labels.select("name", "members", "files", F.round("share", 6).alias("share")).union(axis.select(F.lit(None).cast("string"), "labelled", "eligible", F.round("coverage", 6)))


@query("agg-11", with_derived(_AXIS + " SELECT 'giant' AS flag, name AS detail FROM lb WHERE files > 1 AND files > 0.15 * (SELECT sum(files) FROM lb) AND (SELECT count(*) FROM lb) >= 2 UNION ALL SELECT 'low_coverage', NULL FROM ax WHERE soft_nodes > 0 AND labelled < eligible UNION ALL SELECT 'singletons', NULL FROM ax WHERE soft_nodes >= 4 AND 2 * (SELECT count(*) FROM lb WHERE members <= 1) >= soft_nodes", "nodes", "edges"))
def axis_flags(t: Tables) -> DataFrame:
    """With thresholds that the tables meet."""
    return ops.axis_flags(*_domains(t), giant=0.15, low=1.0)


_ROLE_AXIS = f"""{_RL}, rm AS (SELECT role AS name, id AS source, file AS unit FROM rl)"""


@query("agg-12", with_derived(_AXIS + _ROLE_AXIS + """, la AS (SELECT name, count(DISTINCT source) AS members, count(DISTINCT unit) AS files FROM rm GROUP BY name), el AS (SELECT count(*) AS eligible, count(*) FILTER (WHERE id IN (SELECT source FROM rm)) AS labelled FROM (SELECT DISTINCT id FROM nodes WHERE kind IN ('backend_function', 'backend_endpoint')))
SELECT 'domains' AS axis, (SELECT count(*) FROM lb) AS labels, (SELECT sum(members) FROM lb)::BIGINT AS members, round((SELECT labelled / eligible::DOUBLE FROM ax), 6) AS coverage UNION ALL SELECT 'layers', (SELECT count(*) FROM la), (SELECT sum(members) FROM la)::BIGINT, round((SELECT labelled / eligible::DOUBLE FROM el), 6)""", "nodes", "edges"))
def soft_quality(t: Tables) -> DataFrame:
    """The axes of domains and of layers."""
    layer = t.spark.createDataFrame([(f"layer:{r}", "arch_layer", r) for r in _ROLES], "id string, kind string, name string").withColumn("file", F.lit(None).cast("string"))
    nodes = t.nodes.select("id", "kind", "name", "file").union(layer)
    plays = roles(t).select(F.col("id").alias("source"), F.concat(F.lit("layer:"), "role").alias("target"), F.lit("plays_role").alias("kind"))
    out = None
    for name, (labels, axis) in {"domains": _domains(t), "layers": ops.soft_axis(nodes, plays, "arch_layer", "plays_role", ("backend_function", "backend_endpoint"))}.items():
        one = labels.agg(F.lit(name).alias("axis"), F.count("*").alias("labels"), F.sum("members").alias("members")).crossJoin(F.broadcast(axis.select(F.round("coverage", 6).alias("coverage"))))
        out = one if out is None else out.union(one)
    return out


#: Endpoints and the tables that they reach within six hops.
_PAIRS = f"{GRAPH}, w AS (WITH RECURSIVE r(s, id, depth) AS (SELECT id, id, 0 FROM n WHERE kind = 'backend_endpoint' UNION SELECT r.s, e.target, r.depth + 1 FROM r JOIN (SELECT DISTINCT source, target FROM e) e ON e.source = r.id WHERE r.depth < 6) SELECT DISTINCT s AS endpoint, id AS tbl FROM r WHERE id IN (SELECT id FROM n WHERE kind = 'db_table')), fan AS (SELECT tbl, count(*) AS n FROM w GROUP BY tbl), hub AS (SELECT tbl, n FROM fan WHERE n >= greatest(3, (SELECT list_sort(list(n))[1 + least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT))] FROM fan)))"


def _reached(t: Tables) -> Reached:
    g = prepared(t)
    named = lambda kind, name: g.nodes.where(F.col("kind") == kind).select(g.key().alias("key"), F.col("id").alias(name))
    return reached_tables(g.forward, named("backend_endpoint", "id"), named("db_table", "table"), 6)


@query("agg-14", with_derived(_PAIRS + " SELECT tbl AS \"table\", n FROM hub", "nodes", "edges"))
def hub_tables(t: Tables) -> DataFrame:
    return ops.hub_tables(table_counts(_reached(t)))


@query("agg-15", with_derived(""", f AS (SELECT file, bool_or(kind = 'backend_endpoint') AS endpoint, count(*) FILTER (WHERE kind = 'backend_function') AS functions, bool_and(kind IN (""" + _FRONT + """)) AS frontend, bool_or(coalesce(is_page, false)) AS page FROM nodes WHERE file IS NOT NULL GROUP BY file), fa AS (SELECT id, arg_max(file, ord) AS file FROM nodes WHERE file IS NOT NULL GROUP BY id),
o AS (SELECT fa.file, count(*) FILTER (WHERE e.kind = 'imports') AS imports_out, count(DISTINCT CASE WHEN e.kind IN ('reads_table', 'writes_table') THEN e.target END) AS tables FROM edges e JOIN fa ON fa.id = e.source GROUP BY fa.file), i AS (SELECT fa.file, count(*) AS imports_in FROM edges e JOIN fa ON fa.id = e.target WHERE e.kind = 'imports' GROUP BY fa.file)
SELECT f.file, endpoint, functions, coalesce(tables, 0) AS tables, coalesce(imports_out, 0) AS imports_out, coalesce(imports_in, 0) AS imports_in, frontend, page FROM f LEFT JOIN o USING (file) LEFT JOIN i USING (file)""", "nodes", "edges"))
def file_facts(t: Tables) -> DataFrame:
    return ops.file_facts(t.nodes, t.edges)


#: Endpoints of which one in three has no file.
_CL = _PAIRS + ", en AS (SELECT id, CASE WHEN ord % 3 > 0 THEN file END AS file FROM n WHERE kind = 'backend_endpoint'), hw AS (SELECT tbl FROM fan WHERE tbl LIKE '%:r%' UNION SELECT tbl FROM hub)"


def _clusters(t: Tables) -> tuple[DataFrame, Reached, DataFrame]:
    reached = _reached(t)
    ends = prepared(t).nodes.where("kind = 'backend_endpoint'").select("id", F.when(F.col("ord") % 3 > 0, F.col("file")).alias("file"))
    # The five tables that all reach count as hubs too, so that some clusters are apart.
    hubs = ops.hub_tables(table_counts(reached)).select("table").union(reached.tables.where("table LIKE '%:r%'").select("table")).distinct()
    return ops.endpoint_clusters(ends, reached, hubs), reached, hubs


_ROOTS = ", lk AS (SELECT e.id, 'f' || e.file AS g FROM en e WHERE file IS NOT NULL UNION SELECT e.id, 't' || w.tbl FROM en e JOIN w ON w.endpoint = e.id WHERE file IS NULL AND w.tbl NOT IN (SELECT tbl FROM hw)), rt AS (WITH RECURSIVE c(id, root) USING KEY (id) AS (SELECT id, id FROM en UNION SELECT x.id, x.root FROM (SELECT a.id, min(c.root) AS root FROM c JOIN lk b ON b.id = c.id JOIN lk a ON a.g = b.g GROUP BY a.id) x JOIN recurring.c y ON y.id = x.id WHERE x.root < y.root) SELECT id, root FROM c)"


@query("grf-17", with_derived(_CL + _ROOTS + " SELECT id, root FROM rt", "nodes", "edges"))
def clusters(t: Tables) -> DataFrame:
    return _clusters(t)[0]


@query("win-05", with_derived(_CL + _ROOTS + """, es AS (SELECT root, 'e' || CAST(k AS STRING) AS ref, 'endpoint' AS kind, id FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM rt) WHERE k <= 40), rm AS (SELECT root, 40 - count(*) AS room FROM es GROUP BY root),
ts AS (SELECT root, 't' || CAST(k AS STRING) AS ref, 'table' AS kind, tbl AS id FROM (SELECT root, tbl, row_number() OVER (PARTITION BY root ORDER BY count(DISTINCT endpoint) DESC, tbl) AS k FROM w JOIN rt ON rt.id = w.endpoint WHERE tbl NOT IN (SELECT tbl FROM hw) GROUP BY root, tbl) JOIN rm USING (root) WHERE k <= room) SELECT * FROM es UNION ALL SELECT * FROM ts""", "nodes", "edges"))
def cluster_requests(t: Tables) -> DataFrame:
    return ops.cluster_requests(*_clusters(t))


@query("lin-39", with_derived(_CL + _ROOTS + ", lb AS (SELECT root, CASE WHEN abs(hash_) % 4 = 0 THEN NULL ELSE 'd' || CAST(hash_ % 5 AS STRING) END AS domain FROM (SELECT DISTINCT root, length(root) AS hash_ FROM rt)) SELECT id AS source, 'shop:business_domain:' || domain AS target FROM rt JOIN lb USING (root) WHERE domain IS NOT NULL", "nodes", "edges"))
def domain_analyzer(t: Tables) -> DataFrame:
    """Clusters get the labels that a labeler has left for them; those without one stay unlabelled."""
    found = _clusters(t)[0]
    n = F.length("root")
    labels = found.select("root").distinct().select("root", F.when(n % 4 > 0, F.concat(F.lit("d"), (n % 5).cast("string"))).alias("domain"))
    soft = found.join(labels.where("domain IS NOT NULL"), "root").select(F.col("id").alias("source"), F.concat(F.lit("shop:business_domain:"), "domain").alias("target"), F.lit(ops.SOFT_CONFIDENCE).alias("confidence"))
    nodes = soft.select(F.col("target").alias("id"), "confidence").distinct()
    return ops.validated(nodes, soft, prepared(t).nodes)[1].select("source", "target")


@query("lin-40", with_derived(f"{GRAPH}, fx AS (SELECT file, CASE WHEN bool_or(kind = 'backend_endpoint') THEN 'controller' WHEN bool_or(kind = 'backend_function') THEN 'service' END AS role FROM n WHERE file IS NOT NULL GROUP BY file) SELECT n.id AS source, 'shop:arch_layer:' || role AS target FROM n JOIN fx USING (file) WHERE role IS NOT NULL AND n.kind NOT IN ('db_table', 'db_column')", "nodes", "edges"))
def layer_analyzer(t: Tables) -> DataFrame:
    """Files get roles by their facts (in the place of a labeler), and each node of code in a file plays its role."""
    g = prepared(t)
    facts = ops.file_facts(g.nodes, g.edges)
    labels = facts.select("file", F.when(F.col("endpoint"), "controller").when(F.col("functions") > 0, "service").alias("role")).where("role IS NOT NULL")
    return g.nodes.where("kind NOT IN ('db_table', 'db_column')").join(labels, "file").select(F.col("id").alias("source"), F.concat(F.lit("shop:arch_layer:"), "role").alias("target"))


@query("lin-41", with_derived(f", b AS (SELECT DISTINCT file FROM nodes WHERE kind IN ({_FRONT}) AND file IS NOT NULL AND file NOT IN (SELECT n.file FROM nodes n JOIN edges e ON e.source = n.id WHERE e.kind IN ('calls_api', 'calls_api_inferred') AND n.file IS NOT NULL)), ep AS (SELECT id, row_number() OVER (ORDER BY url, id) AS k FROM (SELECT id, min(url) AS url FROM nodes WHERE kind = 'backend_endpoint' GROUP BY id) LIMIT 200) SELECT b.file, ep.id AS target FROM b JOIN ep ON ep.k = 1 + length(b.file) * 37 % 250", "nodes", "edges"))
def link_analyzer(t: Tables) -> DataFrame:
    """Blind files and the numbered endpoints that a labeler has named for them; numbers that are none are dropped."""
    from graphloom.operators.repos import numbered

    ends = t.nodes.where("kind = 'backend_endpoint'").groupBy("id").agg(F.min("url").alias("url")).withColumn("o", F.struct("url", "id")).orderBy("o").limit(200)
    refs = numbered(ends, "o").select(F.col("id").alias("target"), (F.col("number") + 1).alias("k"))
    labels = ops.blind_files(t.nodes, t.edges).withColumn("k", (1 + F.length("file") * 37 % 250).cast("long"))
    return labels.join(F.broadcast(refs), "k").select("file", "target")


@query("lin-38", with_derived(f"{GRAPH}, x AS (SELECT source, target, confidence FROM edges WHERE kind = 'belongs_to_domain' AND ord % 2 = 0 UNION ALL SELECT source || 'x', target, confidence FROM edges WHERE kind = 'belongs_to_domain' AND ord % 2 = 1) SELECT source, target, CASE WHEN confidence < 0.9 THEN confidence ELSE CASE WHEN confidence < 1 THEN confidence ELSE 0.7 END END AS confidence FROM x WHERE source IN (SELECT id FROM n)", "nodes", "edges"))
def analyzers_pass(t: Tables) -> DataFrame:
    """Soft rows of an analyzer over the hard part: edges to nodes that are not there go."""
    hard, _ = ops.hard_part(t.nodes, t.edges)
    soft = t.edges.where("kind = 'belongs_to_domain'").select(F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit("x"))).alias("source"), "target", "confidence")
    nodes = t.nodes.where("kind = 'business_domain'").select("id", F.lit(1.0).alias("confidence"))
    return ops.validated(nodes, soft, hard)[1].select("source", "target", "confidence")


@query("grf-14", None)
def communities(t: Tables) -> DataFrame:
    """Of all hard nodes and edges."""
    g = prepared(t)
    nodes, edges = g.nodes.select(F.lit("shop").alias("project_id"), "id"), g.edges.select(F.lit("shop").alias("project_id"), "source", "target")
    return louvain(edges, nodes=nodes)


# One level by the rounds of `operators.community`: each step of the recursion is a round, and its last step has the communities.
_CALLS = "'calls_api', 'calls', 'reads_table', 'writes_table', 'relates_to'"
_LOCAL = f""", pr AS (SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(count(*) AS DOUBLE) AS w FROM e WHERE kind IN ({_CALLS}) AND source <> target GROUP BY ALL),
bo AS (SELECT a AS x, b AS y, w FROM pr UNION ALL SELECT b, a, w FROM pr), nd AS (SELECT x, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS p, sum(w) AS d, sum(sum(w)) OVER () AS everything FROM bo GROUP BY x),
lv AS (WITH RECURSIVE st(k, x, c) AS (SELECT 0, x, x FROM nd UNION ALL
 SELECT k, x, c FROM (
  WITH f AS (SELECT st.k, nd.*, st.c AS home, CASE WHEN r = 0 THEN p ELSE ((p & ((1::BIGINT << (60 - r)) - 1)) << r) | (p >> (60 - r)) END AS h FROM (SELECT *, 11 * k % 60 AS r FROM st) st JOIN nd USING (x)),
  t AS (SELECT home AS c, sum(d) AS t FROM f GROUP BY home),
  w AS (SELECT x, c, sum(w) AS w FROM (SELECT bo.x, g.home AS c, w FROM bo JOIN f g ON g.x = bo.y UNION ALL SELECT x, home, 0 FROM f) GROUP BY ALL),
  s AS (SELECT f.*, w.c, w.w, t.t, w.w - (t.t - CASE WHEN w.c = home THEN d ELSE 0 END) * d / everything AS g FROM w JOIN f USING (x) JOIN t ON t.c = w.c),
  b AS (SELECT x, arg_min({{'c': c, 'w': w, 't': t, 'g': g}}, (-g, c)) AS b, max(CASE WHEN c = home THEN g END) AS g0, max(CASE WHEN c = home THEN w END) AS w0, max(CASE WHEN c = home THEN t END) AS t0, any_value(home) AS home, any_value(h) AS h, any_value(d) AS d, any_value(everything) AS everything FROM s GROUP BY x),
  q AS (SELECT * FROM b WHERE b.g - g0 > 1e-9 AND b.c <> home),
  m AS (SELECT * FROM q WHERE x NOT IN (SELECT q.x FROM q JOIN bo ON bo.x = q.x JOIN q z ON z.x = bo.y WHERE z.h > q.h OR z.h = q.h AND z.x > q.x)),
  i AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY b.c ORDER BY h DESC, x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS enters, coalesce(sum(d) OVER (PARTITION BY home ORDER BY h DESC, x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leaves FROM m),
  o AS (SELECT x, b.c AS c FROM i WHERE b.w - (b.t + enters) * d / everything - (w0 - (t0 - d - leaves) * d / everything) > 1e-9)
  SELECT f.k + 1 AS k, f.x, coalesce(o.c, f.home) AS c FROM f LEFT JOIN o USING (x) WHERE f.k < 60 AND EXISTS (SELECT 1 FROM o))) SELECT x, c FROM st WHERE k = (SELECT max(k) FROM st))"""


@query("grf-15", with_derived(f"{GRAPH}{_LOCAL} SELECT x AS id, min(x) OVER (PARTITION BY c) AS community FROM lv", "nodes", "edges"))
def local_moves(t: Tables) -> DataFrame:
    """One level of moves: the community of each call, endpoint, function and table."""
    edges = prepared(t).edges.where(f"kind IN ({_CALLS})").select(F.lit("shop").alias("project_id"), "source", "target")
    return louvain(edges, levels=1).select("id", "community")


@query("grf-16", with_derived(f"{GRAPH}, m AS (SELECT 'shop:frontend_api_call:c' || CAST(c_custkey AS STRING) AS id, 'c' || CAST(c_nationkey AS STRING) AS c FROM customer UNION ALL SELECT 'shop:backend_endpoint:p' || CAST(p_partkey AS STRING), 'p' || CAST(p_size % 5 AS STRING) FROM part) SELECT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, count(*) AS w FROM e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE e.kind = 'calls_api' GROUP BY ALL", "nodes", "edges"))
def contract(t: Tables) -> DataFrame:
    """Communities as nodes, the weights between and inside them added up."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    of = t.customer.select(name("shop:frontend_api_call:c", "c_custkey"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("c")).union(t.part.select(name("shop:backend_endpoint:p", "p_partkey"), F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string"))))
    e = prepared(t).edges.where("kind = 'calls_api'")
    met = e.join(of.select(F.col("id").alias("source"), F.col("c").alias("ca")), "source").join(of.select(F.col("id").alias("target"), F.col("c").alias("cb")), "target")
    return met.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("w"))


@query("grf-19", with_derived("SELECT kind, string_agg(DISTINCT plugin, ',' ORDER BY plugin) AS plugins FROM nodes GROUP BY kind HAVING count(DISTINCT plugin) >= 1", "nodes"))
def kind_owners(t: Tables) -> DataFrame:
    return t.nodes.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_set("plugin")), ",").alias("plugins"))


@query("grf-20", "WITH RECURSIVE x AS (SELECT 'p' || CAST(s_suppkey AS STRING) AS parent, 'p' || CAST(s_suppkey * 3 % 100 + 1 AS STRING) AS child FROM supplier WHERE s_suppkey % 4 > 0), r AS (SELECT 'r' || CAST(s_nationkey AS STRING) AS repo, 'p' || CAST(s_suppkey AS STRING) AS id FROM supplier UNION SELECT r.repo, x.parent FROM r JOIN x ON x.child = r.id) SELECT DISTINCT repo, id AS project FROM r")
def impacted_projects(t: Tables) -> DataFrame:
    """Projects of a changed repository (nation), and all that list one of those as an extra repository, and so on."""
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    k = F.col("s_suppkey")
    extra = t.supplier.where("s_suppkey % 4 > 0").select(p(k * 3 % 100 + 1).alias("here"), p(k).alias("there"))
    starts = t.supplier.select(F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("repo"), p(k).alias("id"))
    reached = ops.reach_pairs(extra.distinct(), starts.select("id").distinct(), 1_000_000)
    return starts.join(reached.select(F.col("start").alias("id"), F.col("id").alias("project")), "id").select("repo", "project").distinct()


# Evaluation of labels and answers.


@query("agg-54", with_derived(f"{_RL} SELECT file, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM rl GROUP BY file", "nodes"))
def file_labels(t: Tables) -> DataFrame:
    return roles(t).groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


_CASES = "cs AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'src/svc_' WHEN 1 THEN 'svc_' ELSE 'none_' END || CAST(s_nationkey AS STRING) || '.py' AS golden, ['controller', 'service', 'repository'][1 + s_suppkey % 3] AS expect FROM supplier)"


@query("agg-47", with_derived(f"{_RL}, {_CASES}, g AS (SELECT s_suppkey, expect, list(DISTINCT role) FILTER (WHERE role IS NOT NULL) AS got FROM cs LEFT JOIN rl ON rl.file = cs.golden OR ends_with(rl.file, '/' || cs.golden) GROUP BY ALL) SELECT count(*) AS total, count(*) FILTER (WHERE list_contains(got, expect)) AS correct, count(*) FILTER (WHERE got IS NULL) AS unlabeled, round(count(*) FILTER (WHERE list_contains(got, expect)) / count(*)::DOUBLE, 3) AS accuracy FROM g", "nodes"))
def label_accuracy(t: Tables) -> DataFrame:
    """A file is meant by its path or by an end of it: ends of paths are made of the files, so that the join has equal keys."""
    parts = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    actual = roles(t).select("role", F.explode(ends).alias("golden")).groupBy("golden").agg(F.collect_set("role").alias("got"))
    k = F.col("s_suppkey") % 3
    cases = t.supplier.select("s_suppkey", F.concat(F.when(k == 0, "src/svc_").when(k == 1, "svc_").otherwise("none_"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("golden"), F.element_at(F.array(*map(F.lit, ("controller", "service", "repository"))), (k + 1).cast("int")).alias("expect"))
    met = cases.join(actual, "golden", "left")
    right = F.count_if(F.coalesce(F.array_contains("got", F.col("expect")), F.lit(False)))
    return met.agg(F.count("*").alias("total"), right.alias("correct"), F.count_if(F.col("got").isNull()).alias("unlabeled"), F.round(right / F.count("*"), 3).alias("accuracy"))


#: Answers are the documents; asked for are some words, not wanted others.
_MUST, _NOT, _TOOLS = ("the", "and", "und", "les"), ("license",), ("a", "b")
_CASE = "SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)') THEN 1 ELSE 0 END" for w in _MUST) + f" AS hit, regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){_NOT[0]}([^A-Za-z0-9]|$)') AS bad, doc_id % 3 < 2 AS tool_ok, doc_id % 7 <= 4 AS within_budget FROM documents"


def _scores(t: Tables) -> DataFrame:
    says = lambda w: F.coalesce(F.col("text").rlike(f"(?i)(?<![A-Za-z0-9]){w}(?![A-Za-z0-9])"), F.lit(False))
    hit = sum((says(w).cast("int") for w in _MUST), F.lit(0))
    used = F.element_at(F.array(F.array(F.lit("a"), F.lit("z")), F.array(F.lit("b")), F.array(F.lit("z"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", F.round(hit / len(_MUST), 3).alias("coverage"), says(_NOT[0]).alias("hallucinated"), F.arrays_overlap(used, F.array(*map(F.lit, _TOOLS))).alias("tool_ok"), (F.col("doc_id") % 7 <= 4).alias("within_budget"))


@query("agg-48", f"SELECT doc_id, round(hit / 4.0::DOUBLE, 3) AS coverage, bad AS hallucinated, tool_ok, within_budget FROM ({_CASE})")
def case_scores(t: Tables) -> DataFrame:
    return _scores(t)


@query("agg-49", f"SELECT round(avg(round(hit / 4.0::DOUBLE, 3)), 3) AS coverage, round(avg(CASE WHEN bad THEN 1.0::DOUBLE ELSE 0 END), 3) AS hallucination_rate, round(avg(CASE WHEN tool_ok THEN 1.0::DOUBLE ELSE 0 END), 3) AS tool_rate, round(avg(CASE WHEN within_budget THEN 1.0::DOUBLE ELSE 0 END), 3) AS budget_rate FROM ({_CASE})")
def suite(t: Tables) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    return _scores(t).agg(rate("coverage").alias("coverage"), rate("hallucinated").alias("hallucination_rate"), rate("tool_ok").alias("tool_rate"), rate("within_budget").alias("budget_rate"))


@query("agg-51", with_derived("SELECT " + ", ".join(f"round(max(CASE WHEN i = greatest(1, least(n, CAST(round_even({p} / 100.0::DOUBLE * n, 0) AS BIGINT))) THEN elapsed_ms END) * 1000, 2) AS p{p}" for p in (50, 95, 99)) + " FROM (SELECT elapsed_ms, row_number() OVER (ORDER BY elapsed_ms) AS i, count(*) OVER () AS n FROM usage WHERE elapsed_ms IS NOT NULL)", "usage"))
def latency_percentiles(t: Tables) -> DataFrame:
    """Nearest rank, in thousandths."""
    from graphloom.operators.telemetry import percentile

    place = {f"p{p}": (lambda n, p=p: F.greatest(F.lit(1), F.least(n, F.bround(F.lit(p / 100) * n).cast("long")))) for p in (50, 95, 99)}
    found = percentile(t.usage, [], "elapsed_ms", place, places=None)
    return found.select(*(F.round(F.col(f"p{p}") * 1000, 2).alias(f"p{p}") for p in (50, 95, 99)))


# Chunks of code.

_LINES = "string_split(text, chr(10))"


@query("scl-21", f"WITH RECURSIVE l AS (SELECT doc_id, {_LINES} AS ls FROM documents), r AS (SELECT doc_id, ls, 1 AS n, length(ls[1]) + 1 AS size FROM l UNION ALL SELECT doc_id, ls, n + 1, size + length(ls[n + 1]) + 1 FROM r WHERE n < len(ls) AND size + length(ls[n + 1]) + 1 <= 400) SELECT doc_id, array_to_string(ls[1:max(n)], chr(10)) AS head FROM r GROUP BY doc_id, ls")
def head_at_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ops.head_at_line(F.split("text", "\n"), 400).alias("head"))


#: Sources of 400 lines each, long and short ones.
def _sources(t: Tables) -> DataFrame:
    line = lambda i: F.concat(F.lit("line "), i.cast("string"), F.repeat(F.lit("x"), (i * 7 % 40).cast("int")))
    return t.nation.select(F.concat(F.lit("src/f"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), line), "\n").alias("text"))


_SRC = "src AS (SELECT 'src/f' || CAST(n_nationkey AS STRING) || '.py' AS path, [ 'line ' || CAST(i AS STRING) || repeat('x', CAST(i * 7 % 40 AS INT)) FOR i IN range(1, 401)] AS ls FROM nation)"
_SYM = "sy AS (SELECT 's' || CAST(s_suppkey AS STRING) AS id, CASE s_suppkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'variable' END AS kind, CASE WHEN s_suppkey % 11 = 0 THEN '../src/f' ELSE 'src/f' END || CAST(s_nationkey AS STRING) || '.py' AS path, s_suppkey % 50 AS a, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 50 + s_suppkey * 13 % 330 END AS b, s_name AS name FROM supplier)"


def _symbols(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "class").when(k % 3 == 1, "function").otherwise("variable").alias("kind"), F.concat(F.when(k % 11 == 0, "../src/f").otherwise("src/f"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("path"), (k % 50).cast("int").alias("start_line"), F.when(k % 5 > 0, k % 50 + k * 13 % 330).cast("int").alias("end_line"), F.col("s_name").alias("name"))


@query("ret-22", f"WITH {_SRC}, {_SYM} SELECT id, len(x) AS n, md5(array_to_string(x, chr(10))) AS h FROM (SELECT id, ls[a:coalesce(b, a)] AS x FROM sy JOIN src USING (path) WHERE a > 0)")
def source_slices(t: Tables) -> DataFrame:
    """Paths that lead out of the repository, and symbols without a line, give none."""
    return ops.source_slice(_symbols(t), _sources(t)).select("id", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("h"))


_WINDOWS = """wn AS (WITH RECURSIVE r AS (SELECT id, ls, 1 AS a, 1 AS e, CAST(NULL AS BIGINT) AS emitted, 0 AS pos FROM body UNION ALL
 SELECT id, ls, CASE WHEN nx > len(ls) THEN len(ls) + 1 ELSE greatest(nx - 8, a + 1) END, nx, a, pos + 1 FROM (SELECT *, a + (SELECT count(*) FROM (SELECT sum(length(ls[i]) + 1) OVER (ORDER BY i) AS s FROM range(a, len(ls) + 1) t(i)) WHERE s <= {b}) AS nx FROM r WHERE a <= len(ls))) SELECT id, pos - 1 AS pos, array_to_string(ls[emitted:e - 1], chr(10)) AS w FROM r WHERE emitted IS NOT NULL)"""


@query("win-08", f"WITH {_SRC}, body AS (SELECT path AS id, ls FROM src), {_WINDOWS.format(b=1500)} SELECT id AS path, CAST(pos AS INT) AS \"at\", w AS \"window\" FROM wn")
def line_windows(t: Tables) -> DataFrame:
    return ops.line_windows(_sources(t), 1500, 8)


_CHUNKS = f"""WITH RECURSIVE {_SRC}, {_SYM}, st AS (SELECT sy.id, kind, name, CASE WHEN a > 0 AND src.path IS NOT NULL THEN ls[a:coalesce(b, a)] ELSE [] END AS ls FROM sy LEFT JOIN src ON src.path = sy.path), body AS (SELECT id, ls FROM st WHERE kind = 'function' AND length(array_to_string(ls, chr(10))) > 3500), {_WINDOWS.format(b=3500)},
hd AS (SELECT id, kind, name, ls, CASE kind WHEN 'class' THEN 1800 ELSE 3500 END AS budget FROM st WHERE id NOT IN (SELECT id FROM body)), hn AS (SELECT id, name, ls, (SELECT count(*) FROM (SELECT sum(length(ls[i]) + 1) OVER (ORDER BY i) AS s, i FROM range(1, len(ls) + 1) t(i)) WHERE s <= budget OR i = 1) AS k FROM hd),
ck AS (SELECT id, id AS chunk_id, CASE WHEN k > 0 THEN name || chr(10) || array_to_string(ls[1:k], chr(10)) ELSE name END AS text FROM hn UNION ALL SELECT wn.id, wn.id || '#' || CAST(pos AS STRING), name || chr(10) || w FROM wn JOIN st ON st.id = wn.id WHERE pos < 12)"""


@query("ret-21", f"{_CHUNKS} SELECT id, chunk_id, md5(text) AS h FROM ck")
def code_chunks(t: Tables) -> DataFrame:
    return ops.code_chunks(_symbols(t), _sources(t), F.col("name")).select("id", "chunk_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("ret-23", f"{_CHUNKS} SELECT 'r' || CAST(i AS STRING) AS repo, count(*) AS n, count(DISTINCT ck.id) AS nodes FROM ck JOIN sy ON sy.id = ck.id, range(2) t(i) WHERE kind <> 'variable' GROUP BY i")
def chunk_collection(t: Tables) -> DataFrame:
    """The chunks of two repositories of one content, without kinds that are skipped."""
    kept = _symbols(t).where("kind <> 'variable'")
    out = None
    for repo in ("r0", "r1"):
        one = ops.code_chunks(kept, _sources(t), F.col("name")).select(F.lit(repo).alias("repo"), "id", "chunk_id")
        out = one if out is None else out.union(one)
    return out.groupBy("repo").agg(F.count("*").alias("n"), F.countDistinct("id").alias("nodes"))
