"""Plans over the graph: filters, traversals, reports, audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.kinds import LAYERS, SOFT_EDGES, SOFT_NODES, community_factor, edge_quality, is_certain, is_soft_edge, is_soft_node, layer_of
from graphloom.operators.cleanse import dedup_edges, dedup_nodes
from graphloom.operators.shared import bucketed
from graphloom.operators.traverse import best_paths, path_steps, reach, steps
from graphloom.plans.registry import query
from graphloom.sources.prepared import prepared
from graphloom.sources.tables import Tables, with_derived

START = "shop:db_table:r1"
_SOFT_N = ", ".join(f"'{k}'" for k in SOFT_NODES)
_SOFT_E = ", ".join(f"'{k}'" for k in SOFT_EDGES)
LAYER = "CASE " + " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN '{layer}'" for layer, kinds in LAYERS.items()) + " ELSE 'other' END"

#: The cleansed graph: n and e.
GRAPH = f""", n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN kind = 'frontend_module' THEN 1 ELSE 0 END, ord) AS rn FROM nodes WHERE kind NOT IN ({_SOFT_N})) WHERE rn = 1),
e0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY CASE WHEN src IS NULL THEN 1 ELSE 0 END, coalesce(confidence, 1) DESC, ord) AS rn FROM edges WHERE kind NOT IN ({_SOFT_E})) WHERE rn = 1),
e AS (SELECT * FROM e0 WHERE NOT (kind = 'contains' AND target IN (SELECT id FROM n WHERE kind = 'frontend_api_call' AND url_registry)))"""


def walked(start: str, reverse: bool, depth: int = 10, condition: str = "") -> str:
    """CTE w (id, depth): the distance of each id that is reached."""
    here, there = ("target", "source") if reverse else ("source", "target")
    return f"""{GRAPH}, ee AS (SELECT DISTINCT {here} AS here, {there} AS there FROM e {condition}),
w0 AS (WITH RECURSIVE r(id, depth) AS (SELECT id, 0 FROM ({start}) UNION SELECT ee.there, r.depth + 1 FROM r JOIN ee ON ee.here = r.id WHERE r.depth < {depth}) SELECT id, min(depth) AS depth FROM r GROUP BY id),
w AS (SELECT * FROM w0 WHERE depth > 0)"""


def graph(t: Tables, **options: bool) -> tuple[DataFrame, DataFrame]:
    g = prepared(t, **options)
    return g.nodes, g.edges


def one(t: Tables, node_id: str) -> DataFrame:
    return t.spark.createDataFrame([(node_id,)], "id string")


@query("flt-01", with_derived(f"SELECT id, kind IN ({_SOFT_N}) AS soft FROM nodes", "nodes"))
def soft_nodes(t: Tables) -> DataFrame:
    return t.nodes.select("id", is_soft_node(F.col("kind")).alias("soft"))


@query("flt-02", with_derived(f"SELECT source, target, ord, kind IN ({_SOFT_E}) AS soft FROM edges", "edges"))
def soft_edges(t: Tables) -> DataFrame:
    return t.edges.select("source", "target", "ord", is_soft_edge(F.col("kind")).alias("soft"))


@query("flt-03", with_derived("SELECT ord, coalesce(confidence, 1) >= CAST(0.7 AS DOUBLE) AS certain FROM edges", "edges"))
def certain_edges(t: Tables) -> DataFrame:
    return t.edges.select("ord", is_certain(F.col("confidence")).alias("certain"))


@query("flt-04", with_derived(GRAPH + " SELECT source, target, kind, round(confidence, 6) AS confidence, src FROM e", "nodes", "edges"))
def cleansed_edges(t: Tables) -> DataFrame:
    return graph(t)[1].select("source", "target", "kind", F.round("confidence", 6).alias("confidence"), "src")


@query("flt-05", with_derived(f"SELECT id, ord, {LAYER} AS layer FROM nodes", "nodes"))
def layers(t: Tables) -> DataFrame:
    return t.nodes.select("id", "ord", layer_of(F.col("kind")).alias("layer"))


@query("flt-06", with_derived(GRAPH + f" SELECT id, kind, name, {LAYER} AS layer, file, line, is_page FROM n", "nodes", "edges"))
def node_brief(t: Tables) -> DataFrame:
    return graph(t)[0].select("id", "kind", "name", layer_of(F.col("kind")).alias("layer"), "file", "line", "is_page")


@query("flt-07", with_derived("SELECT id, name, file, line, nullif(url, '') AS url, nullif(http_method, '') AS http_method, nullif(operation_id, '') AS operation_id, nullif(service, '') AS service FROM nodes WHERE kind = 'frontend_api_call'", "nodes"))
def drift_brief(t: Tables) -> DataFrame:
    return t.nodes.where("kind = 'frontend_api_call'").select("id", "name", "file", "line", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("url", "http_method", "operation_id", "service")))


@query("flt-24", with_derived("SELECT a.id AS call, b.id AS endpoint FROM (SELECT id, url FROM nodes WHERE kind = 'frontend_api_call' AND url IS NOT NULL) a JOIN (SELECT id, url FROM nodes WHERE kind = 'backend_endpoint') b ON a.url = b.url", "nodes"))
def template_match(t: Tables) -> DataFrame:
    from graphloom.operators.links import match_templates

    calls = t.nodes.where("kind = 'frontend_api_call'").select(F.col("id").alias("call"), "url")
    ends = t.nodes.where("kind = 'backend_endpoint'").select(F.col("id").alias("endpoint"), F.col("url").alias("template"))
    return match_templates(calls, ends).select("call", "endpoint")


@query("flt-26", with_derived("SELECT id, id IN (SELECT source FROM edges WHERE kind = 'calls_api') AS linked FROM nodes WHERE kind = 'frontend_api_call'", "nodes", "edges"))
def has_calls_api(t: Tables) -> DataFrame:
    linked = t.edges.where("kind = 'calls_api'").select(F.col("source").alias("id")).distinct().withColumn("linked", F.lit(True))
    return t.nodes.where("kind = 'frontend_api_call'").select("id").join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("agg-32", with_derived("SELECT id, kind, plugin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN kind = 'frontend_module' THEN 1 ELSE 0 END, ord) AS rn FROM nodes) WHERE rn = 1", "nodes"))
def node_dedup(t: Tables) -> DataFrame:
    return dedup_nodes(t.nodes).select("id", "kind", "plugin")


@query("agg-33", with_derived("SELECT source, target, kind, src, ord FROM (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY CASE WHEN src IS NULL THEN 1 ELSE 0 END, coalesce(confidence, 1) DESC, ord) AS rn FROM edges) WHERE rn = 1", "edges"))
def edge_dedup(t: Tables) -> DataFrame:
    return dedup_edges(t.edges).select("source", "target", "kind", "src", "ord")


def _reached(t: Tables, start: str, reverse: bool, depth: int = 10) -> DataFrame:
    return prepared(t).reach(one(t, start), reverse, depth).select("id", "kind", "name", layer_of(F.col("kind")).alias("layer"), "depth", "file", "is_page")


def _from(node_id: str) -> str:
    return f"SELECT '{node_id}' AS id"


@query("grf-01", with_derived(walked(_from(START), True) + " SELECT w.id, w.depth FROM w JOIN n ON n.id = w.id", "nodes", "edges"))
def bounded_bfs(t: Tables) -> DataFrame:
    return _reached(t, START, True).select("id", "depth")


@query("grf-02", with_derived(walked(_from("shop:frontend_api_call:c7"), False, 6) + " SELECT w.id, w.depth FROM w", "nodes", "edges"))
def call_closure(t: Tables) -> DataFrame:
    """At most six hops, and none once over 400 ids are visited; ids that are no nodes count."""
    g = prepared(t)
    return g.names.join(g.depths(one(t, "shop:frontend_api_call:c7"), False, 6, 400).where("depth > 0"), "key").select("id", "depth")


@query("grf-06", with_derived(walked(_from(START), True) + f" SELECT layer, depth, count(*) AS n FROM (SELECT {LAYER} AS layer, w.depth FROM w JOIN n ON n.id = w.id) GROUP BY layer, depth", "nodes", "edges"))
def find_impact(t: Tables) -> DataFrame:
    return _reached(t, START, True).groupBy("layer", "depth").agg(F.count("*").alias("n"))


@query("grf-07", with_derived(walked(_from("shop:db_table:n3"), True) + f" SELECT {LAYER} AS layer, count(*) AS n FROM w JOIN n ON n.id = w.id GROUP BY 1", "nodes", "edges"))
def table_usage(t: Tables) -> DataFrame:
    return _reached(t, "shop:db_table:n3", True).groupBy("layer").agg(F.count("*").alias("n"))


@query("grf-08", with_derived(walked("SELECT 'shop:frontend_component:o' || CAST(min(o_orderkey) AS STRING) AS id FROM orders WHERE o_orderkey % 5 = 0", False) + " SELECT n.id, n.kind, w.depth FROM w JOIN n ON n.id = w.id", "nodes", "edges"))
def page_dependencies(t: Tables) -> DataFrame:
    start = t.orders.where("o_orderkey % 5 = 0").agg(F.concat(F.lit("shop:frontend_component:o"), F.min("o_orderkey").cast("string")).alias("id"))
    return prepared(t).reach(start, False).select("id", "kind", "depth")


@query("grf-09", with_derived(GRAPH + ", m AS (SELECT id FROM n WHERE lower(name) = lower('ASIA') AND kind = 'db_table') SELECT id, (SELECT count(*) FROM m) AS candidates FROM m", "nodes", "edges"))
def node_resolution(t: Tables) -> DataFrame:
    found = graph(t)[0].where((F.lower("name") == "asia") & (F.col("kind") == "db_table")).select("id")
    return found.withColumn("candidates", F.count("*").over(Window.partitionBy()))


@query("grf-10", with_derived(GRAPH + " SELECT id, http_method FROM n WHERE kind = 'backend_endpoint' AND url = '/parts/7'", "nodes", "edges"))
def endpoint_resolution(t: Tables) -> DataFrame:
    from graphloom.operators.links import match_templates

    ask = t.spark.createDataFrame([("q", "/parts/7/")], "call string, url string")
    ends = graph(t)[0].where("kind = 'backend_endpoint'").select(F.col("id").alias("endpoint"), F.col("url").alias("template"), "http_method")
    return match_templates(ask, ends).select(F.col("endpoint").alias("id"), "http_method")


@query("grf-11", with_derived(walked(_from("shop:db_table:n3"), True) + " SELECT n.id, w.depth, n.file FROM w JOIN n ON n.id = w.id WHERE n.is_page", "nodes", "edges"))
def impacted_pages(t: Tables) -> DataFrame:
    return _reached(t, "shop:db_table:n3", True).where("is_page").select("id", "depth", "file")


@query("grf-12", with_derived(walked("SELECT id FROM n WHERE kind = 'backend_endpoint' AND url = '/parts/7'", True) + f" SELECT n.id, w.depth FROM w JOIN n ON n.id = w.id WHERE {LAYER} = 'frontend'", "nodes", "edges"))
def api_callers(t: Tables) -> DataFrame:
    g = prepared(t)
    starts = g.nodes.where("kind = 'backend_endpoint' AND url = '/parts/7'").select("id")
    return g.reach(starts, True).where(layer_of(F.col("kind")) == "frontend").select("id", "depth")


@query("grf-13", with_derived(GRAPH + " SELECT id, name FROM n WHERE lower(name) = lower(trim(' Asia '))", "nodes", "edges"))
def name_lookup(t: Tables) -> DataFrame:
    return graph(t)[0].where(F.lower("name") == F.lower(F.trim(F.lit(" Asia ")))).select("id", "name")


@query("grf-18", with_derived(walked("SELECT id FROM n WHERE kind = 'backend_endpoint' AND url = '/parts/7'", False, 6) + " SELECT n.id, w.depth FROM w JOIN n ON n.id = w.id WHERE n.kind = 'db_table'", "nodes", "edges"))
def downstream_tables(t: Tables) -> DataFrame:
    g = prepared(t)
    starts = g.nodes.where("kind = 'backend_endpoint' AND url = '/parts/7'").select("id")
    return g.reach(starts, False, 6).where("kind = 'db_table'").select("id", "depth")


def _hop(k: int) -> str:
    here = "q WHERE here = 'shop:db_table:n3'" if k == 1 else f"h{k - 1} JOIN q ON q.here = h{k - 1}.id"
    return f"h{k} AS MATERIALIZED (SELECT there AS id, max({'q' if k == 1 else 's * q'}) AS s FROM {here} GROUP BY there)"


_GROUPS = "SELECT 'shop:frontend_api_call:c' || CAST(c_custkey AS STRING) AS id, CAST(c_nationkey AS STRING) AS c FROM customer UNION ALL SELECT 'shop:backend_endpoint:p' || CAST(p_partkey AS STRING), CAST(p_size AS STRING) FROM part"
_PATHS = f"""{GRAPH}, f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS rk FROM e), grp AS ({_GROUPS}),
q AS MATERIALIZED (SELECT target AS here, source AS there, max(coalesce(confidence, 1) * CASE src WHEN 'ast' THEN 1.0::DOUBLE WHEN 'framework' THEN 1.0::DOUBLE WHEN 'bridge' THEN 1.0::DOUBLE WHEN 'regex' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END * CASE f.kind WHEN 'imports' THEN 0.85::DOUBLE WHEN 'relates_to' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN x.c <> y.c THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * 0.9::DOUBLE) AS q
 FROM f JOIN n ON n.id = f.source LEFT JOIN grp x ON x.id = f.target LEFT JOIN grp y ON y.id = f.source WHERE rk <= 60 GROUP BY 1, 2),
{", ".join(_hop(k) for k in range(1, 11))},
every AS ({" UNION ALL ".join(f"SELECT id, s, {k} AS depth FROM h{k}" for k in range(1, 11))}),
b AS (SELECT id, max(s) AS s, CAST(arg_max(depth, (round(s, 12), -depth)) AS INT) AS depth FROM every WHERE id <> 'shop:db_table:n3' GROUP BY id)"""


def communities_of(t: Tables) -> DataFrame:
    """Customers by nation and parts by size, in place of communities that were found before."""
    name = lambda kind, c: F.concat(F.lit(f"shop:{kind}"), F.col(c).cast("string")).alias("id")
    return t.customer.select(name("frontend_api_call:c", "c_custkey"), F.col("c_nationkey").cast("string").alias("community")).union(t.part.select(name("backend_endpoint:p", "p_partkey"), F.col("p_size").cast("string")))


_WALKS: dict[tuple[str, str, str], DataFrame] = {}


def _walk(t: Tables, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Steps of a walk, written once a session and folder in buckets of where they start: each hop reads them as they are."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _WALKS:
        _WALKS[key] = bucketed(make(), f"graphloom_{name}", "here")
    return _WALKS[key]


def _scored(t: Tables) -> DataFrame:
    g = prepared(t)
    return best_paths(_walk(t, "paths", lambda: path_steps(g.nodes, g.edges, True, communities_of(t))), one(t, "shop:db_table:n3")).where("id <> 'shop:db_table:n3'")


@query("grf-05", with_derived(_PATHS + " SELECT id, round(s, 9) AS score FROM b", "nodes", "edges"))
def best_product_paths(t: Tables) -> DataFrame:
    return _scored(t).select("id", F.round("score", 9).alias("score"))


@query("top-03", with_derived(_PATHS + " SELECT id, depth, round(s, 9) AS score FROM b ORDER BY round(s, 4) DESC, depth, id LIMIT 10", "nodes", "edges"))
def top_paths(t: Tables) -> DataFrame:
    return _scored(t).orderBy(F.desc(F.round("score", 4)), "depth", "id").limit(10).select("id", "depth", F.round("score", 9).alias("score"))


def discovered(start: str, depth: int = 10) -> str:
    """CTE d (id, depth, confidence): the first discovery of each id, walking against the edges; of those of one hop, by the ordinals on the way."""
    hops = ["d0 AS (SELECT '" + start + "' AS id, 0 AS depth, [0::BIGINT] AS turn, NULL::DOUBLE AS confidence)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM d{i}" for i in range(k))
        hops.append(f"d{k} AS MATERIALIZED (SELECT id, {k} AS depth, turn, confidence FROM (SELECT e.source AS id, list_append(p.turn, e.ord) AS turn, e.confidence, row_number() OVER (PARTITION BY e.source ORDER BY list_append(p.turn, e.ord), p.id) AS rn FROM d{k - 1} p JOIN e ON e.target = p.id WHERE e.source NOT IN ({seen})) WHERE rn = 1)")
    return f"{GRAPH}, {', '.join(hops)}, d AS ({' UNION ALL '.join(f'SELECT id, depth, confidence FROM d{k}' for k in range(1, depth + 1))})"


@query("agg-03", with_derived(discovered("shop:db_table:n3") + f" SELECT {LAYER} AS layer, count(*) AS n, min(d.depth) AS nearest, count(*) FILTER (WHERE coalesce(d.confidence, 1) >= CAST(0.7 AS DOUBLE)) AS certain, count(*) FILTER (WHERE coalesce(d.confidence, 1) < CAST(0.7 AS DOUBLE)) AS candidates FROM d JOIN n ON n.id = d.id GROUP BY 1", "nodes", "edges"))
def impact_grouping(t: Tables) -> DataFrame:
    """By layer: how many are reached, and of how many the edge of the first discovery is certain."""
    nodes, edges = graph(t)
    found = reach(_walk(t, "reverse", lambda: steps(edges, True)), one(t, "shop:db_table:n3")).where("depth > 0").join(nodes.select("id", layer_of(F.col("kind")).alias("layer")), "id")
    sure = F.count_if(is_certain(F.col("confidence")))
    return found.groupBy("layer").agg(F.count("*").alias("n"), F.min("depth").alias("nearest"), sure.alias("certain"), (F.count("*") - sure).alias("candidates"))


@query("agg-04", with_derived(walked(_from("shop:db_table:n3"), True) + f""", g AS (SELECT {LAYER} AS layer, n.name FROM w JOIN n ON n.id = w.id),
c AS (SELECT count(*) AS total, max(CASE WHEN layer = 'frontend' THEN 1 ELSE 0 END) AS f, count(DISTINCT CASE WHEN layer <> 'other' THEN layer END) AS k FROM g)
SELECT g.layer, count(*) AS n, array_to_string(list_sort(list_distinct(list(g.name)))[1:10], ', ') AS preview, CASE WHEN c.f = 1 AND c.k >= 2 THEN 'high' WHEN c.total > 0 THEN 'medium' ELSE 'low' END AS risk FROM g, c GROUP BY g.layer, c.f, c.k, c.total""", "nodes", "edges"))
def impact_report(t: Tables) -> DataFrame:
    found = _reached(t, "shop:db_table:n3", True)
    first = found.select("layer", "name").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("layer").orderBy("name"))).where("rn <= 10")
    preview = first.groupBy("layer").agg(F.concat_ws(", ", F.sort_array(F.collect_list("name"))).alias("preview"))
    by = found.groupBy("layer").agg(F.count("*").alias("n")).join(preview, "layer").select("layer", "n", "preview")
    every = Window.partitionBy()
    front, hit = F.max((F.col("layer") == "frontend").cast("int")).over(every), F.sum((F.col("layer") != "other").cast("int")).over(every)
    return by.withColumn("risk", F.when((front == 1) & (hit >= 2), "high").otherwise("medium"))


@query("agg-05", with_derived(f""", ids AS (SELECT DISTINCT id FROM nodes), hard AS (SELECT * FROM edges),
d AS (SELECT kind, count(*) AS n FROM hard WHERE source NOT IN (SELECT id FROM ids) OR target NOT IN (SELECT id FROM ids) GROUP BY kind),
k AS (SELECT kind, count(*) AS n FROM (SELECT source, target, kind, count(*) AS c FROM edges GROUP BY ALL) WHERE c > 1 GROUP BY kind),
l AS (SELECT kind, count(*) AS n FROM edges WHERE coalesce(confidence, 1) < CAST(0.7 AS DOUBLE) GROUP BY kind), p AS (SELECT kind, count(*) AS n FROM edges WHERE src IS NULL GROUP BY kind)
SELECT 'dangling' AS issue, kind, n FROM d UNION ALL SELECT 'duplicate_edge', kind, n FROM k UNION ALL SELECT 'low_confidence', kind, n FROM l UNION ALL SELECT 'no_provenance', kind, n FROM p
UNION ALL SELECT 'duplicate_node', min(kind), count(*) FROM (SELECT id, min(kind) AS kind, count(*) AS c FROM nodes GROUP BY id) WHERE c > 1""", "nodes", "edges"))
def graph_audit(t: Tables) -> DataFrame:
    from graphloom.operators.audit import audit

    return audit(t.nodes, t.edges)


@query("agg-06", with_derived(""", f AS (SELECT DISTINCT id FROM nodes WHERE kind = 'frontend_api_call'), b AS (SELECT DISTINCT id FROM nodes WHERE kind = 'backend_endpoint'), c AS (SELECT * FROM edges WHERE kind = 'calls_api'),
v AS (SELECT * FROM c WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM b)),
s AS (SELECT (SELECT count(*) FROM f) AS frontend, (SELECT count(*) FROM b) AS backend, (SELECT count(*) FROM c) AS raw_edges, (SELECT count(*) FROM v) AS valid_edges, (SELECT count(DISTINCT source) FROM v) AS linked)
SELECT *, round(CAST(linked AS DOUBLE) / frontend, 4) AS ratio, CASE WHEN frontend = 0 THEN 'no_frontend_api' WHEN backend = 0 THEN 'frontend_without_backend_endpoints' WHEN valid_edges = 0 THEN 'frontend_backend_unlinked' WHEN linked < frontend THEN 'partial_frontend_linkage' ELSE 'linked' END AS status FROM s""", "nodes", "edges"))
def link_coverage(t: Tables) -> DataFrame:
    from graphloom.operators.audit import coverage

    return coverage(t.nodes, t.edges)


@query("agg-13", with_derived(GRAPH + """, m AS (SELECT id, c_nationkey AS c FROM n JOIN customer ON n.id = 'shop:frontend_api_call:c' || c_custkey UNION ALL SELECT id, p_size FROM n JOIN part ON n.id = 'shop:backend_endpoint:p' || p_partkey),
u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS w FROM e WHERE kind = 'calls_api' GROUP BY 1, 2),
t AS (SELECT sum(w) AS m FROM u), i AS (SELECT x.c, sum(w) AS w FROM u JOIN m x ON x.id = u.a JOIN m y ON y.id = u.b WHERE x.c = y.c GROUP BY x.c),
d AS (SELECT c, sum(w) AS w FROM (SELECT a AS id, w FROM u UNION ALL SELECT b, w FROM u) JOIN m USING (id) GROUP BY c)
SELECT round(sum(coalesce(i.w, 0) / t.m::DOUBLE - (d.w / (2 * t.m::DOUBLE)) ^ 2), 6) AS q FROM d LEFT JOIN i USING (c), t""", "nodes", "edges"))
def modularity_of(t: Tables) -> DataFrame:
    from graphloom.operators.community import modularity

    return modularity(graph(t)[1].where("kind = 'calls_api'"), communities_of(t)).select(F.round("q", 6).alias("q"))


@query("scl-35", with_derived("SELECT ord, round(coalesce(confidence, 1) * CASE src WHEN 'ast' THEN 1.0::DOUBLE WHEN 'framework' THEN 1.0::DOUBLE WHEN 'bridge' THEN 1.0::DOUBLE WHEN 'regex' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END * CASE kind WHEN 'imports' THEN 0.85::DOUBLE WHEN 'relates_to' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS quality FROM edges", "edges"))
def quality_of_edges(t: Tables) -> DataFrame:
    return t.edges.select("ord", F.round(edge_quality(F.col("confidence"), F.col("src"), F.col("kind")), 6).alias("quality"))


@query("scl-36", with_derived("SELECT ord, CASE WHEN src IS NOT NULL AND plugin IS NOT NULL AND src <> plugin THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM edges", "edges"))
def community_factors(t: Tables) -> DataFrame:
    return t.edges.select("ord", community_factor(F.col("src"), F.col("plugin")).alias("factor"))


@query("set-01", with_derived("SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id", "edges"))
def degrees(t: Tables) -> DataFrame:
    return t.edges.select(F.col("source").alias("id")).unionByName(t.edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


@query("top-14", with_derived("SELECT source, target, kind, ord FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM edges) WHERE rn <= 60", "edges"))
def fanout_cap(t: Tables) -> DataFrame:
    return t.edges.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("ord"))).where("rn <= 60").select("source", "target", "kind", "ord")
