"""Where queries read from: the tables of a folder, and the graph, memories and telemetry derived from them.

The derivations are plain SQL that Spark and other engines read alike, so that each query can be compared with SQL over the same rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_NODE = {"plugin": "'scan'", "file": "CAST(NULL AS STRING)", "line": "CAST(NULL AS INT)", "url": "CAST(NULL AS STRING)", "http_method": "CAST(NULL AS STRING)", "service": "CAST(NULL AS STRING)", "operation_id": "CAST(NULL AS STRING)", "url_registry": "false", "is_page": "false"}


def _node(table: str, group: int, kind: str, letter: str, key: str, name: str, where: str = "", **columns: str) -> str:
    rest = ", ".join(f"{v} AS {c}" for c, v in (_NODE | columns).items())
    return f"SELECT 'shop:{kind}:{letter}' || CAST({key} AS STRING) AS id, '{kind}' AS kind, {name} AS name, {rest}, CAST({group} AS BIGINT) * 1000000000000 + {key} AS ord FROM {table} {where}"


NODES = " UNION ALL ".join(
    (
        _node("region", 1, "db_table", "r", "r_regionkey", "r_name", plugin="'sql'", file="'db/region.sql'", line="r_regionkey + 1"),
        _node("nation", 2, "db_table", "n", "n_nationkey", "n_name", plugin="'sql'", file="'db/nation.sql'", line="n_nationkey + 1"),
        _node("supplier", 3, "backend_function", "s", "s_suppkey", "s_name", file="'src/svc_' || CAST(s_nationkey AS STRING) || '.py'", line="CAST(s_suppkey % 400 AS INT)"),
        _node("part", 4, "backend_endpoint", "p", "p_partkey", "p_name", file="'src/api_' || CAST(p_size AS STRING) || '.py'", line="CAST(p_partkey % 400 AS INT)", url="'/parts/' || CAST(p_partkey % 400 AS STRING)", http_method="CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'put' END", service="CASE WHEN p_partkey % 3 > 0 THEN p_brand END", operation_id="CASE WHEN p_partkey % 4 = 0 THEN 'op' || CAST(p_partkey % 300 AS STRING) END"),
        # The same file as two kinds by two plugins: the weak kind comes first for some.
        _node("orders", 5, "frontend_component", "o", "o_orderkey", "'order-' || CAST(o_orderkey AS STRING)", "WHERE o_orderkey % 10 = 0", plugin="'deps'").replace("'frontend_component' AS kind", "'frontend_module' AS kind"),
        _node("orders", 6, "frontend_component", "o", "o_orderkey", "'order-' || CAST(o_orderkey AS STRING)", plugin="'vue'", file="CASE WHEN o_orderkey % 5 = 0 THEN 'web/pages/o' ELSE 'web/parts/o' END || CAST(o_custkey % 500 AS STRING) || '.vue'", is_page="o_orderkey % 5 = 0"),
        _node("customer", 7, "frontend_api_call", "c", "c_custkey", "c_name", plugin="'vue'", file="'web/api_' || CAST(c_nationkey AS STRING) || '.js'", line="CAST(c_custkey % 900 AS INT)", url="CASE WHEN c_custkey % 13 > 0 THEN '/parts/' || CAST(c_custkey % 450 AS STRING) END", http_method="CASE c_custkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END", service="CASE WHEN c_custkey % 7 = 0 THEN 'Brand#11' END", operation_id="CASE WHEN c_custkey % 5 = 0 THEN 'op' || CAST(c_custkey % 320 AS STRING) END", url_registry="c_custkey % 17 = 0"),
        "SELECT 'shop:business_domain:' || c_mktsegment AS id, 'business_domain' AS kind, c_mktsegment AS name, " + ", ".join(f"{v} AS {c}" for c, v in (_NODE | {"plugin": "'domains'"}).items()) + ", 8000000000000 + min(c_custkey) AS ord FROM customer GROUP BY c_mktsegment",
    )
)

_SRC = "CASE {k} % 5 WHEN 0 THEN 'ast' WHEN 1 THEN 'framework' WHEN 2 THEN 'regex' WHEN 3 THEN 'bridge' END"


def _edge(table: str, group: int, source: str, target: str, kind: str, key: str, confidence: str | None = None, order: str | None = None, where: str = "", plugin: str = "'scan'") -> str:
    confidence = confidence or f"CAST(50 + 5 * ({key} % 11) AS DOUBLE) / 100"
    return f"SELECT {source} AS source, {target} AS target, {kind} AS kind, {plugin} AS plugin, {confidence} AS confidence, {_SRC.format(k=key)} AS src, CAST({group} AS BIGINT) * 1000000000000 + {order or key} AS ord FROM {table} {where}"


def _id(kind: str, letter: str, key: str) -> str:
    return f"'shop:{kind}:{letter}' || CAST({key} AS STRING)"


EDGES = " UNION ALL ".join(
    (
        _edge("nation", 1, _id("db_table", "n", "n_nationkey"), _id("db_table", "r", "n_regionkey"), "'relates_to'", "n_nationkey", plugin="'sql'"),
        _edge("supplier", 2, _id("backend_function", "s", "s_suppkey"), _id("db_table", "n", "s_nationkey"), "CASE s_suppkey % 3 WHEN 0 THEN 'writes_table' ELSE 'reads_table' END", "s_suppkey", "CASE WHEN s_suppkey % 7 > 0 THEN CAST(50 + 5 * (s_suppkey % 11) AS DOUBLE) / 100 END", plugin="'sql'"),
        _edge("lineitem", 3, _id("backend_endpoint", "p", "l_partkey"), "CASE WHEN l_orderkey % 97 = 0 THEN " + _id("backend_function", "x", "l_suppkey") + " ELSE " + _id("backend_function", "s", "l_suppkey") + " END", "'calls'", "(l_partkey + l_linenumber)", order="l_orderkey * 10 + l_linenumber"),
        _edge("lineitem", 4, _id("frontend_component", "o", "l_orderkey"), _id("backend_endpoint", "p", "l_partkey"), "'uses_api'", "(l_partkey + l_orderkey)", order="l_orderkey * 10 + l_linenumber"),
        _edge("orders", 5, _id("frontend_component", "o", "o_orderkey"), _id("frontend_api_call", "c", "o_custkey"), "CASE o_orderkey % 2 WHEN 0 THEN 'contains' ELSE 'imports' END", "o_orderkey", plugin="'vue'"),
        _edge("customer", 6, _id("frontend_api_call", "c", "c_custkey"), _id("backend_endpoint", "p", "(1 + c_custkey % 150)"), "'calls_api'", "c_custkey", where="WHERE c_custkey % 3 > 0"),
        _edge("customer", 7, _id("frontend_api_call", "c", "c_custkey"), "'shop:business_domain:' || c_mktsegment", "'belongs_to_domain'", "c_custkey", "CAST(9 AS DOUBLE) / 10", plugin="'domains'"),
    )
)

#: Scoped memories: the events, by user.
MEMORIES = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'org' WHEN 1 THEN 'project' WHEN 2 THEN 'team' ELSE 'personal' END AS scope,
 CASE event_id % 4 WHEN 0 THEN 'org' WHEN 1 THEN 'p' || CAST(user_id % 5 AS STRING) WHEN 2 THEN 't' || CAST(user_id % 7 AS STRING) ELSE 'u' || CAST(user_id % 50 AS STRING) END AS scope_ref,
 'o' || CAST(user_id % 3 AS STRING) AS org_id, 'u' || CAST(user_id % 50 AS STRING) AS owner, event_type || ' of user ' || CAST(user_id AS STRING) || ' with ' || props AS content,
 CASE WHEN event_id % 3 > 0 THEN event_type || '-' || CAST(user_id % 40 AS STRING) END AS topic_key, event_id % 29 = 0 AS is_redline,
 CASE WHEN event_id % 31 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN event_id % 11 = 0 THEN 't' || CAST(user_id % 9 AS STRING) END AS task_id, ts AS created_at FROM events"""

#: Calls of tools, with outcome and latency: the events.
USAGE = """SELECT event_id, ts, 'p' || CAST(user_id % 20 AS STRING) AS project_id, event_type AS tool, CASE user_id % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'web' ELSE 'ide' END AS client,
 event_type <> 'error' AS ok, value AS elapsed_ms, CASE WHEN event_id % 17 = 0 THEN 'model-x' WHEN event_id % 2 = 0 THEN 'deepseek-chat' ELSE 'deepseek-v4-pro' END AS model,
 'o' || CAST(user_id % 3 AS STRING) AS org_id, 'u' || CAST(user_id AS STRING) AS user_id, event_id % 400 AS input_tokens, event_id % 90 AS output_tokens, event_id % 250 AS cache_hit_tokens, event_id % 150 AS cache_miss_tokens,
 user_id % 6 AS candidates FROM events"""

#: Symbols of three repositories: the parts. Names are few, files and kinds many.
SYMBOLS = """SELECT 'r' || CAST(p_partkey % 3 AS STRING) AS repo, 'n' || CAST(p_partkey AS STRING) AS id, CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'import' ELSE 'variable' END AS kind,
 CASE WHEN p_partkey % 9 = 0 THEN 'test_' ELSE '' END || replace(p_name, ' ', '_') AS name, p_type || '.' || replace(p_name, ' ', '_') AS qualified_name,
 CASE WHEN p_partkey % 7 = 0 THEN 'src/tests/m' ELSE 'src/m' END || CAST(p_size AS STRING) || CASE WHEN p_partkey % 11 = 0 THEN '_test.py' WHEN p_partkey % 11 = 1 THEN '.spec.ts' ELSE '.py' END AS file_path,
 CASE WHEN p_partkey % 13 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'python' ELSE 'typescript' END END AS language, CAST(p_partkey % 300 + 1 AS INT) AS start_line, CAST(p_partkey % 300 + 1 + p_size AS INT) AS end_line,
 p_type || ' ' || p_brand AS docstring, 'def ' || replace(p_name, ' ', '_') || '(x)' AS signature, p_partkey % 4 = 0 AS is_exported, p_partkey AS ord FROM part"""

#: Calls and imports between symbols of one repository: the lines of orders.
SYMBOL_EDGES = """SELECT l_orderkey * 10 + l_linenumber AS id, 'r' || CAST(l_partkey % 3 AS STRING) AS repo, 'n' || CAST(l_partkey AS STRING) AS source, 'n' || CAST(l_suppkey - l_suppkey % 3 + l_partkey % 3 AS STRING) AS target,
 CASE l_linenumber % 3 WHEN 0 THEN 'imports' ELSE 'calls' END AS kind, CAST(l_linenumber AS INT) AS line FROM lineitem"""

SYMBOL_FILES = f"SELECT repo, file_path AS path, min(language) AS language, count(*) AS node_count FROM ({SYMBOLS}) GROUP BY repo, file_path"

#: A queue of jobs: the orders. Some are pending, some claimed (with leases that end before and after the time 1100), some both; some claims have no owner, some rows are set apart.
QUEUE = """SELECT o_orderkey AS id, 'p' || CAST(o_custkey % 50 AS STRING) AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'codegraph' WHEN 1 THEN 'ingest' ELSE 'chroma' END AS kind,
 CASE WHEN o_orderkey % 3 < 2 THEN CAST(1000 + o_orderkey % 500 AS DOUBLE) END AS pending_at, CASE WHEN o_orderkey % 3 < 2 THEN 'm' || CAST(o_orderkey AS STRING) END AS pending_token,
 CASE WHEN o_orderkey % 4 = 1 THEN 't' || CAST(o_orderkey AS STRING) END AS token, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 5 > 0 THEN 'w' || CAST(o_orderkey % 2 AS STRING) END AS owner,
 CASE WHEN o_orderkey % 4 = 1 THEN CAST(900 + o_orderkey % 150 AS DOUBLE) END AS claimed_at, CASE WHEN o_orderkey % 4 = 1 THEN CAST(1000 + o_orderkey % 170 AS DOUBLE) END AS lease_until,
 o_orderkey % 13 = 0 AS quarantined, CASE WHEN o_orderkey % 13 = 0 THEN 'q' || CAST(o_orderkey % 2 AS STRING) END AS quarantine_id, CAST('ok' AS STRING) AS result,
 CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 9 > 0 THEN chr(123) || '"job":"a' || CAST(o_orderkey AS STRING) || '"' || chr(125) END AS meta, CASE WHEN o_orderkey % 3 < 2 THEN chr(123) || '"job":"b' || CAST(o_orderkey AS STRING) || '"' || chr(125) END AS pending_meta,
 CAST(NULL AS DOUBLE) AS result_at, CAST(NULL AS DOUBLE) AS result_enqueued_at, CAST(NULL AS STRING) AS result_meta FROM orders"""

DERIVED = {
    "queue": QUEUE,
    "nodes": NODES, "edges": EDGES, "memories": MEMORIES, "usage": USAGE, "symbols": SYMBOLS, "symbol_edges": SYMBOL_EDGES, "symbol_files": SYMBOL_FILES,
    # The graph of four projects.
    "store_nodes": f"SELECT 'p' || CAST(ord % 4 AS STRING) AS project_id, * FROM ({NODES})", "store_edges": f"SELECT 'p' || CAST(ord % 4 AS STRING) AS project_id, * FROM ({EDGES})",
}


def with_derived(body: str, *names: str) -> str:
    """SQL over derived tables."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in names) + (", " if body.lstrip().startswith(",") else " ") + body.lstrip().removeprefix(",")


class Tables:
    """Tables of a folder as DataFrames, by name; derived ones too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return self.derived(name)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def derived(self, name: str) -> DataFrame:
        text = DERIVED[name]
        used = {t: getattr(self, t) for t in TABLES if f"FROM {t}" in text}
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(text.replace("{{", "{").replace("}}", "}"), **used)
