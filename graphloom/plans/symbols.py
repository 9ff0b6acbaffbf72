"""Plans over the graph of symbols. Searches ask the names of the parts whose number is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import symbols as ops
from graphloom.operators.shared import by_text, of_texts
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

ASKED = "SELECT p_partkey AS q, p_name AS text FROM part WHERE p_partkey % 100 = 0"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_TEXT = "concat_ws(' ', name, qualified_name, docstring, signature)"


def fts_sql(mode: str, limit: int, condition: str = "true", asked: str = ASKED) -> str:
    """CTE fts (q, repo, id, ord, score, rank)."""
    wanted = "JOIN (SELECT q, count(*) AS wanted FROM term GROUP BY q) USING (q) WHERE matched = wanted" if mode == "and" else ""
    return f""", ask AS ({asked}), sw AS MATERIALIZED (SELECT repo, id, ord, kind, language, {_WORDS.format(_TEXT)} AS w FROM symbols), term AS (SELECT DISTINCT q, unnest({_WORDS.format("text")}) AS term FROM ask),
post AS (SELECT repo, id, ord, kind, language, len(w) AS dl, unnest(w) AS word FROM sw), rs AS (SELECT repo, count(*) AS n, avg(len(w)) AS avgdl FROM sw GROUP BY repo),
hit AS MATERIALIZED (SELECT repo, id, ord, kind, language, dl, t.term, count(*) AS tf FROM post JOIN (SELECT DISTINCT term FROM term) t ON starts_with(word, t.term) GROUP BY ALL), fdf AS (SELECT repo, term, count(*) AS df FROM hit GROUP BY ALL),
sc AS (SELECT q, repo, id, ord, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score, count(*) AS matched FROM hit JOIN fdf USING (repo, term) JOIN rs USING (repo) JOIN term USING (term) WHERE {condition} GROUP BY ALL),
fts AS (SELECT q, repo, id, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q, repo ORDER BY score DESC, ord) - 1 AS rank FROM (SELECT sc.* FROM sc {wanted})) WHERE rank < {limit})"""


def asked(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("text"))


def names(t: Tables) -> DataFrame:
    """Full names; only what follows the dot is the name of a symbol."""
    return asked(t).select("q", F.concat(F.lit("Any."), F.replace("text", F.lit(" "), F.lit("_"))).alias("name"))


@query("src-09", with_derived("SELECT repo, id FROM symbols WHERE kind IN ('function', 'method')", "symbols"))
def symbol_scan(t: Tables) -> DataFrame:
    return t.symbols.where(ops.in_list(F.col("kind"), ["function", " method ", " "])).select("repo", "id")


@query("src-10", with_derived("SELECT id, name, is_exported FROM symbols WHERE id = 'n7'", "symbols"))
def symbol_lookup(t: Tables) -> DataFrame:
    return t.symbols.where("id = 'n7'").limit(1).select("id", "name", "is_exported")


@query("src-11", with_derived("SELECT repo, path, language, node_count FROM symbol_files WHERE starts_with(path, 'src/m1') ORDER BY path, repo LIMIT 5000", "symbol_files"))
def file_listing(t: Tables) -> DataFrame:
    return t.symbol_files.where(F.startswith("path", F.lit("src/m1"))).orderBy("path", "repo").limit(5000)


@query("flt-11", with_derived("SELECT id FROM symbols WHERE language IN ('python')", "symbols"))
def in_list(t: Tables) -> DataFrame:
    return t.symbols.where(ops.in_list(F.col("language"), ["python", "", "  "]) & ops.in_list(F.col("kind"), [" "])).select("id")


_STATS = "SELECT {r} 'files' AS what, CAST(NULL AS STRING) AS key, count(*) AS n FROM symbol_files {g} UNION ALL SELECT {r} 'nodes', NULL, count(*) FROM symbols {g} UNION ALL SELECT {r} 'edges', NULL, count(*) FROM symbol_edges {g} UNION ALL SELECT {r} 'language', language, count(*) FROM symbols WHERE language IS NOT NULL GROUP BY {r} language UNION ALL SELECT {r} 'kind', kind, count(*) FROM symbols GROUP BY {r} kind UNION ALL SELECT {r} 'edge_kind', kind, count(*) FROM symbol_edges GROUP BY {r} kind"


def _stats(t: Tables) -> DataFrame:
    """Counts of each repository: of files, nodes and edges, and by language, kind and kind of edge."""
    count = lambda df, what, key: df.groupBy("repo", F.lit(what).alias("what"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))
    none = F.lit(None)
    every = count(t.symbol_files, "files", none), count(t.symbols, "nodes", none), count(t.symbol_edges, "edges", none), count(t.symbols.where("language IS NOT NULL"), "language", F.col("language")), count(t.symbols, "kind", F.col("kind")), count(t.symbol_edges, "edge_kind", F.col("kind"))
    out = every[0]
    for x in every[1:]:
        out = out.union(x)
    return out


@query("agg-01", with_derived(f"SELECT * FROM ({_STATS.format(r='repo,', g='GROUP BY repo')}) WHERE repo = 'r1'", "symbols", "symbol_edges", "symbol_files"))
def symbol_stats(t: Tables) -> DataFrame:
    return _stats(t).where("repo = 'r1'")


@query("agg-02", with_derived(_STATS.format(r="", g=""), "symbols", "symbol_edges", "symbol_files"))
def fan_out_stats(t: Tables) -> DataFrame:
    """The counts of the repositories, added up."""
    return _stats(t).groupBy("what", "key").agg(F.sum("n").alias("n"))


@query("jn-09", with_derived(fts_sql("and", 30, "kind IN ('class', 'function') AND language = 'python'") + " SELECT q, repo, id, score, rank FROM fts", "symbols"))
def full_text(t: Tables) -> DataFrame:
    return ops.fts(t.symbols, asked(t), "and", 30, ["class", "function"], ["python"]).select("q", "repo", "id", "score", "rank")


@query("jn-33", with_derived(fts_sql("or", 30) + " SELECT q, ref, place FROM (SELECT q, CASE repo WHEN 'r0' THEN id ELSE repo || '::' || id END AS ref, row_number() OVER (PARTITION BY q ORDER BY repo, rank) AS place FROM fts) WHERE place <= 50", "symbols"))
def fan_out_search(t: Tables) -> DataFrame:
    """The results of the repositories one after another, not ranked anew; the first 50."""
    ref = F.when(F.col("repo") == "r0", F.col("id")).otherwise(F.concat_ws("::", "repo", "id"))
    queries, back = by_text(asked(t))
    found = ops.fts(t.symbols, queries, "or", 30)
    return of_texts(found.select("q", ref.alias("ref"), F.row_number().over(Window.partitionBy("q").orderBy("repo", "rank")).alias("place")).where("place <= 50"), back)


_KIND = "CASE WHEN kind IN ('class', 'function', 'method', 'interface') THEN 0 ELSE 5 END"
#: A word that begins no symbol's word: the names are searched for it.
SEARCHED = "SELECT p_partkey AS q, CASE WHEN p_partkey % 200 = 0 THEN p_name ELSE substr(p_name, 2, 3) END AS text FROM part WHERE p_partkey % 100 = 0"


@query("top-05", with_derived(fts_sql("or", 20, "true", SEARCHED) + f""", tok AS (SELECT q, {_WORDS.format("text")} AS tokens FROM ask), mis AS (SELECT q, tokens, tokens[-1] AS last, r.repo FROM tok, (SELECT DISTINCT repo FROM symbols) r WHERE (q, r.repo) NOT IN (SELECT (q, repo) FROM fts)),
lk AS (SELECT q, repo, id FROM (SELECT m.q, m.repo, s.id, row_number() OVER (PARTITION BY m.q, m.repo ORDER BY s.ord) AS rn FROM mis m JOIN symbols s ON s.repo = m.repo AND contains(lower(s.name), m.last)) WHERE rn <= 20),
al AS (SELECT f.q, s.*, tokens FROM (SELECT q, repo, id FROM fts UNION ALL SELECT * FROM lk) f JOIN symbols s USING (repo, id) JOIN tok USING (q))
SELECT q, repo, id, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN list_contains(tokens, lower(name)) THEN 0 ELSE 1 END, CASE WHEN len(list_filter(tokens, lambda x: contains(lower(name), x))) > 0 THEN 0 ELSE 1 END, {_KIND}, CASE repo WHEN 'r0' THEN 0 ELSE 1 END, ord) AS place FROM al) WHERE place <= 20""", "symbols"))
def symbol_search(t: Tables) -> DataFrame:
    text = F.when(F.col("q") % 200 == 0, F.col("text")).otherwise(F.substring("text", 2, 3))
    return ops.symbol_search(t.symbols, asked(t).select("q", text.alias("text")))


_IDS = ", ask AS (SELECT p_partkey AS q, replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 100 = 0), ids AS (SELECT q, repo, id FROM (SELECT q, repo, s.id, row_number() OVER (PARTITION BY q, repo ORDER BY s.ord) AS rn FROM ask JOIN symbols s USING (name)) WHERE rn <= 5)"


@query("jn-10", with_derived(_IDS + """, m AS (SELECT i.q, i.repo, e.source AS id, e.kind AS edge, e.id AS eid, row_number() OVER (PARTITION BY i.q, i.repo ORDER BY e.id) AS rn FROM ids i JOIN symbol_edges e ON e.repo = i.repo AND e.target = i.id JOIN symbols s ON s.repo = e.repo AND s.id = e.source)
SELECT q, repo, id, edge, eid FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY repo, eid) AS r2 FROM m WHERE rn <= 20) WHERE r2 <= 20""", "symbols", "symbol_edges"))
def callers(t: Tables) -> DataFrame:
    return ops.relations(t.symbols, t.symbol_edges, names(t), True)


def _trace_sql(hops: int) -> str:
    out = [_IDS, ", t0 AS (SELECT q, repo, id FROM ids)"]
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT q, repo, id FROM t{i}" for i in range(k))
        out.append(f", m{k} AS MATERIALIZED (SELECT * FROM (SELECT p.q, p.repo, e.target AS id, e.kind AS edge, e.id AS eid, row_number() OVER (PARTITION BY p.q, p.repo ORDER BY e.id) AS rn FROM t{k - 1} p JOIN symbol_edges e ON e.repo = p.repo AND e.source = p.id JOIN symbols s ON s.repo = e.repo AND s.id = e.target) WHERE rn <= 20)")
        out.append(f", t{k} AS MATERIALIZED (SELECT q, repo, id, {k} AS hop, arg_min(edge, eid) AS edge FROM m{k} WHERE (q, repo, id) NOT IN ({seen.replace('q, repo, id', '(q, repo, id)')}) GROUP BY q, repo, id)")
    return "".join(out) + " " + " UNION ALL ".join(f"SELECT q, repo, hop, id, edge FROM t{k}" for k in range(1, hops + 1))


@query("grf-04", with_derived(_trace_sql(3), "symbols", "symbol_edges"))
def multi_hop_trace(t: Tables) -> DataFrame:
    return ops.trace(t.symbols, t.symbol_edges, names(t), False, 3)


def _densest_sql(nodes: int) -> str:
    return f""", d AS (SELECT repo, x, count(*) AS d FROM (SELECT repo, source AS x FROM symbol_edges UNION ALL SELECT repo, target FROM symbol_edges) GROUP BY ALL),
f AS MATERIALIZED (SELECT * FROM (SELECT e.repo, e.id, e.source, e.target, row_number() OVER (PARTITION BY e.repo ORDER BY CASE e.kind WHEN 'calls' THEN 0 ELSE 1 END, a.d + b.d DESC, e.id) AS rn FROM symbol_edges e JOIN d a ON a.repo = e.repo AND a.x = e.source JOIN d b ON b.repo = e.repo AND b.x = e.target) WHERE rn <= {3 * nodes}),
g AS (WITH RECURSIVE r AS (SELECT repo, 0 AS rn, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT repo FROM symbol_edges)
 UNION ALL SELECT f.repo, f.rn, CASE WHEN len(list_distinct(held || [source, target])) <= {nodes} THEN list_distinct(held || [source, target]) ELSE held END, CASE WHEN len(list_distinct(held || [source, target])) <= {nodes} OR (list_contains(held, source) AND list_contains(held, target)) THEN f.id END FROM r JOIN f ON f.repo = r.repo AND f.rn = r.rn + 1) SELECT repo, id FROM r WHERE id IS NOT NULL)"""


@query("top-09", with_derived(_densest_sql(30) + " SELECT id FROM g WHERE repo = 'r1'", "symbol_edges"))
def densest_subgraph(t: Tables) -> DataFrame:
    return ops.densest(t.symbol_edges.where("repo = 'r1'"), 30).select("id")


@query("top-10", with_derived(_densest_sql(17) + " SELECT repo, id FROM g", "symbol_edges"))
def fan_out_graph(t: Tables) -> DataFrame:
    """50 nodes, dealt to three repositories."""
    return ops.densest(t.symbol_edges, -(-50 // 3))


@query("scl-23", "SELECT p_partkey, '\"' || replace(p_name, ' ', '\"* \"') || '\"*' AS every, '\"' || replace(p_name, ' ', '\"* OR \"') || '\"*' AS any FROM part")
def prefix_queries(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")))
    return t.part.select("p_partkey", ops.prefix_query(text).alias("every"), ops.prefix_query(text, "or").alias("any"))
