"""Plans of fused code recall: lanes, fusion, enrichment, reranking. Asked are the parts whose number is divisible by 100, some with words that tell a type of query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.kinds import is_soft_node
from graphloom.functions.text import TYPES, classify
from graphloom.operators import recall as ops
from graphloom.operators.cleanse import dedup_nodes
from graphloom.operators.names import name_index
from graphloom.operators.shared import cut, small
from graphloom.plans.graph import GRAPH
from graphloom.plans.registry import query
from graphloom.plans.symbols import fts_sql
from graphloom.sources.tables import Tables, with_derived

ASKED = "SELECT p_partkey AS q, p_name || CASE (p_partkey // 100) % 3 WHEN 0 THEN '' WHEN 1 THEN ' definition' ELSE ' impact' END AS text FROM part WHERE p_partkey % 100 = 0"
_TEST = "(starts_with(lower(coalesce(name, '')), 'test_') OR starts_with(lower(coalesce(file, '')), 'tests/') OR contains(lower(coalesce(file, '')), '/tests/') OR contains(lower(coalesce(file, '')), '/test/') OR ends_with(lower(coalesce(file, '')), '_test.py') OR ends_with(lower(coalesce(file, '')), '.test.ts') OR ends_with(lower(coalesce(file, '')), '.spec.ts'))"
_REF = "CASE repo WHEN 'r0' THEN {id} ELSE repo || '::' || {id} END"


def asked(t: Tables) -> DataFrame:
    tail = F.element_at(F.array(F.lit(""), F.lit(" definition"), F.lit(" impact")), (F.floor(F.col("p_partkey") / 100) % 3 + 1).cast("int"))
    return t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("q"), F.concat("p_name", tail).alias("text"))


def hard_nodes(t: Tables) -> DataFrame:
    """Nodes as prepared() has them, with what a lane shows: not written, as a search needs few of them."""
    return dedup_nodes(t.nodes.where(~is_soft_node(F.col("kind"))).select("id", "kind", "name", "file", "ord"))


def graph(t: Tables, q: DataFrame) -> DataFrame:
    """The graph's lane. Names are those of all hard nodes; what only a duplicate is named finds nothing in the nodes."""
    return ops.graph_lane(hard_nodes(t), q, index=name_index(t.nodes.where(~is_soft_node(F.col("kind")))))


def embedded(t: Tables) -> DataFrame:
    """The vectors of the asked texts: those that were made before, as no model is at hand."""
    return asked(t).select("q").join(t.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), "q").select("q", "v")



def chunks(t: Tables) -> DataFrame:
    """Two chunks a symbol."""
    chunk = F.concat(F.lit("n"), F.floor(F.col("vec_id") / 2).cast("string"), F.lit("#"), (F.col("vec_id") % 2).cast("string"))
    return t.embeddings.select("vec_id", "embedding", chunk.alias("chunk_id"))


#: CTE g (q, ref, rank, name, kind, file): the graph's lane.
_GRAPH = f""", gt AS (SELECT q, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS terms FROM ask), gm AS (SELECT q, n.id, n.name, n.kind, n.file, lower(n.name) AS low, terms, array_to_string(terms, ' ') AS whole FROM n JOIN gt ON len(list_filter(terms, lambda x: contains(lower(n.name), x))) > 0),
gk AS (SELECT *, len(list_filter(terms, lambda x: contains(low, x))) AS m, list_sum([CASE WHEN low = x THEN 3 WHEN starts_with(low, x) THEN 2 WHEN contains(low, x) THEN 1 ELSE 0 END FOR x IN terms]) AS ql, CASE WHEN low = whole THEN 2 WHEN starts_with(low, whole) THEN 1 ELSE 0 END AS wh FROM gm),
gr AS (SELECT q, id AS ref, name, kind, file, row_number() OVER (PARTITION BY q ORDER BY m DESC, wh DESC, ql DESC, length(low), kind, name, id) - 1 AS rk FROM gk),
g AS (SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN {_TEST} THEN 1 ELSE 0 END, rk) - 1 AS rank, name, kind, file FROM gr WHERE rk < 30)"""
#: CTE c: the lane of symbols.
_SYMBOL = f""", cs AS (SELECT f.q, f.repo, {_REF.format(id='f.id')} AS ref, f.rank AS rk, s.name, s.kind, s.file_path AS file FROM (SELECT q, repo, id, rank FROM fts) f JOIN symbols s USING (repo, id)), cr AS (SELECT *, row_number() OVER (PARTITION BY q, repo ORDER BY CASE WHEN {_TEST} THEN 1 ELSE 0 END, rk) - 1 AS r2 FROM cs),
c AS (SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY r2, repo, ref) - 1 AS rank, name, kind, file FROM cr)"""
#: CTE v: the lane of vectors.
_VECTOR = f""", vs AS (SELECT a.q, b.vec_id, row_number() OVER (PARTITION BY a.q ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) - 1 AS rk FROM ask a JOIN embeddings e ON e.vec_id = a.q, embeddings b), vn AS (SELECT q, node, row_number() OVER (PARTITION BY q ORDER BY best) - 1 AS rk FROM (SELECT q, 'n' || CAST(vec_id // 2 AS STRING) AS node, min(rk) AS best FROM vs WHERE rk < 90 GROUP BY 1, 2)),
vj AS (SELECT q, {_REF.format(id='s.id')} AS ref, rk, s.name, s.kind, s.file_path AS file FROM vn JOIN symbols s ON s.id = vn.node WHERE rk < 30), v AS (SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN {_TEST} THEN 1 ELSE 0 END, rk) - 1 AS rank, name, kind, file FROM vj)"""


def _type_sql(text: str) -> str:
    counts = {k: " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) for k, words in TYPES.items()}
    best = f"greatest({', '.join(counts.values())})"
    return "CASE WHEN " + best + " = 0 THEN 'general' " + " ".join(f"WHEN {c} = {best} THEN '{k}'" for k, c in counts.items()) + " END"


_TYPE = f", ty AS (SELECT q, {_type_sql('lower(text)')} AS type FROM ask)"
_FUSED = f"""{fts_sql("or", 30, "true", ASKED)}{GRAPH}{_GRAPH}{_SYMBOL}{_VECTOR}{_TYPE}, l AS (SELECT 'graph' AS lane, 0 AS pos, * FROM g UNION ALL SELECT 'codegraph', 1, * FROM c UNION ALL SELECT 'vector', 2, * FROM v),
fs AS (SELECT q, ref, round(sum(CASE WHEN type = 'symbol' AND lane = 'codegraph' THEN 2.0::DOUBLE WHEN type = 'impact' AND lane = 'graph' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (61 + rank)), 9) AS score, min((pos, rank)) AS seen FROM l JOIN ty USING (q) WHERE rank < 30 GROUP BY q, ref),
fu AS (SELECT q, ref, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, ref) - 1 AS rank FROM fs), dt AS (SELECT q, ref, arg_min(name, (pos, rank)) AS name, arg_min(kind, (pos, rank)) AS kind, arg_min(file, (pos, rank)) AS file FROM l GROUP BY q, ref),
fd AS (SELECT q, ref, rank, score, coalesce(name, ref) AS name, coalesce(kind, '') AS kind, file FROM fu LEFT JOIN dt USING (q, ref) WHERE rank < 20)"""
_ASK = f", ask AS ({ASKED})"


@query("ret-07", "SELECT vec_id AS q, len(embedding) AS width FROM embeddings WHERE vec_id % 100 = 0 AND vec_id IN (SELECT p_partkey FROM part)")
def query_vectors(t: Tables) -> DataFrame:
    return embedded(t).select("q", F.size("v").cast("long").alias("width"))


@query("ret-11", with_derived(f"{_ASK}{GRAPH}{_GRAPH} SELECT * FROM g", "nodes", "edges"))
def graph_lane(t: Tables) -> DataFrame:
    return graph(t, asked(t))


@query("ret-12", with_derived(f"{fts_sql('or', 30, 'true', ASKED)}{_SYMBOL} SELECT * FROM c", "symbols"))
def symbol_lane(t: Tables) -> DataFrame:
    return ops.symbol_lane(t.symbols, asked(t))


@query("ret-13", with_derived(f"{_ASK}{_VECTOR} SELECT * FROM v", "symbols"))
def vector_lane(t: Tables) -> DataFrame:
    return ops.vector_lane(t.symbols, chunks(t), embedded(t))


def fused(t: Tables) -> DataFrame:
    q = asked(t)
    return ops.fuse({"graph": graph(t, q), "codegraph": ops.symbol_lane(t.symbols, q), "vector": ops.vector_lane(t.symbols, chunks(t), embedded(t))}, q)


@query("ret-14", with_derived(_FUSED + " SELECT q, ref, rank, score, name, kind, file FROM fd", "symbols", "nodes", "edges"))
def recall_code(t: Tables) -> DataFrame:
    return fused(t)


_DETAILS = "SELECT q, ref, name, kind, file FROM (SELECT *, row_number() OVER (PARTITION BY q, ref ORDER BY pos, rank) AS rn FROM (SELECT 0 AS pos, * FROM c UNION ALL SELECT 1, * FROM v)) WHERE rn = 1 AND substr(ref, -1) <> '3'"


@query("jn-21", with_derived(f"{fts_sql('or', 30, 'true', ASKED)}{_SYMBOL}{_VECTOR}, d AS ({_DETAILS}) SELECT c.q, c.ref, c.rank, coalesce(d.name, c.ref) AS name, coalesce(d.kind, '') AS kind, d.file FROM c LEFT JOIN d ON d.q = c.q AND d.ref = c.ref WHERE c.rank < 20", "symbols"))
def hit_enrichment(t: Tables) -> DataFrame:
    """Details come from the first lane that knows a ref; some refs are made unknown."""
    lane = ops.symbol_lane(t.symbols, asked(t))
    known = lane.withColumn("at", F.lit(0)).union(ops.vector_lane(t.symbols, chunks(t), embedded(t)).withColumn("at", F.lit(1)))
    details = known.groupBy("q", "ref").agg(F.min_by(F.struct("name", "kind", "file"), F.struct("at", "rank")).alias("d")).select("q", "ref", "d.*").where(~F.endswith("ref", F.lit("3")))
    found = lane.where("rank < 20").select("q", "ref", "rank", F.lit(0.0).alias("score"))
    return ops.enrich(found, details).drop("score")


_EMBED = "concat_ws(chr(10), nullif(name, ''), nullif(qualified_name, ''), nullif(substr(signature, 1, 600), ''), nullif(substr(docstring, 1, 1200), ''))"
_TOLD = f", told AS (SELECT {_REF.format(id='id')} AS ref, {_EMBED} AS text FROM symbols)"
_RERANK = f"""{_TOLD}, rt AS (SELECT fd.*, coalesce(nullif(trim(told.text), ''), fd.name, fd.ref) AS text FROM fd LEFT JOIN told USING (ref)), rq AS (SELECT q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM ask),
rz AS (SELECT rt.*, len(list_filter(w, lambda x: contains(lower(text), x)))::DOUBLE / greatest(len(w), 1) AS s FROM rt JOIN rq USING (q))"""


def embed_text():
    """What a symbol is told as: name, qualified name, signature and description, both cut, one a line."""
    some = lambda c, n: F.nullif(F.substring(F.col(c), 1, n), F.lit(""))
    return F.concat_ws("\n", F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("qualified_name"), F.lit("")), some("signature", 600), some("docstring", 1200))


def told(t: Tables) -> DataFrame:
    return ops.rerank_texts(fused(t), t.symbols, embed_text).join(asked(t).withColumnRenamed("text", "query"), "q")


@query("jn-22", with_derived(f"{_FUSED}{_RERANK} SELECT q, ref, text FROM rt", "symbols", "nodes", "edges"))
def rerank_texts(t: Tables) -> DataFrame:
    return ops.rerank_texts(fused(t), t.symbols, embed_text).select("q", "ref", "text")


@query("ret-10", with_derived(f"{_FUSED}{_RERANK} SELECT q, ref, s AS score FROM rz", "symbols", "nodes", "edges"))
def rerank_scores(t: Tables) -> DataFrame:
    """A scorer of texts in the place of a cross-encoder."""
    return told(t).select("q", "ref", ops.overlap(F.col("text"), F.col("query")).alias("score"))


@query("top-07", with_derived(f"{_FUSED}{_RERANK}, bad AS (SELECT q FROM rz WHERE q % 300 = 0 GROUP BY q) SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN q IN (SELECT q FROM bad) THEN 0 ELSE -s END, rank) - 1 AS rank FROM rz", "symbols", "nodes", "edges"))
def rerank_order(t: Tables) -> DataFrame:
    """Some queries have a score that is not a number: they keep their order."""
    s = ops.overlap(F.col("text"), F.col("query"))
    broken = F.when((F.col("q") % 300 == 0) & (F.col("rank") == 1), F.lit(float("nan"))).when((F.col("q") % 300 == 0) & (F.col("rank") == 0), F.lit(None)).otherwise(s)
    return ops.rerank(told(t), broken).select("q", "ref", "rank")


@query("top-15", with_derived(f"{_FUSED}{_RERANK} SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN rank < 5 THEN 0 ELSE 1 END, CASE WHEN rank < 5 THEN -s ELSE 0 END, rank) - 1 AS rank FROM rz", "symbols", "nodes", "edges"))
def rerank_head(t: Tables) -> DataFrame:
    return ops.rerank(told(t), ops.overlap(F.col("text"), F.col("query")), head=5).select("q", "ref", "rank")


@query("ret-15", with_derived(f"{_FUSED}{_RERANK} SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY -s, rank) - 1 AS rank FROM rz", "symbols", "nodes", "edges"))
def optional_rerank(t: Tables) -> DataFrame:
    """With a scorer; without one the hits are those of ret-14."""
    return ops.rerank(told(t), ops.overlap(F.col("text"), F.col("query"))).select("q", "ref", "rank")


@query("jn-20", with_derived(f"{_ASK}{_VECTOR} SELECT q, ref, rank FROM v WHERE ref IN (SELECT {_REF.format(id='id')} FROM symbols WHERE kind = 'function')", "symbols"))
def vector_pool(t: Tables) -> DataFrame:
    """What an index finds, of a pool of candidates only; ranks stay."""
    pool = t.symbols.where("kind = 'function'").select(ops.local_ref(F.col("repo"), F.col("id")).alias("ref"))
    return ops.vector_lane(t.symbols, chunks(t), embedded(t)).join(pool, "ref", "left_semi").select("q", "ref", "rank")


@query("scl-32", f"WITH ask AS (SELECT event_id AS q, event_type || CASE event_id % 6 WHEN 0 THEN ' impact of this definition, who calls it' WHEN 1 THEN ' 函数 where is' WHEN 2 THEN ' best practice rule' WHEN 3 THEN ' what is this, 整体' WHEN 4 THEN ' Impact design' ELSE '' END AS text FROM events){_TYPE} SELECT q AS event_id, type FROM ty")
def query_types(t: Tables) -> DataFrame:
    tails = (" impact of this definition, who calls it", " 函数 where is", " best practice rule", " what is this, 整体", " Impact design", "")
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", classify(F.concat("event_type", tail)).alias("type"))


@query("scl-33", f"WITH ask AS ({ASKED}){_TYPE} SELECT q, lane, CASE WHEN type = 'symbol' AND lane = 'codegraph' OR type = 'impact' AND lane = 'graph' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ty, (SELECT unnest(['graph', 'codegraph', 'vector']) AS lane)")
def lane_weights(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([(k, lane, float(ops.WEIGHTS.get(k, {}).get(lane, 1.0))) for k in (*TYPES, "general") for lane in ops.LANES], "type string, lane string, weight double")
    return asked(t).select("q", classify(F.col("text")).alias("type")).join(F.broadcast(table), "type").select("q", "lane", "weight")


# How many tool calls a type of query may take (0: as many as there are), and the tools it takes first.
BUDGETS = {"overview": 5, "impact": 8, "symbol": 6, "doc_rule": 4, "general": 0}
TOOLS = {
    "overview": ("code_recall", "list_dir", "search_docs", "read_file"),
    "impact": ("impact_analysis", "impact_paths", "table_usage", "api_callers", "page_dependencies", "codegraph_trace", "codegraph_callers", "code_recall"),
    "symbol": ("code_recall", "codegraph_search", "codegraph_trace", "codegraph_callers", "codegraph_callees", "read_file"),
    "doc_rule": ("search_docs", "read_file"),
    "general": ("code_recall",),
}


@query("scl-34", f"WITH ask AS (SELECT event_id AS q, event_type || CASE event_id % 3 WHEN 0 THEN ' impact' WHEN 1 THEN ' signature' ELSE '' END AS text FROM events){_TYPE} SELECT q AS event_id, CASE type WHEN 'impact' THEN 7 WHEN 'symbol' THEN 6 ELSE 7 END AS budget, CASE type WHEN 'impact' THEN 'impact_paths,code_recall' WHEN 'symbol' THEN 'code_recall,read_file' ELSE 'code_recall' END AS tools FROM ty")
def query_plan(t: Tables) -> DataFrame:
    """At most seven steps, of the tools that are there."""
    most, there = 7, ("read_file", "code_recall", "impact_paths")
    plans = [(k, most if not b else min(b, most), ",".join(x for x in TOOLS[k] if x in there)) for k, b in BUDGETS.items()]
    table = t.spark.createDataFrame(plans, "type string, budget int, tools string")
    tail = F.element_at(F.array(F.lit(" impact"), F.lit(" signature"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", classify(F.concat("event_type", tail)).alias("type")).join(F.broadcast(table), "type").select("event_id", "budget", "tools")


@query("scl-20", with_derived(f"SELECT id, {_EMBED} AS text FROM symbols", "symbols"))
def embed_texts(t: Tables) -> DataFrame:
    return t.symbols.select("id", embed_text().alias("text"))


@query("agg-50", with_derived(f"""{_FUSED}, uf AS (SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY round(sum(1.0::DOUBLE / (61 + rank)), 9) DESC, min((pos, rank)), ref) - 1 AS rank FROM l WHERE rank < 30 GROUP BY q, ref),
good AS (SELECT a.q, {_REF.format(id='s.id')} AS ref FROM ask a JOIN part p ON p.p_partkey = a.q JOIN symbols s ON s.name = replace(p.p_name, ' ', '_') UNION SELECT a.q, n.id FROM ask a JOIN part p ON p.p_partkey = a.q JOIN n ON n.name = p.p_name WHERE n.kind = 'backend_endpoint'),
a AS (SELECT q, coalesce(max(1.0::DOUBLE / (rank + 1)), 0) AS rr FROM fd JOIN good USING (q, ref) GROUP BY q), b AS (SELECT q, coalesce(max(1.0::DOUBLE / (rank + 1)), 0) AS rr FROM uf JOIN good USING (q, ref) WHERE rank < 20 GROUP BY q)
SELECT ask.q, round(coalesce(a.rr, 0) - coalesce(b.rr, 0), 6) AS delta FROM ask LEFT JOIN a USING (q) LEFT JOIN b USING (q)""", "symbols", "nodes", "edges"))
def recall_ab(t: Tables) -> DataFrame:
    """The reciprocal rank of the first good ref, by weights of the query's type less by equal weights, query by query."""
    q = asked(t)
    lanes = {"graph": graph(t, q), "codegraph": ops.symbol_lane(t.symbols, q), "vector": ops.vector_lane(t.symbols, chunks(t), embedded(t))}
    plain = q.select("q", F.lit("equal").alias("text"))
    found = {c: cut(ops.fuse(lanes, by).select("q", "ref", "rank")) for c, by in (("a", q), ("b", plain))}
    name = t.part.select(F.col("p_partkey").alias("q"), "p_name").join(small(q.select("q")), "q")
    # What is good for a query is told from the names of the refs that are found, as many symbols have the name that is asked.
    refs = cut(found["a"].select("ref").union(found["b"].select("ref")).distinct())
    symbols = t.symbols.select(ops.local_ref(F.col("repo"), F.col("id")).alias("ref"), "name").join(small(refs), "ref", "left_semi").select("ref", "name", F.lit(True).alias("symbol"))
    soft = is_soft_node(F.col("kind"))
    ends = dedup_nodes(t.nodes.where(~soft).join(small(refs.withColumnRenamed("ref", "id")), "id", "left_semi")).where("kind = 'backend_endpoint'").select(F.col("id").alias("ref"), "name", F.lit(False).alias("symbol"))
    named = small(cut(symbols.union(ends).distinct()))
    fits = F.col("name") == F.when(F.col("symbol"), F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    rr = lambda c: found[c].join(named, "ref").join(name, "q").where(fits).groupBy("q").agg(F.max(1 / (F.col("rank") + 1)).alias(c))
    both = q.select("q").join(rr("a"), "q", "left").join(rr("b"), "q", "left")
    return both.select("q", F.round(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 6).alias("delta"))
