"""Plans of retrieval: tokens, BM25, vectors, fusion, name search, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import chunks, html_to_text, is_test, paragraphs, sections, slices
from graphloom.operators.retrieval import TextIndex, bm25, bm25_top, cosine, name_relevance, round_robin, rrf, text_index, tokens, top
from graphloom.operators.shared import spread
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived

_TOK = r"regexp_extract_all(lower({}), '[a-z_][a-z0-9_]*|[0-9]+(?:\.[0-9]+)*')"
_POST = f"l0 AS MATERIALIZED (SELECT doc_id AS doc, {_TOK.format('text')} AS w FROM documents), t AS (SELECT doc, unnest(w) AS term, len(w) AS dl FROM l0), p AS MATERIALIZED (SELECT term, doc, dl, count(*) AS tf FROM t GROUP BY term, doc, dl)"
_Q = f"q AS (SELECT DISTINCT item_id AS q, unnest({_TOK.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0)"
_BM = f"""{_POST}, {_Q}, st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM l0), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.q, p.doc, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM p JOIN q USING (term) JOIN df USING (term), st GROUP BY q.q, p.doc)"""
_COS = """c AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"""
_INDEXES: dict[tuple[str, str], TextIndex] = {}


def index(t: Tables) -> TextIndex:
    """The index of the documents, made once a session and folder."""
    name = (t.spark.sparkContext.applicationId, t.folder)
    if name not in _INDEXES:
        _INDEXES[name] = text_index(t.documents)
    return _INDEXES[name]


def asked(t: Tables) -> DataFrame:
    """The words of the benchmark items whose number is divisible by 100."""
    return t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("q"), F.explode(tokens(F.col("text"))).alias("term")).distinct()


def text_hits(t: Tables, k: int = 30) -> DataFrame:
    scored = bm25_top(index(t), asked(t), k)[0].withColumn("score", F.round("score", 6))
    return top(scored, ["q"], k, F.desc("score"), "doc")


def vector_hits(t: Tables, k: int = 30) -> DataFrame:
    """The vectors whose number is divisible by 100, against all."""
    asks = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return cosine(t.embeddings, asks, k)


@query("scl-01", f"SELECT doc_id, len({_TOK.format('text')}) AS n, array_to_string({_TOK.format('text')}[1:5], ' ') AS head FROM documents")
def tokenizer(t: Tables) -> DataFrame:
    w = tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n"), F.concat_ws(" ", F.slice(w, 1, 5)).alias("head"))


#: Characters in the place of letters, so that names of parts become Chinese text without blanks.
_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "的一是在不了有和人这中大为上个国我以要他时来用们生到"
_PARTS = f"SELECT p_partkey, translate(lower(p_name), '{_LETTERS}', '{_SIGNS}') AS spaced FROM part"


def unspaced(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names of parts as runs of Chinese characters (p_partkey, run), and the dictionary of their words (word, freq)."""
    spaced = spread(t.part.select("p_partkey", "p_name")).select("p_partkey", F.translate(F.lower("p_name"), _LETTERS, _SIGNS).alias("spaced"))
    words = spaced.select(F.explode(F.split("spaced", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return spaced.select("p_partkey", F.replace("spaced", F.lit(" "), F.lit("")).alias("run")), words


@query("scl-01-cjk", f"SELECT p_partkey, replace(spaced, ' ', '|') AS words FROM ({_PARTS})")
def cjk_words(t: Tables) -> DataFrame:
    """The words of names without blanks are found again."""
    from graphloom.operators.segment import segment

    runs, words = unspaced(t)
    told = segment(runs.select("run"), words)
    return runs.join(told, "run").select("p_partkey", F.array_join("words", "|").alias("words"))


@query("ret-02-cjk", f"""WITH sp AS ({_PARTS}), w0 AS (SELECT p_partkey AS doc, unnest(string_split(spaced, ' ')) AS term FROM sp),
w AS (SELECT * FROM w0 UNION ALL SELECT doc, substr(term, CAST(i AS BIGINT), k) FROM (SELECT doc, term, k, unnest(range(1, CAST(length(term) - k + 2 AS BIGINT))) AS i FROM w0, (VALUES (2), (3)) v(k) WHERE length(term) > k) WHERE substr(term, CAST(i AS BIGINT), k) IN (SELECT term FROM w0)), p AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc, sum(tf) AS dl FROM p GROUP BY doc), st AS (SELECT count(*) AS n, sum(dl) / count(*)::DOUBLE AS mean FROM l), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT doc AS q, term FROM p WHERE doc % 100 = 0)
SELECT q, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM q JOIN p USING (term) JOIN l USING (doc) JOIN df USING (term), st GROUP BY q, doc""")
def cjk_search(t: Tables) -> DataFrame:
    """BM25 over Chinese text: the names divisible by 100 against all."""
    from graphloom.operators.segment import cjk_tokens

    runs, words = unspaced(t)
    asks = cjk_tokens(runs.where("p_partkey % 100 = 0"), words, "p_partkey", "run").select(F.col("doc").alias("q"), "term").distinct()
    return bm25(text_index(runs, "p_partkey", "run", words), asks).select("q", "doc", F.round("score", 6).alias("score"))


@query("ret-01", f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term")
def bm25_build(t: Tables) -> DataFrame:
    return index(t).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("ret-02", f"WITH {_BM} SELECT q, doc, round(score, 6) AS score FROM s WHERE score > 0")
def bm25_score(t: Tables) -> DataFrame:
    return bm25(index(t), asked(t)).select("q", "doc", F.round("score", 6).alias("score"))


_TOPN = f"{_BM}, bm AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) - 1 AS rank FROM (SELECT q, doc, round(score, 6) AS score FROM s))"
_TOPV = f"{_COS}, vec AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) - 1 AS rank FROM c)"


@query("top-04", f"WITH {_TOPN} SELECT q, doc, rank FROM bm WHERE rank < 30")
def first_hits(t: Tables) -> DataFrame:
    return text_hits(t).select("q", "doc", "rank")


#: A vector is a chunk of a node: two chunks a node.
_NODE = "CAST(doc // 2 AS STRING)"


@query("ret-08", f"WITH {_TOPV} SELECT q, node, rank FROM (SELECT q, {_NODE} AS node, row_number() OVER (PARTITION BY q ORDER BY min(rank)) - 1 AS rank FROM vec WHERE rank < 90 GROUP BY 1, 2) WHERE rank < 30")
def vector_nodes(t: Tables) -> DataFrame:
    """Three times as many chunks as nodes are asked for; a node is where its best chunk is."""
    from graphloom.operators.recall import code_vectors

    chunk = F.concat_ws("#", F.floor(F.col("vec_id") / 2).cast("string"), (F.col("vec_id") % 2).cast("string"))
    asks = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return code_vectors(t.embeddings.withColumn("chunk_id", chunk), asks, 30)


@query("ret-08-index")
def vector_index_hits(t: Tables) -> DataFrame:
    """The first 30 by the index of vectors, for the vectors whose number is divisible by 100; ret-08 and ret-09 scan all."""
    from graphloom.operators.vectors import nearest, vector_index

    asks = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return nearest(vector_index(t.embeddings), asks, 30)


@query("ret-09", f"WITH {_TOPV} SELECT q, {_NODE} AS node, min(rank) AS best FROM vec WHERE rank < 90 GROUP BY 1, 2")
def chunk_fold(t: Tables) -> DataFrame:
    found = vector_hits(t, 90)
    return found.groupBy("q", F.floor(F.col("doc") / 2).cast("string").alias("node")).agg(F.min("rank").alias("best"))


_LANES = f"{_TOPN}, {_TOPV}, l AS (SELECT q, 'bm25' AS lane, 0 AS pos, doc, rank FROM bm WHERE rank < 30 UNION ALL SELECT q, 'vector', 1, doc, rank FROM vec WHERE rank < 30)"


def lanes(t: Tables) -> DataFrame:
    ref = F.col("doc").cast("long").alias("ref")
    return text_hits(t).select("q", F.lit("bm25").alias("lane"), F.lit(0).alias("at"), ref, "rank").union(vector_hits(t).select("q", F.lit("vector"), F.lit(1), ref, "rank"))


def _fused(weight: str = "1.0::DOUBLE", condition: str = "true", boost: str = "") -> str:
    """CTE w (q, ref, score, seen), and x with rank: of equal scores the ref that a lane names first is first."""
    return f"w AS (SELECT q, doc AS ref, round(sum({weight} / (61 + rank)){boost}, 9) AS score, min((pos, rank)) AS seen FROM l WHERE {condition} GROUP BY q, doc), x AS (SELECT q, ref, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, ref) - 1 AS rank FROM w)"


@query("ret-03", f"WITH {_LANES} SELECT q, doc AS ref, round(sum(1.0::DOUBLE / (61 + rank)), 6) AS score, count(*) AS n_lanes FROM l GROUP BY q, doc")
def fuse(t: Tables) -> DataFrame:
    return rrf(lanes(t)).select("q", "ref", F.round("score", 6).alias("score"), "n_lanes")


_ONE_LANE, _BOOST = "CASE lane WHEN 'vector' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END", " + max(CASE WHEN doc % 5 = 0 THEN 0.01::DOUBLE ELSE 0 END)"


@query("ret-05", f"WITH {_LANES}, {_fused(_ONE_LANE, 'rank < 15', _BOOST)} SELECT q, ref, rank, score FROM x WHERE rank < 25")
def weighted_fuse(t: Tables) -> DataFrame:
    """The first 15 of each lane, one lane of weight 0, and a boost that a ref carries."""
    boost = F.when(F.col("ref") % 5 == 0, 0.01)
    return rrf(lanes(t), {"vector": 0.0, "bm25": 2.0}, limit=25, boost=boost, per_lane=15).select("q", "ref", "rank", "score")


@query("ret-04", f"WITH {_LANES}, {_fused()} SELECT q, ref, rank FROM x WHERE rank < 20")
def list_fuse(t: Tables) -> DataFrame:
    return rrf(lanes(t), limit=20).select("q", "ref", "rank")


@query("ret-06", f"WITH {_LANES}, {_fused()} SELECT q, ref, x.rank, d.source, d.lang FROM x LEFT JOIN documents d ON d.doc_id = x.ref WHERE x.rank < 10")
def document_search(t: Tables) -> DataFrame:
    found = rrf(lanes(t), limit=10)
    return found.join(t.documents.select(F.col("doc_id").alias("ref"), "source", "lang"), "ref", "left").select("q", "ref", "rank", "source", "lang")


@query("win-01", f"WITH {_TOPN} SELECT q, doc, round(1.0::DOUBLE / (61 + rank), 9) AS part FROM bm WHERE rank < 30")
def contributions(t: Tables) -> DataFrame:
    return text_hits(t).select("q", "doc", F.round(1.0 / (61 + F.col("rank")), 9).alias("part"))


@query("win-02", f"WITH {_LANES}, f AS (SELECT q, doc AS ref, min((rank, lane)) AS m FROM l GROUP BY q, doc) SELECT q, ref, row_number() OVER (PARTITION BY q ORDER BY m, ref) - 1 AS place FROM f")
def interleave(t: Tables) -> DataFrame:
    return round_robin(lanes(t), "lane", "rank", "ref", ["q"])


_TERMS = "['steel', 'blue']"


@query("top-02", f"SELECT p_partkey, len(list_filter({_TERMS}, lambda t: contains(lower(p_name), t))) AS matched FROM part WHERE len(list_filter({_TERMS}, lambda t: contains(lower(p_name), t))) > 0")
def relevance(t: Tables) -> DataFrame:
    r = name_relevance(F.lower("p_name"), F.array(F.lit("steel"), F.lit("blue")), F.lit("steel blue"))
    return t.part.select("p_partkey", r.alias("r")).where("r IS NOT NULL").select("p_partkey", (-F.col("r.matched")).alias("matched"))


@query("top-01", with_derived("SELECT id, name FROM (SELECT id, name, kind, ord, CASE WHEN lower(name) = 'as' THEN 2 WHEN starts_with(lower(name), 'as') THEN 1 ELSE 0 END AS w FROM nodes WHERE contains(lower(name), 'as')) ORDER BY w DESC, length(name), kind, name, id LIMIT 50", "nodes"))
def name_search(t: Tables) -> DataFrame:
    """Through the index of grams, over all nodes, those of one id included."""
    from graphloom.operators.names import name_index, names_with

    term = t.spark.range(1).select(F.lit("as").alias("term"))
    held = names_with(name_index(t.nodes), term).select("low", name_relevance(F.col("low"), F.array("term"), F.col("term")).alias("r"))
    return held.join(t.nodes.withColumn("low", F.lower("name")), "low").orderBy("r", "kind", "name", "id").limit(50).select("id", "name")


@query("top-06", with_derived("SELECT repo, file_path, id, row_number() OVER (PARTITION BY repo, file_path ORDER BY CASE WHEN starts_with(lower(name), 'test_') OR contains(file_path, '/tests/') OR file_path LIKE '%\\_test.py' ESCAPE '\\' OR file_path LIKE '%.spec.ts' THEN 1 ELSE 0 END, ord) AS place FROM symbols", "symbols"))
def tests_last(t: Tables) -> DataFrame:
    """In each file, implementations before tests, each in their order."""
    place = F.row_number().over(Window.partitionBy("repo", "file_path").orderBy(is_test(F.col("name"), F.col("file_path")).cast("int"), "ord"))
    return t.symbols.select("repo", "file_path", "id", place.alias("place"))


#: Notes with headings, short and long sections, and a paragraph that is too long: what a chunker meets.
_NOTE = "'# A' || chr(10) || 'note ' || CAST({k} AS STRING) || chr(10) || '## B' || chr(10) || repeat('word ', 40 + CAST({k} % 90 AS INT)) || chr(10) || chr(10) || repeat('more ', 180) || chr(10) || ' ' || chr(10) || repeat('last ', 30) || chr(10) || '#### no heading' || chr(10) || '### C' || chr(10) || repeat('x', 1600 + CAST({k} % 7 AS INT))"


def notes(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.expr(_NOTE.format(k="s_suppkey")).alias("text"))


_NOTES = f"WITH d AS (SELECT s_suppkey, {_NOTE.format(k='s_suppkey')} AS text FROM supplier)"
_B = "'## B' || chr(10) || repeat('word ', 40 + CAST(s_suppkey % 90 AS INT)) || chr(10) || chr(10) || repeat('more ', 180) || chr(10) || ' ' || chr(10) || repeat('last ', 30) || chr(10) || '#### no heading' || chr(10)"
_P1, _P2, _P3 = "'## B' || chr(10) || rtrim(repeat('word ', 40 + CAST(s_suppkey % 90 AS INT)))", "rtrim(repeat('more ', 180))", "repeat('last ', 30) || chr(10) || '#### no heading'"


@query("scl-02", f"{_NOTES} SELECT s_suppkey, 0 AS at, '# A' || chr(10) || 'note ' || CAST(s_suppkey AS STRING) || chr(10) AS section FROM d UNION ALL SELECT s_suppkey, 1, {_B} FROM d UNION ALL SELECT s_suppkey, 2, '### C' || chr(10) || repeat('x', 1600 + CAST(s_suppkey % 7 AS INT)) FROM d")
def heading_split(t: Tables) -> DataFrame:
    return notes(t).select("s_suppkey", F.posexplode(sections(F.col("text"))).alias("at", "section"))


@query("scl-03", f"{_NOTES} SELECT s_suppkey, 0 AS at, '# A' || chr(10) || 'note ' || CAST(s_suppkey AS STRING) || chr(10) || {_P1} AS paragraph FROM d UNION ALL SELECT s_suppkey, 1, {_P2} FROM d UNION ALL SELECT s_suppkey, 2, {_P3} || chr(10) || '### C' || chr(10) || repeat('x', 1600 + CAST(s_suppkey % 7 AS INT)) FROM d")
def paragraph_split(t: Tables) -> DataFrame:
    return notes(t).select("s_suppkey", F.posexplode(paragraphs(F.col("text"))).alias("at", "paragraph"))


@query("scl-04", "SELECT doc_id, i AS at, substr(text, i * 700 + 1, 700) AS piece FROM documents, unnest(range(0, greatest(1, (length(text) + 699) // 700))) AS u(i)")
def hard_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(slices(F.col("text"), 700)).alias("at", "piece"))


@query("scl-05", f"""{_NOTES}, c AS (SELECT s_suppkey, '# A' || chr(10) || 'note ' || CAST(s_suppkey AS STRING) AS a, rtrim({_P1}) AS p1, {_P2} AS p2, {_P3} AS p3, '### C' || chr(10) || repeat('x', 1600 + CAST(s_suppkey % 7 AS INT)) AS x, length({_B}) AS n FROM d)
SELECT s_suppkey, len(cs) AS n, md5(array_to_string(cs, '|')) AS h FROM (SELECT s_suppkey, list_concat([a], CASE WHEN n <= 1500 THEN [rtrim({_B}, chr(10))] WHEN length(p1) + length(p2) + 2 <= 1000 THEN CASE WHEN length(p1) + length(p2) + length(p3) + 4 <= 1000 THEN [p1 || chr(10) || chr(10) || p2 || chr(10) || chr(10) || p3] ELSE [p1 || chr(10) || chr(10) || p2, p3] END WHEN length(p2) + length(p3) + 2 <= 1000 THEN [p1, p2 || chr(10) || chr(10) || p3] ELSE [p1, p2, p3] END, [substr(x, 1, 1500), substr(x, 1501)]) AS cs FROM c)""")
def chunker(t: Tables) -> DataFrame:
    """Sections of up to 1500 characters whole, of longer ones paragraphs up to 1000 together, longer paragraphs cut."""
    made = chunks(notes(t), "s_suppkey", "text").where("chunk IS NOT NULL").groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("c"))
    return made.select("s_suppkey", F.size("c").cast("long").alias("n"), F.md5(F.array_join(F.transform("c", lambda x: x["chunk"]), "|").cast("binary")).alias("h"))


@query("ret-24", None)
def chunk_stream(t: Tables) -> DataFrame:
    return chunks(t.documents, "doc_id", "text")


@query("scl-06", None)
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@query("src-36", "SELECT coalesce(source, 'unknown') AS category, coalesce(lang, 'unknown') AS module, count(*) AS n FROM documents GROUP BY 1, 2")
def collection_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.coalesce("source", F.lit("unknown")).alias("category"), F.coalesce("lang", F.lit("unknown")).alias("module")).agg(F.count("*").alias("n"))


@query("src-37", f"{_NOTES} SELECT pos AS \"at\", section FROM (SELECT s_suppkey, 0 AS pos, '# A' || chr(10) || 'note ' || CAST(s_suppkey AS STRING) || chr(10) AS section FROM d UNION ALL SELECT s_suppkey, 1, {_B} FROM d UNION ALL SELECT s_suppkey, 2, '### C' || chr(10) || repeat('x', 1600 + CAST(s_suppkey % 7 AS INT)) FROM d) WHERE s_suppkey = 3 UNION ALL SELECT -1, 'not found: 1000000000' FROM (SELECT 1) WHERE NOT EXISTS (SELECT 1 FROM d WHERE s_suppkey = 1000000000)")
def chunks_of_file(t: Tables) -> DataFrame:
    """The chunks of a file in their order, and what is said of a file that has none."""
    held = notes(t).select(F.col("s_suppkey").alias("file"), F.posexplode(sections(F.col("text"))).alias("at", "section"))
    asked_for = t.spark.createDataFrame([(3,), (1_000_000_000,)], "file long")
    found = asked_for.join(held, "file", "left").orderBy("file", "at")
    return found.select(F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("section", F.concat(F.lit("not found: "), F.col("file").cast("string"))).alias("section"))


@query("src-14", "SELECT doc_id, sha256(text) AS h FROM documents")
def snapshot_read(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@query("flt-08", "SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en'")
def metadata_where(t: Tables) -> DataFrame:
    return t.documents.where((F.col("source") == "src3") & (F.col("lang") == "en")).select("doc_id")
