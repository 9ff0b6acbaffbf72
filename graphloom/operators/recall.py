"""Fused recall of code: three lanes of ranked refs, fused by reciprocal rank, enriched, and reranked where there is a scorer.

queries: q, text. A lane: q, ref, rank (from 0), name, kind, file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import classify, is_test
from graphloom.operators.names import NameIndex, name_index, names_with
from graphloom.operators.retrieval import cosine, name_relevance, round_robin, rrf, top
from graphloom.operators.shared import by_text, cut, of_texts, small
from graphloom.operators.symbols import fts

# How many a lane brings, how many are returned, how many chunks are asked for a node; weights of lanes by type of query (1 where none is given).
PER_LANE, LIMIT, OVERFETCH, MOST_CHUNKS = 30, 20, 3, 200
LANES = ("graph", "codegraph", "vector")
WEIGHTS = {"symbol": {"codegraph": 2.0}, "impact": {"graph": 2.0}}


def local_ref(repo: Column, ref: Column, main: str = "r0") -> Column:
    """The ref of a symbol: tagged with its repository, unless that is the main one."""
    return F.when(repo == main, ref).otherwise(F.concat_ws("::", repo, ref))


def tests_last(lane: DataFrame, keys: list[str]) -> DataFrame:
    """Implementation before tests, each in the order of rank."""
    return lane.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(is_test(F.col("name"), F.col("file")).cast("int"), "rank")) - 1)


def name_search(nodes: DataFrame, queries: DataFrame, limit: int = 50, index: NameIndex | None = None) -> DataFrame:
    """q, ref, rank, ...: nodes whose name holds a term of the text, by relevance, kind, name and id. Names are found by an index of their grams (made here if none is given)."""
    queries, back = by_text(queries)
    terms = F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda x: x != "")
    asked = queries.select("q", terms.alias("terms")).where(F.size("terms") > 0)
    each = asked.select("q", F.explode(F.array_distinct("terms")).alias("term"))
    held = cut(names_with(index or name_index(nodes), each))
    met = held.join(small(each), "term").select("q", "low").distinct().join(small(asked), "q").select("q", "low", name_relevance(F.col("low"), F.col("terms"), F.array_join("terms", " ")).alias("r"))
    # Nodes of one (lower-cased) name follow one another in a list, by kind, name and id: the first of each are enough.
    named = nodes.select("id", "name", F.lower("name").alias("low"), "kind", "file").join(small(held.select("low").distinct()), "low", "left_semi")
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("low").orderBy("kind", "name", "id"))).where(F.col("nth") <= limit).drop("nth")
    found = met.join(named, "low")
    return of_texts(top(found, ["q"], limit, "r", "kind", "name", "id").select("q", F.col("id").alias("ref"), "rank", "name", "kind", "file"), back)


def graph_lane(nodes: DataFrame, queries: DataFrame, limit: int = PER_LANE, index: NameIndex | None = None) -> DataFrame:
    return tests_last(name_search(nodes, queries, limit, index), ["q"])


def symbol_lane(symbols: DataFrame, queries: DataFrame, limit: int = PER_LANE) -> DataFrame:
    """Any word of the text, in each repository, tests last; the repositories' results are interleaved."""
    queries, back = by_text(queries)
    found = symbols.select("repo", "id", "name", "kind", F.col("file_path").alias("file")).join(small(cut(fts(symbols, queries, "or", limit))), ["repo", "id"])
    lane = cut(tests_last(found.select("q", "repo", local_ref(F.col("repo"), F.col("id")).alias("ref"), "rank", "name", "kind", "file"), ["q", "repo"]))
    found = round_robin(lane, "repo", "rank", "ref", ["q"]).withColumnRenamed("place", "rank").join(lane.drop("rank", "repo"), ["q", "ref"])
    return of_texts(found.select("q", "ref", "rank", "name", "kind", "file"), back)


def fold_chunks(hits: DataFrame, k: int) -> DataFrame:
    """hits: q, chunk_id, rank. q, node, rank: the best chunk of each node, the first k nodes."""
    best = hits.groupBy("q", F.substring_index("chunk_id", "#", 1).alias("node")).agg(F.min("rank").alias("best"))
    return top(best, ["q"], k, "best").drop("best")


def code_vectors(chunks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """chunks: vec_id, embedding, chunk_id; vectors: q, v. q, node, rank."""
    hits = cosine(chunks, vectors, min(max(OVERFETCH * k, k), MOST_CHUNKS))
    return fold_chunks(hits.join(chunks.select(F.col("vec_id").alias("doc"), "chunk_id"), "doc").select("q", "chunk_id", "rank"), k)


def vector_lane(symbols: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int = PER_LANE) -> DataFrame:
    found = code_vectors(chunks, vectors, limit).join(symbols.select(F.col("id").alias("node"), "repo", "name", "kind", F.col("file_path").alias("file")), "node")
    return tests_last(found.select("q", local_ref(F.col("repo"), F.col("node")).alias("ref"), "rank", "name", "kind", "file"), ["q"])


def fuse(lanes: dict[str, DataFrame], queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """q, ref, rank, score, name, kind, file: the lanes in their order, weighted by the type of the query; details are those of the first lane that has the ref, else the ref itself."""
    every = None
    for at, (lane, rows) in enumerate(lanes.items()):
        one = rows.select("q", F.lit(lane).alias("lane"), F.lit(at).alias("at"), "ref", "rank", "name", "kind", "file")
        every = one if every is None else every.union(one)
    kinds = queries.where(F.trim("text") != "").select("q", classify(F.col("text")).alias("type"))
    weight = F.lit(1.0)
    for kind, by_lane in WEIGHTS.items():
        for lane, w in by_lane.items():
            weight = F.when((F.col("type") == kind) & (F.col("lane") == lane), w).otherwise(weight)
    every = every.join(kinds, "q")
    found = rrf(every, weight, limit=limit, per_lane=PER_LANE)
    details = every.groupBy("q", "ref").agg(F.min_by(F.struct("name", "kind", "file"), F.struct("at", "rank")).alias("d"))
    return enrich(found, details.select("q", "ref", "d.*"))


def enrich(found: DataFrame, details: DataFrame) -> DataFrame:
    met = found.join(details, ["q", "ref"], "left")
    return met.select("q", "ref", "rank", "score", F.coalesce("name", "ref").alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), "file")


def rerank(hits: DataFrame, score: Column, head: int | None = None) -> DataFrame:
    """hits: q, ref, rank, ... . The same with a new rank: by falling score, ties in their order; only the first `head` move, if given. A query of which a score is missing or not finite
    keeps its order."""
    moves = F.col("rank") < head if head is not None else F.lit(True)
    # Spark orders NaN above all numbers and finds it equal to itself.
    good = F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") < float("inf"))
    scored = hits.withColumn("_s", F.when(moves, score.cast("double")).otherwise(0.0)).withColumn("_ok", F.min(good).over(Window.partitionBy("q")))
    order = [(~moves).cast("int"), F.when(F.col("_ok") & moves, -F.col("_s")).otherwise(0.0), F.col("rank")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)) - 1).drop("_s", "_ok")


def rerank_texts(hits: DataFrame, symbols: DataFrame, text: Callable[[], Column]) -> DataFrame:
    """hits with the text that a scorer reads: that of the symbol, else the name."""
    hits = cut(hits)
    told = symbols.select(local_ref(F.col("repo"), F.col("id")).alias("ref"), text().alias("text")).join(small(hits.select("ref").distinct()), "ref", "left_semi")
    return hits.join(small(cut(told)), "ref", "left").withColumn("text", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "name", "ref"))


def overlap(text: Column, query: Column) -> Column:
    """A scorer that needs no model: the share of the query's words that the text has."""
    asked = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), 0))
    has = F.filter(asked, lambda w: F.contains(F.lower(text), w))
    return F.size(has) / F.greatest(F.size(asked), F.lit(1))
