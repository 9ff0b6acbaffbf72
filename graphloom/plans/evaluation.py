"""Plans that judge rankings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import CUTS, bootstrap, judged
from graphloom.plans.registry import query
from graphloom.plans.retrieval import _TOPN, asked, index, text_hits
from graphloom.sources.tables import Tables

K = 10
_JUDGED = f"""{_TOPN}, nt AS (SELECT q, count(*) AS k FROM q GROUP BY q), rel AS (SELECT q, doc AS ref FROM p JOIN q USING (term) JOIN nt USING (q) GROUP BY q, doc, k HAVING 2 * count(*) >= k),
res AS (SELECT q, doc AS ref, rank FROM bm WHERE rank < 30), n AS (SELECT q, count(*) AS n FROM rel GROUP BY q),
t10 AS (SELECT q, count(*) AS found, sum(1 / log2(rank + 2)) AS dcg FROM res JOIN rel USING (q, ref) WHERE rank < {K} GROUP BY q), f AS (SELECT q, min(rank) AS first FROM res JOIN rel USING (q, ref) GROUP BY q),
every AS (SELECT q FROM res UNION SELECT q FROM rel),
j AS (SELECT e.q, coalesce(CAST(found AS DOUBLE) / n, 0) AS recall, coalesce(found, 0) > 0 AS hit, CAST(coalesce(found, 0) AS DOUBLE) / {K} AS precision, coalesce(1.0::DOUBLE / (first + 1), 0) AS rr, coalesce(dcg / list_sum([1 / log2(i + 2) FOR i IN range(least(n, {K}))]), 0) AS ndcg FROM every e LEFT JOIN n USING (q) LEFT JOIN t10 USING (q) LEFT JOIN f USING (q))"""


def judgements(t: Tables) -> DataFrame:
    """Relevant is a document that holds half of a query's words."""
    words = asked(t)
    held = index(t).postings.select("term", F.col("doc").alias("ref")).join(words, "term").groupBy("q", "ref").agg(F.count("*").alias("c"))
    relevant = held.join(words.groupBy("q").agg(F.count("*").alias("k")), "q").where("2 * c >= k")
    return judged(text_hits(t).select("q", F.col("doc").alias("ref"), "rank"), relevant, K)


@query("agg-38", f"WITH {_JUDGED} SELECT q, round(recall, 6) AS recall FROM j")
def recall_at_k(t: Tables) -> DataFrame:
    return judgements(t).select("q", F.round("recall", 6).alias("recall"))


@query("agg-39", f"WITH {_JUDGED} SELECT q, hit FROM j")
def hit_at_k(t: Tables) -> DataFrame:
    return judgements(t).select("q", "hit")


@query("agg-40", f"WITH {_JUDGED} SELECT q, round(precision, 6) AS prec FROM j")
def precision_at_k(t: Tables) -> DataFrame:
    return judgements(t).select("q", F.round("precision", 6).alias("prec"))


@query("agg-41", f"WITH {_JUDGED} SELECT q, round(rr, 6) AS rr FROM j")
def reciprocal_rank(t: Tables) -> DataFrame:
    return judgements(t).select("q", F.round("rr", 6).alias("rr"))


@query("agg-42", f"WITH {_JUDGED} SELECT round(avg(rr), 6) AS mrr FROM j")
def mean_reciprocal_rank(t: Tables) -> DataFrame:
    return judgements(t).agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query("agg-43", f"WITH {_JUDGED} SELECT q, round(ndcg, 6) AS ndcg FROM j")
def ndcg(t: Tables) -> DataFrame:
    return judgements(t).select("q", F.round("ndcg", 6).alias("ndcg"))


@query("agg-44", f"WITH {_JUDGED} SELECT round(avg(ndcg), 6) AS ndcg FROM j")
def mean_ndcg(t: Tables) -> DataFrame:
    return judgements(t).agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("agg-45", "SELECT CASE WHEN count(*) > 0 THEN round(CAST(count(*) FILTER (WHERE quality = CASE WHEN coalesce(len(regexp_extract_all(text, '\\S+')), 0) >= 20 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) ELSE 0 END AS accuracy FROM labels JOIN documents USING (doc_id)")
def accuracy(t: Tables) -> DataFrame:
    """Answers of a rule (texts of twenty words and more are good) against what was expected."""
    answers = t.documents.select("doc_id", (F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)) >= 20).cast("int").alias("answer"))
    met = t.labels.join(answers, "doc_id")
    return met.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("quality") == F.col("answer")), F.count("*")), F.lit(0.0)), 6).alias("accuracy"))


_DRAWS = ", ".join(f"{c!r}" for c in CUTS)


@query("agg-46", f"""WITH d AS (SELECT r, quality, CAST('0x' || substr(md5(CAST(doc_id AS STRING) || ':' || CAST(r AS STRING) || ':12345'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM labels, unnest(range(1, 2001)) AS x(r)),
m AS (SELECT r, sum(quality * k) / sum(k)::DOUBLE AS m FROM (SELECT r, quality, len(list_filter([{_DRAWS}], lambda c: u > c)) AS k FROM d) GROUP BY r HAVING sum(k) > 0) SELECT round(max(CASE WHEN i = 51 THEN m END), 6) AS low, round(max(CASE WHEN i = 1951 THEN m END), 6) AS high FROM (SELECT m, row_number() OVER (ORDER BY m) AS i FROM m)""")
def interval(t: Tables) -> DataFrame:
    found = bootstrap(t.labels.where("quality IS NOT NULL"), "quality", ["doc_id"])
    return found.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
