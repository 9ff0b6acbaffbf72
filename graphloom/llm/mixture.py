"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

A document's place in its source is 60 bits of the MD5 of its id (of its text, without one), so reruns agree and a larger budget takes a superset of a smaller one.
Words are summed by source and hash bucket (12 bits); the bucket in which a source's budget ends is the
only one that is summed again by the next 12 bits, and so on for three rounds, which leaves the budget's end within
one of 2**36 buckets. A source whose target exceeds its size takes each document once (or twice) and some of
them once more; no row is sorted or moved, and a hot source only adds to partial sums.

Null texts count no words; null sources are a source of their own, last in order; documents with one id share a place and are
taken alike; rows without an id have the place of their text. No row is taken more than ``REPEATS`` times, whatever its size. Empty tables give empty results. Other columns are not read by ``mixture`` and
are passed on by ``mix_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, fresh

WEIGHTS = (3, 1, 2)
#: The mix has so many times the words of all documents, and takes a document so often at most.
SHARE, REPEATS = 1.5, 2
BITS, ROUNDS, HASH_BITS = 12, 3, 60
#: More sources than these are not broadcast.
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def place(doc_id: Column, text: Column) -> Column:
    """A row's place in its source, from its id, or from its text if it has none."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("long").cast("string"), text.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: budgets by weight, held to REPEATS times a source's size.

    Sources are as many as weights can be given for, so that one window ranks them; the excess of those that reach their limit goes to the rest
    by weight, which ends when the limit is above the common rate for all that are left."""
    order, by_rate = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("rate", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    rated = sizes.withColumn("w", w).withColumn("rate", F.col("source_size") / F.col("w"))
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    scaled = SHARE / REPEATS
    run = rated.select("*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("v"), F.sum("source_size").over(everything).alias("all_s"), F.sum("w").over(everything).alias("all_w"))
    full = run.withColumn("full", F.col("source_size") * (F.col("all_w") - F.col("v")) <= F.col("w") * (scaled * F.col("all_s") - F.col("s")))
    held = full.select("*", F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything).alias("full_s"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything).alias("open_w"))
    share = REPEATS * F.col("w") * (scaled * F.col("all_s") - F.col("full_s")) / F.col("open_w")
    return held.select("source", "source_size", F.when(F.col("full"), F.col("source_size") * float(REPEATS)).otherwise(share).alias("target"))


def thresholds(places: DataFrame) -> DataFrame:
    """places: source, size, h. Returns source, source_size, target, copies, below: a source takes each document `copies`
    times, and once more those with h < below."""
    sizes = cut(places.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = cut(targets(sizes).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    state = plan.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for k in range(1, ROUNDS + 1):
        shift = HASH_BITS - BITS * k
        bucket = F.shiftright("h", shift)
        now = state.select(F.col("source").alias("s"), "rest", "prefix")
        rows = places if k == 1 else places.join(_small(now), places["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))).select("source", "size", "h")
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.join(_small(now), sums["source"].eqNullSafe(F.col("s"))).withColumn("upto", F.sum("n").over(upto))
        edge = sums.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "n", "upto", "rest")).alias("b"))
        state = cut(edge.select("source", (F.col("b.rest") - (F.col("b.upto") - F.col("b.n"))).alias("rest"), F.col("b.bucket").alias("prefix"), F.col("b.n").alias("n")))
    last = state.select(F.col("source").alias("s"), F.shiftleft(F.col("prefix") + F.when(2 * F.col("rest") > F.col("n"), 1).otherwise(0), HASH_BITS - BITS * ROUNDS).alias("below"))
    return plan.join(last, plan["source"].eqNullSafe(last["s"]), "left").select("source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def _small(sources: DataFrame) -> DataFrame:
    """A table with a row a source, to be broadcast if it has been counted to be small; else Spark splits the hot side of the join."""
    return F.broadcast(sources) if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else sources


def _taken(rows: DataFrame, plan: DataFrame, source: str, at: Column) -> tuple[DataFrame, dict[str, Column], Column]:
    """rows with their source's plan, the plan's columns, and how often each row (at its place) is taken. Names that rows has are not used again."""
    names = {c: fresh(f"of_{c}", rows.columns) for c in plan.columns}
    plan = _small(cut(plan.select(*(F.col(c).alias(n) for c, n in names.items()))))
    of = {c: F.col(n) for c, n in names.items()}
    met = rows.join(plan, F.col(source).eqNullSafe(of["source"]))
    return met, of, F.least(of["copies"] + F.when(at < of["below"], 1).otherwise(0), F.lit(REPEATS).cast("long"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: its words, its source's words and target, and the words that the mix takes of it."""
    sized = cut(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].alias("source"), words(docs[text]).alias("size"), place(docs[doc_id], docs[text]).alias("h")))
    met, of, times = _taken(sized, thresholds(sized.select("source", "size", "h")), "source", F.col("h"))
    return met.select("doc_id", "size", of["source_size"].alias("source_size"), of["target"].alias("target"), (F.col("size") * times).alias("taken"))


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, with all columns; a document that is taken twice has two rows."""
    places = cut(docs.select(docs[source].alias("source"), words(docs[text]).alias("size"), place(docs[doc_id], docs[text]).alias("h")))
    met, _, times = _taken(docs, thresholds(places), source, place(docs[doc_id], docs[text]))
    turns = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    turn = fresh("turn", docs.columns)
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(turns).alias(turn)).drop(turn)


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) >> 24 AS b FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM s),
r AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS s_before, coalesce(sum(w) OVER o, 0) AS w_before, sum(source_size) OVER () AS all_s, sum(w) OVER () AS all_w FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, source_size * (all_w - w_before) <= w * (CAST(0.75 AS DOUBLE) * CAST(all_s AS DOUBLE) - CAST(s_before AS DOUBLE)) AS full_ FROM r),
g AS (SELECT *, CAST(sum(CASE WHEN full_ THEN source_size ELSE 0 END) OVER () AS DOUBLE) AS full_s, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS open_w FROM f),
t AS (SELECT source, source_size, CASE WHEN full_ THEN 2.0::DOUBLE * source_size ELSE 2 * w * (CAST(0.75 AS DOUBLE) * CAST(all_s AS DOUBLE) - full_s) / open_w END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
h AS (SELECT source, b, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, b),
c AS (SELECT h.source, b, n, CAST(sum(n) OVER (PARTITION BY h.source ORDER BY b) AS BIGINT) AS upto, target - copies * source_size AS rest FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(b) AS b, arg_min(n, b) AS n, arg_min(upto, b) AS upto, arg_min(rest, b) AS rest FROM c WHERE upto > rest GROUP BY source),
z AS (SELECT source, b + CASE WHEN 2 * (rest - (upto - n)) > n THEN 1 ELSE 0 END AS below FROM e)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.copies + CASE WHEN d.b < coalesce(z.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source"""
