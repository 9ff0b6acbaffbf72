"""Quality of ranked results against what is relevant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """results: q, ref, rank (from 0); relevant: q, ref. q, recall, hit, precision, rr, ndcg, with zeros for queries without results or relevant refs."""
    good = relevant.select("q", "ref").distinct()
    totals = good.groupBy("q").agg(F.count("*").alias("n"))
    top = results.where(F.col("rank") < k).join(good, ["q", "ref"], "left_semi").groupBy("q").agg(F.countDistinct("ref").alias("found"), F.sum(1 / F.log2(F.col("rank") + 2)).alias("dcg"))
    first = results.join(good, ["q", "ref"], "left_semi").groupBy("q").agg(F.min("rank").alias("first"))
    every = results.select("q").union(good.select("q")).distinct().join(totals, "q", "left").join(top, "q", "left").join(first, "q", "left")
    ideal: Column = F.aggregate(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(k)).cast("int") - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2))
    found = F.coalesce("found", F.lit(0))
    return every.select("q", F.when(F.col("n") > 0, found / F.col("n")).otherwise(0.0).alias("recall"), (found > 0).alias("hit"), (found / F.lit(k)).alias("precision"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("rr"), F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def _poisson_cuts(n: int = 9) -> list[float]:
    """P(a Poisson draw of mean 1 is at most i), for i from 0."""
    cuts, p, total = [], math.exp(-1), 0.0
    for i in range(n):
        total += p
        cuts.append(total)
        p /= i + 1
    return cuts


CUTS = _poisson_cuts()


def bootstrap(values: DataFrame, column: str, key: list[str], rounds: int = 2000, alpha: float = 0.05, seed: int = 12345) -> DataFrame:
    """low, high: percentile interval of the mean over resamples; both null without values, both the value if there is one.

    A row counts as often in a resample as a Poisson draw says that hangs on its key, the round and the seed alone, so that resamples are sums, no resample
    is gathered, and the interval does not move with the partitions."""
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in key))
    draws = values.select(F.col(column).cast("double").alias("v"), name.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "k", F.col("r").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum((u > c).cast("int") for c in CUTS)
    means = draws.withColumn("n", times).groupBy("r").agg((F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("m")).where("m IS NOT NULL")
    placed = means.withColumn("i", F.row_number().over(Window.orderBy("m")) - 1)  # as many rows as rounds
    n = F.count("*")
    one = F.lit(values.limit(2).count() == 1)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("m")))
    low, high = at(int(alpha / 2 * rounds)), at(min(rounds - 1, int((1 - alpha / 2) * rounds)))
    mean = F.max("m")
    return placed.agg(F.when(one, mean).otherwise(low).alias("low"), F.when(one, mean).otherwise(high).alias("high"), n.alias("_n")).drop("_n")
