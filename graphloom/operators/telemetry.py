"""Rollups of calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.measures import rank_of
from graphloom.operators.shared import cut


#: Ranges of values that are counted in a round, and rounds.
BINS, ROUNDS = 1024, 2


def percentile(df: DataFrame, keys: list[str], value: str, ps: dict[str, float | Callable[[Column], Column]], places: int | None = 1) -> DataFrame:
    """Nearest-rank percentiles by key: of a share (its place is rank_of), or of a function from the number of values to a place from 1.

    Values are counted in BINS ranges between the least and the greatest of a key; only the range in which a place lies is counted again, in as many ranges of its own, and only
    what is left after ROUNDS rounds is put in order. So a hot key's values meet in no task."""
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_k"))
    on = [*keys, "_k"]
    whole = held.groupBy(*on).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_all"))
    places_ = [F.struct(F.lit(name).alias("name"), (p(F.col("_all")) if callable(p) else rank_of(p, F.col("_all"))).cast("long").alias("rank")) for name, p in ps.items()]
    state = cut(whole.select(*on, "_lo", "_hi", F.explode(F.array(*places_)).alias("_p")).select(*on, "_lo", "_hi", F.col("_p.name").alias("_name"), F.col("_p.rank").alias("_rank")))
    for _ in range(ROUNDS):
        width = (F.col("_hi") - F.col("_lo")) / BINS
        rows = held.join(state, on).where("_v BETWEEN _lo AND _hi")
        bins = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1))).otherwise(0)
        counts = rows.groupBy(*on, "_name", "_rank", bins.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        run = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*on, "_name").orderBy("_b")))
        first = run.where(F.col("_upto") >= F.col("_rank")).groupBy(*on, "_name").agg(F.min(F.struct("_b", "_lo", "_hi", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))).alias("m"))
        state = cut(first.select(*on, F.col("m._lo").alias("_lo"), F.col("m._hi").alias("_hi"), "_name", F.col("m._rank").alias("_rank")))
    last = held.join(state, on).where("_v BETWEEN _lo AND _hi").groupBy(*on, "_name", "_rank", "_v").agg(F.count("*").alias("_n"))
    found = last.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*on, "_name").orderBy("_v"))).where(F.col("_upto") >= F.col("_rank"))
    out = lambda c: F.round(c, places) if places is not None else c
    one = found.groupBy(*on, "_name").agg(F.min("_v").alias("_v"))
    return one.groupBy(*on).agg(*(out(F.max(F.when(F.col("_name") == name, F.col("_v")))).alias(name) for name in ps)).drop("_k")


def usage_rollup(calls: DataFrame, cost: Column) -> DataFrame:
    """Totals over all, by model, by org and by user in one pass: level, model, org_id, user_id, queries, tokens, cost, cache_hit_rate."""
    sums = [F.count("*").alias("queries"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_hit_tokens", "cache_miss_tokens")), F.round(F.sum(cost), 6).alias("cost")]
    rolled = calls.groupingSets([[], ["model"], ["org_id"], ["user_id"]], "model", "org_id", "user_id").agg(F.grouping_id().alias("g"), *sums)
    level = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "model").when(F.col("g") == 5, "org").otherwise("user")
    seen = F.col("cache_hit_tokens") + F.col("cache_miss_tokens")
    return rolled.withColumn("level", level).withColumn("cache_hit_rate", F.when(seen > 0, F.round(F.col("cache_hit_tokens") / seen, 4)).otherwise(0.0)).drop("g")
