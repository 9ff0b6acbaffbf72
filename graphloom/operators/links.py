"""Joins that link nodes of different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.shared import cut, small


def normal_url(url: Column) -> Column:
    """Without a method before it, query, fragment and slashes at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?i:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+", ""), r"[?#].*$", "")
    return F.regexp_replace(bare, "(?<=.)/+$", "")


def _placeholder(segment: Column) -> Column:
    return segment.rlike(r"^(\{.*\}|:.+)$")


def match_templates(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """calls: url; ends: template. Pairs with as many segments, each equal or a placeholder on either side; equal rows of a side count once.

    Both sides meet on the number of segments and the literal segments where neither has a placeholder: templates are
    few shapes, so each shape is one equi join. A pair is made once, as either side has each key once, so pairs are not shuffled."""
    seg = lambda c: F.split(F.regexp_replace(normal_url(c), "^/", ""), "/")
    calls = calls.withColumn("_c", seg(F.col("url")))
    ends = ends.withColumn("_e", seg(F.col("template")))
    mask = lambda c: F.transform(c, lambda s: F.when(_placeholder(s), "*").otherwise(""))
    ours, theirs = calls.select(mask(F.col("_c")).alias("m")).distinct(), ends.select(mask(F.col("_e")).alias("k")).distinct()
    shapes = ours.join(theirs, F.size("m") == F.size("k"))
    shapes = shapes.select("m", "k", F.zip_with("m", "k", lambda a, b: F.when((a == "*") | (b == "*"), "*").otherwise("")).alias("open"))
    key = lambda c: F.to_json(F.struct("k", "open", F.zip_with(c, F.col("open"), lambda s, o: F.when(o == "*", "*").otherwise(s)).alias("s")))
    shapes = small(cut(shapes))
    left = calls.withColumn("m", mask(F.col("_c"))).join(shapes, "m").withColumn("_k", key(F.col("_c")))
    right = ends.withColumn("k", mask(F.col("_e"))).join(shapes, "k").withColumn("_k", key(F.col("_e")))
    left, right = (side.drop("m", "k", "open", c).distinct() for side, c in ((left, "_c"), (right, "_e")))
    return left.join(right, "_k").drop("_k")


def by_operation(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """id, target, confidence of calls whose (service, operation_id) an endpoint has; several make it uncertain."""
    key = [F.coalesce("service", F.lit("")).alias("service"), "operation_id"]
    ends = ends.where("operation_id IS NOT NULL AND operation_id <> ''").select("id", *key).groupBy("service", "operation_id").agg(F.min("id").alias("target"), F.count("*").alias("n"))
    return calls.where("operation_id <> ''").select("id", *key).join(ends, ["service", "operation_id"]).select("id", "target", F.when(F.col("n") == 1, 1.0).otherwise(0.5).alias("confidence"))


def by_url(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """id, target, confidence by equal url, narrowed by method where one is known and fits."""
    method = F.upper(F.coalesce(F.nullif("http_method", F.lit("")), F.lit("POST")))
    left = calls.where("url <> ''").select("id", "url", method.alias("m"), F.coalesce("url_registry", F.lit(False)).alias("open"))
    right = ends.where("url <> ''").select("url", F.col("id").alias("target"), method.alias("em"), F.coalesce("service", F.lit("")).alias("service"))
    # Endpoints of one url and method are one candidate row, so a common url does not multiply.
    per = right.groupBy("url", "em").agg(F.min("target").alias("t"), F.count("*").alias("n"), F.min("service").alias("lo"), F.max("service").alias("hi"))
    whole = right.groupBy("url").agg(F.min("target").alias("t"), F.count("*").alias("n"), F.min("service").alias("lo"), F.max("service").alias("hi"), F.min_by("em", "target").alias("em"))
    narrow = left.where("NOT open").join(per.withColumnRenamed("em", "m"), ["url", "m"]).select("id", "t", "n", "lo", "hi", F.lit(True).alias("fits"))
    rest = left.join(narrow.select("id"), "id", "left_anti").join(whole, "url").select("id", "t", "n", "lo", "hi", (F.col("open") | (F.col("em") == F.col("m"))).alias("fits"))
    sure = F.when(F.col("n") == 1, F.when(F.col("fits"), 1.0).otherwise(0.7)).when(F.col("lo") != F.col("hi"), 0.5).otherwise(0.6)
    return narrow.union(rest).select("id", F.col("t").alias("target"), sure.alias("confidence"))


def link_calls(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """calls_api edges: by operation where one is found, else by url."""
    op = by_operation(calls, ends).withColumn("how", F.lit("operation"))
    url = by_url(calls, ends).join(op.select("id"), "id", "left_anti").withColumn("how", F.lit("url"))
    return op.union(url).select(F.col("id").alias("source"), "target", "confidence", "how")


def first_of(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
