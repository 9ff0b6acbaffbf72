"""Repositories of a project: tags, and results told apart by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stable_tags(repos: DataFrame) -> DataFrame:
    """repos: project, ord, path. project, ord, tag: none for the first, else the folder's name, with -2, -3, ... where it is taken. A tag depends on those given before,
    so the repositories of a project, which are configured by hand, go through one task."""

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for i, row in enumerate(pdf.sort_values("ord").itertuples()):
            base = row.path.rstrip("/").rsplit("/", 1)[-1]
            tag, n = base, 2
            while tag in used:
                tag, n = f"{base}-{n}", n + 1
            if i:
                used.add(tag)
            out.append((row.project, row.ord, tag if i else ""))
        return pd.DataFrame(out, columns=["project", "ord", "tag"])

    return repos.groupBy("project").applyInPandas(name, "project string, ord long, tag string")


def localise(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Frontend nodes and their files with the tag before them; edges follow their ends. Without a tag all stays."""
    if not tag:
        return nodes, edges
    front, put = F.startswith("kind", F.lit("frontend")), lambda c: F.concat(F.lit(f"{tag}::"), F.col(c))
    renamed = nodes.where(front).select("id").distinct()
    for side in ("source", "target"):
        edges = edges.join(renamed.select(F.col("id").alias(side), F.lit(True).alias("_r")), side, "left").withColumn(side, F.when(F.col("_r"), put(side)).otherwise(F.col(side))).drop("_r")
    return nodes.withColumn("id", F.when(front, put("id")).otherwise(F.col("id"))).withColumn("file", F.when(front, put("file")).otherwise(F.col("file"))), edges


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with a number from 0 in an order: ranges of the order are counted, and rows ranked within their range only."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id())
    from graphloom.operators.shared import cut

    parted = cut(parted)
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row a partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parted.withColumn("_w", within).join(F.broadcast(before), "_p").withColumn("number", F.col("_before") + F.col("_w")).drop("_p", "_w", "_before")
