"""The folder that driver and executors share: cuts of lineage, and tables written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows are sent to all tasks at most.
FEW_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine if Spark runs on this machine only, else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows in buckets of a key, sorted by it: a join on the key moves the other side only."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def small(rows: DataFrame) -> DataFrame:
    """To be sent to all tasks, where they are few."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt anew, so that all work at them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def by_text(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries: q, text. One query of each text, by the least q; and (q, as) of all: the query that is asked for each."""
    asked = cut(queries.groupBy("text").agg(F.min("q").alias("q")).where("text IS NOT NULL").select("q", "text"))
    return asked, queries.join(small(asked.withColumnRenamed("q", "as")), "text").select("q", "as")


def of_texts(found: DataFrame, back: DataFrame) -> DataFrame:
    """found: q, ..., of the queries that by_text asks; the same for all."""
    return back.join(small(cut(found.withColumnRenamed("q", "as"))), "as").drop("as")
