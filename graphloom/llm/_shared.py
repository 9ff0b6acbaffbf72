"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine if Spark runs on this machine only, else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: So many rows of a few numbers are little work for a task.
TASK_ROWS = 250_000


def narrowed(df: DataFrame, rows: int, each: int | None = None) -> DataFrame:
    """df in as few tasks as so many rows need, at most those it has. The session's partitions are for texts; links are few and would leave a file a task and step."""
    return df.coalesce(max(1, -(-rows // (each or TASK_ROWS))))


def cut_narrow(df: DataFrame, each: int | None = None) -> DataFrame:
    """As cut(), read in as few tasks as its rows need."""
    df = cut(df)
    return narrowed(df, df.count(), each)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As cut(), in compressed columns: for tables that hold texts or blobs. The caller may drop() the folder."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder by Hadoop's file system, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys that hold over one part in so many of the rows are hot: fewer than so many can be.
HOT_PARTS = 1000


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, whose keys are unique and which knows how many of the rows have each (weight). The hot keys, fewer than
    HOT_PARTS, are sent to all tasks, so that their rows stay where they are; the rows of others are shuffled."""
    total = table.agg(F.sum(weight)).first()[0]
    if not total:
        return rows.join(table, keys, how)
    is_hot = F.col(weight) * HOT_PARTS > total
    hot = F.broadcast(table.where(is_hot))
    rest = rows.join(F.broadcast(table.where(is_hot).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table.where(~is_hot), keys, how))


def content_digest(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; of no text, those of an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
