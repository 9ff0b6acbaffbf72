"""Push events as a stream: payloads that arrive as lines of files, in one neutral form.

The file source keeps in its checkpoint which files were read, so a restart neither loses nor doubles an event. A payload that cannot be read is kept apart with its text; events of other kinds are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "array<struct<added: array<string>, modified: array<string>, removed: array<string>>>"
PAYLOAD = f"struct<repository: struct<name: string>, commits: {COMMITS}, broken: string>"


def lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """value: the lines of the files of a folder, as they come."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).text(folder)


def pushes(rows: DataFrame) -> DataFrame:
    """rows: value, a JSON object (id, event, body). id, repo, files (of all commits, each once), broken (the line, where it or its body cannot be read)."""
    outer = F.from_json("value", "id string, event string, body string, broken string", {"columnNameOfCorruptRecord": "broken"})
    read = rows.select("value", outer.alias("o")).select("value", "o.id", "o.event", "o.body", F.col("o.broken").alias("bad"))
    read = read.withColumn("b", F.from_json("body", PAYLOAD, {"columnNameOfCorruptRecord": "broken"}))
    bad = F.col("bad").isNotNull() | F.col("id").isNull() | ((F.col("event") == "push") & (F.col("b.broken").isNotNull() | F.col("b.repository.name").isNull()))
    bad = F.coalesce(bad, F.lit(False))
    lists = lambda c: F.concat(*(F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed")))
    files = F.array_distinct(F.flatten(F.transform(F.coalesce("b.commits", F.array().cast(COMMITS)), lists)))
    kept = read.where(bad | (F.col("event") == "push"))
    return kept.select("id", F.when(~bad, F.col("b.repository.name")).alias("repo"), F.when(~bad, files).alias("files"), F.when(bad, F.col("value")).alias("broken"))
