"""A store of graph rows: Parquet partitioned by project and plugin, replaced plugin by plugin; versions beside one another, published by a pointer; a manifest of builds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.shared import shared_dir

PART = ["project_id", "plugin"]


class GraphStore:
    """Tables below a folder. A replacement writes the partitions of the projects and plugins in the rows and leaves others alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> GraphStore:
        return cls(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")

    def replace(self, table: str, rows: DataFrame, key: list[str], order: str = "ord", part: list[str] | None = None) -> None:
        """All rows of the partitions that rows has; of equal keys the last stays."""
        part = part or ["plugin"]
        last = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*part, *key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(f"{self.folder}/{table}")

    def ingest(self, table: str, rows: DataFrame, key: list[str], order: str = "ord") -> None:
        """replace(), and a record of how many rows each partition then has."""
        self.replace(table, rows, key, order, PART)
        parts = rows.select(*PART).distinct()
        told = self.read(table).join(parts, PART, "left_semi").groupBy(*PART).agg(F.count("*").alias("ingested")).select(F.lit(table).alias("what"), *PART, "ingested", F.current_timestamp().alias("at"))
        told.write.mode("append").parquet(f"{self.folder}/ingested")

    def ingested(self) -> DataFrame:
        """what, project_id, plugin, ingested: the last record of each partition."""
        last = self.read("ingested").groupBy("what", *PART).agg(F.max_by("ingested", "at").alias("ingested"))
        return last

    def append(self, table: str, rows: DataFrame, part: list[str] | None = None) -> None:
        (rows.write.mode("append").partitionBy(*part) if part else rows.write.mode("append")).json(f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def clear(self, table: str, parts: list[dict[str, str]]) -> None:
        """Removes whole partitions."""
        for part in parts:
            path = self.path(f"{table}/" + "/".join(f"{k}={v}" for k, v in part.items()))
            self.fs().delete(path, True)

    def fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def build(self, table: str, rows: DataFrame) -> str:
        """Writes a version beside those that are read."""
        version = f"{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/builds/{version}")
        return version

    def _pointers(self, table: str) -> list[tuple[int, str]]:
        """Numbers and names of the pointers that there are, ascending; a pointer is written under a name of its own and renamed when it is whole."""
        folder = self.path("pointers")
        names = [s.getPath().getName() for s in self.fs().listStatus(folder)] if self.fs().exists(folder) else []
        return sorted((int(n.split(".")[1]), n) for n in names if n.startswith(f"{table}.") and n.count(".") == 1)

    def publish(self, table: str, version: str) -> None:
        """Readers see the version from now on: they take the pointer with the greatest number, and one is there at any time."""
        fs, found = self.fs(), self._pointers(table)
        number = found[-1][0] + 1 if found else 0
        new = self.path(f"pointers/{table}.new.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"current": version}).encode()))
        out.close()
        if not fs.rename(new, self.path(f"pointers/{table}.{number}")):
            raise RuntimeError(f"another version of {table} was published meanwhile")
        for _, name in found[:-1]:
            fs.delete(self.path(f"pointers/{name}"), False)

    def current(self, table: str) -> str | None:
        found = self._pointers(table)
        return json.loads(self.spark.read.text(f"{self.folder}/pointers/{found[-1][1]}").first()[0])["current"] if found else None

    def published(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/builds/{self.current(table)}")

    def collect_garbage(self, table: str, keep: int = 2) -> list[str]:
        """Removes all but the newest `keep` versions and the current one; returns what went."""
        fs, current = self.fs(), self.current(table)
        found = sorted((s for s in fs.listStatus(self.path("builds")) if s.getPath().getName().startswith(f"{table}-")), key=lambda s: -s.getModificationTime())
        gone = [s.getPath() for i, s in enumerate(found) if i >= keep and s.getPath().getName() != current]
        for path in gone:
            fs.delete(path, True)
        return [p.getName() for p in gone]


def publish_builds(old: DataFrame, new: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """old, new: project_id, kind, attempt, values. The manifest after the publication of new builds, one row a project and kind, and the outcome of each: IDEMPOTENT if the same attempt
    has the same values, CONFLICT (nothing changes) if it has others, else PUBLISHED."""
    key = ["project_id", "kind"]
    had = old.select(*key, F.col("attempt").alias("_attempt"), F.struct(*values).alias("_old"))
    met = new.join(had, key, "left").withColumn("outcome", F.when(F.col("_attempt").eqNullSafe(F.col("attempt")), F.when(F.struct(*values) == F.col("_old"), "IDEMPOTENT").otherwise("CONFLICT")).otherwise("PUBLISHED"))
    won = met.where("outcome <> 'CONFLICT'").select(*key, "attempt", *values)
    return old.join(won.select(*key), key, "left_anti").select(*key, "attempt", *values).union(won), met.select(*key, "outcome")
