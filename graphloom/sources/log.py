"""A table of rows by key that several writers publish to by compare-and-set.

Rows lie in Parquet files; a commit is a numbered entry of a log that names one of them, and is put in place only if no entry has that number. A writer says which entry it has read up to: if others have published since, their rows are joined with its own by
key. A key that has other values now is a conflict, and nothing is published; if all its rows are there already there is nothing to do; else it tries the next number. Every ``CHECKPOINT`` entries the table as it stands is written
once, so that readers take that and the entries after it.

Only names of files and numbers come to the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT = 10


class CommitLog:
    """rows: keys (who a row is) and values (what is published of it)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [c for c in self.schema.names if c not in keys]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _put(self, name: str, entry: dict) -> bool:
        """Whether the file is new and whole: it is written aside and renamed, which no file in its place survives as a success."""
        aside, there = self._path(f"aside/{uuid.uuid4().hex}"), self._path(name)
        fs = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(there.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri() if there.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(there), options)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            fs.delete(aside, False)
            return False
        return True

    def _entries(self) -> list[tuple[int, str]]:
        return [(int(n), f"{self.folder}/log/{n}") for n in self._names("log")]

    def version(self) -> int:
        """The number of the last entry; -1 before the first."""
        found = self._entries()
        return found[-1][0] if found else -1

    def _told(self, entries: list[tuple[int, str]]) -> DataFrame:
        """The rows of entries, with their number."""
        out = self.spark.createDataFrame([], self.schema).withColumn("_n", F.lit(0).cast("long"))
        if entries:
            files = self.spark.read.schema("n long, file string").json([p for _, p in entries]).collect()
            for r in files:
                out = out.union(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{r.file}").withColumn("_n", F.lit(r.n)))
        return out

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_n")))).where("_rn = 1").drop("_rn", "_n")

    def read(self, version: int | None = None) -> DataFrame:
        """The table after an entry (the last one if none is given): the last checkpoint before it, and what came after that."""
        version = self.version() if version is None else version
        done = [int(n) for n in self._names("checkpoints") if int(n) <= version]
        low = done[-1] if done else -1
        rows = self._told([e for e in self._entries() if low < e[0] <= version])
        if done:
            name = self.spark.read.schema("file string").json(f"{self.folder}/checkpoints/{done[-1]:020d}").first().file
            rows = rows.union(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}").withColumn("_n", F.lit(low).cast("long")))
        return self._last(rows).select(*self.schema.names)

    def publish(self, rows: DataFrame, base: int) -> str:
        """rows (one a key) of a writer that has read up to entry `base`: PUBLISHED, CONFLICT or IDEMPOTENT."""
        file = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.folder}/{file}")
        mine = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{file}")
        same = F.struct(*(F.col(f"_{c}") for c in self.values)).eqNullSafe(F.struct(*self.values))
        while True:
            last = self.version()
            if last > base:
                since = self._last(self._told([e for e in self._entries() if base < e[0] <= last]))
                met = mine.join(since.select(*self.keys, *(F.col(c).alias(f"_{c}") for c in self.values), F.lit(True).alias("_there")), self.keys, "left")
                all_rows, there, other = met.agg(F.count("*"), F.count("_there"), F.count_if(F.col("_there") & ~same)).first()
                if other:
                    return "CONFLICT"
                if all_rows and there == all_rows:
                    return "IDEMPOTENT"
            if self._put(f"log/{last + 1:020d}", {"n": last + 1, "file": file}):
                if (last + 2) % CHECKPOINT == 0:
                    self.checkpoint(last + 1)
                return "PUBLISHED"

    def checkpoint(self, version: int) -> None:
        file = f"data/{uuid.uuid4().hex}"
        self.read(version).write.parquet(f"{self.folder}/{file}")
        self._put(f"checkpoints/{version:020d}", {"file": file})
