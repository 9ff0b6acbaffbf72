"""Two sinks of one stream: entries, and what is made of them (vectors, say), which may fail without losing the entries.

Each micro-batch is written under its number in both sinks, over whatever an earlier attempt has left there, so a replay doubles nothing. Before the entries a marker is set, and it is taken away once both sinks have the batch; the next
batch first makes again, from the entries, what markers say is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TwoSinks:
    """make: the second sink's rows of some entries. failed: what went wrong, by batch."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.make = spark, folder.rstrip("/"), make
        self.failed: dict[int, str] = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def unfinished(self) -> list[int]:
        there = self._path("unfinished")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(there)) if self._fs.exists(there) else []

    def _second(self, batch: int) -> None:
        """The second sink's part of a batch whose entries are written."""
        try:
            self.make(self.spark.read.parquet(f"{self.folder}/entries/batch={batch}")).write.mode("overwrite").parquet(f"{self.folder}/made/batch={batch}")
        except Exception as e:  # the entries stand; the marker stays for the next batch
            self.failed[batch] = str(e)
            return
        self.failed.pop(batch, None)
        self._fs.delete(self._path(f"unfinished/{batch}"), False)

    def repair(self) -> None:
        """A marker without entries is of a batch that Spark will replay."""
        for batch in self.unfinished():
            if self._fs.exists(self._path(f"entries/batch={batch}/_SUCCESS")):
                self._second(batch)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        self.repair()
        self._fs.mkdirs(self._path("unfinished"))
        self._fs.create(self._path(f"unfinished/{batch}"), True).close()
        rows.write.mode("overwrite").parquet(f"{self.folder}/entries/batch={batch}")
        self._second(batch)

    def drain(self, rows: DataFrame) -> None:
        """Writes all that a streaming frame has now; goes on where the checkpoint in the folder ends."""
        rows.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def read(self, sink: str, schema: str) -> DataFrame:
        there = self._path(sink)
        if not self._fs.exists(there):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{sink}").drop("batch")


def settled(sinks: TwoSinks, entries: str, made: str, key: str) -> DataFrame:
    """The entries with whether the second sink has them; what it has of rows that are no entries does not count."""
    there = sinks.read("made", made).select(key).distinct().withColumn("made", F.lit(True))
    return sinks.read("entries", entries).join(there, key, "left").withColumn("made", F.coalesce("made", F.lit(False)))
