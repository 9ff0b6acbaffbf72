"""Plans over job commands and indexes: the events as commands on keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.sources.tables import Tables
from graphloom.streaming.jobs import fold_stream, windowed_usage


def commands(t: Tables) -> DataFrame:
    c = F.create_map(*(x for k, v in {"signup": "enqueue", "view": "claim", "click": "enqueue", "purchase": "ack", "error": "retry"}.items() for x in (F.lit(k), F.lit(v))))
    return t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), c[F.col("event_type")].alias("command"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.lit("w").alias("token"))


@query("str-16", None)
def drain(t: Tables) -> DataFrame:
    """The queue as a stream that drains what is there; the last state of each key."""
    from graphloom.operators.shared import cut

    cut(t.spark.range(1))
    base = f"{t.spark.sparkContext.getCheckpointDir().rstrip('/')}/drain-{uuid.uuid4().hex}"
    commands(t).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(commands(t).schema).parquet(f"{base}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    fold_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch")))).where("rn = 1").drop("rn", "batch")


@query("stream-usage", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 2) AS mean FROM events GROUP BY 1, 2")
def daily_usage(t: Tables) -> DataFrame:
    """Event-time windows; the same function runs on a stream, with a watermark."""
    return windowed_usage(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 2).alias("mean"))


@query("str-24", "SELECT event_id, CASE event_type WHEN 'view' THEN 'codegraph,ingest,code_vec' ELSE event_type END AS kinds FROM events")
def upsert_scopes(t: Tables) -> DataFrame:
    asked = F.array(F.when(F.col("event_type") == "view", "codegraph").otherwise(F.col("event_type")))
    implied = F.when(F.array_contains(asked, "codegraph"), F.array(F.lit("ingest"), F.lit("code_vec"))).otherwise(F.array().cast("array<string>"))
    return t.events.select("event_id", F.concat_ws(",", F.array_union(asked, implied)).alias("kinds"))
