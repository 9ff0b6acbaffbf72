"""Streams, their restarts, and the commit log."""

from __future__ import annotations

import json
import random
from collections import deque
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from graphloom.sources import log
from graphloom.sources.log import CommitLog
from graphloom.streaming.limiter import accepted, accepted_stream
from graphloom.streaming.pushes import lines, pushes
from graphloom.streaming.sinks import TwoSinks, settled


def test_of_two_writers_one_publishes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "CHECKPOINT", 3)
    table = CommitLog(spark, str(tmp_path), "project string, kind string, attempt string, files long", ["project", "kind"])
    rows = lambda *x: spark.createDataFrame(list(x), table.schema)
    assert table.version() == -1 and table.read().count() == 0
    a = b = table.version()
    assert table.publish(rows(("p", "graph", "1", 5), ("q", "graph", "1", None)), a) == "PUBLISHED"
    assert table.publish(rows(("p", "graph", "2", 6)), b) == "CONFLICT"
    assert table.publish(rows(("q", "graph", "1", None)), b) == "IDEMPOTENT"
    assert table.publish(rows(("r", "graph", "9", 1)), b) == "PUBLISHED"  # nobody else has touched it
    assert table.publish(rows(("p", "graph", "2", 6)), table.version()) == "PUBLISHED"
    assert table.publish(rows(("p", "graph", "3", 7)), table.version()) == "PUBLISHED"
    assert table._names("checkpoints") == [f"{2:020d}"]
    assert sorted(map(tuple, table.read().collect())) == [("p", "graph", "3", 7), ("q", "graph", "1", None), ("r", "graph", "9", 1)]
    assert sorted(map(tuple, table.read(0).collect())) == [("p", "graph", "1", 5), ("q", "graph", "1", None)]


def test_a_number_that_another_writer_takes_meanwhile_is_not_taken_twice(spark, tmp_path, monkeypatch):
    table = CommitLog(spark, str(tmp_path), "k string, v long", ["k"])
    other = CommitLog(spark, str(tmp_path), "k string, v long", ["k"])
    put, late = table._put, []

    def raced(name, entry):
        if not late:  # the other writer is faster by one step
            late.append(other.publish(spark.createDataFrame([("a", 2)], "k string, v long"), -1))
        return put(name, entry)

    monkeypatch.setattr(table, "_put", raced)
    assert table.publish(spark.createDataFrame([("a", 1)], "k string, v long"), -1) == "CONFLICT"
    assert late == ["PUBLISHED"] and [tuple(r) for r in other.read().collect()] == [("a", 2)]
    late.clear()
    assert table.publish(spark.createDataFrame([("b", 1)], "k string, v long"), 0) == "PUBLISHED"


def test_a_failing_second_sink_is_repaired_by_the_next_batch(spark, tmp_path):
    broken = [True]

    def vectors(rows):
        if broken[0]:
            return rows.select("id", F.raise_error(F.lit("no model")).cast("double").alias("v"))
        return rows.select("id", (F.col("id") * 0.5).alias("v"))

    source, sinks = str(tmp_path / "in"), TwoSinks(spark, str(tmp_path / "out"), vectors)
    stream = lambda: spark.readStream.schema("id long, text string").json(source)
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").write.mode("append").json(source)
    sinks.drain(stream())
    assert sinks.unfinished() == [0] and "no model" in sinks.failed[0]
    told = lambda: sorted(map(tuple, settled(sinks, "id long, text string", "id long, v double", "id").select("id", "made").collect()))
    assert told() == [(1, False), (2, False)]
    broken[0] = False
    spark.createDataFrame([(3, "c")], "id long, text string").write.mode("append").json(source)
    sinks = TwoSinks(spark, str(tmp_path / "out"), vectors)  # as after a restart
    sinks.drain(stream())
    assert sinks.unfinished() == [] and told() == [(1, True), (2, True), (3, True)]
    sinks(spark.createDataFrame([(3, "c")], "id long, text string"), 1)  # a replay doubles nothing
    assert told() == [(1, True), (2, True), (3, True)] and sinks.read("made", "id long, v double").count() == 3


def test_pushes_are_read_once_over_restarts(spark, tmp_path):
    body = lambda repo, *files: json.dumps({"repository": {"name": repo}, "commits": [{"added": list(files), "modified": ["m"], "removed": []}, {"added": None}]})
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(name, *rows):
        (source / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))

    def drain():
        pushes(lines(spark, str(source), 1)).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows").start().awaitTermination()
        return sorted((r.id, r.repo, r.files, r.broken) for r in spark.read.parquet(f"{out}/rows").collect() if r.id) + sorted(r.broken for r in spark.read.parquet(f"{out}/rows").collect() if not r.id)

    arrive("1", {"id": "1", "event": "push", "body": body("r", "a", "m")}, {"id": "2", "event": "ping", "body": "{}"}, "{ broken")
    first = drain()
    assert first == [("1", "r", ["a", "m"], None), "{ broken"]
    assert drain() == first
    bad = {"id": "3", "event": "push", "body": "{ no"}
    arrive("2", bad, {"id": "4", "event": "push", "body": body("s")})
    assert drain() == [("1", "r", ["a", "m"], None), ("3", None, None, json.dumps(bad)), ("4", "s", ["m"], None), "{ broken"]


@pytest.mark.parametrize("parts", [1, 4])
def test_the_limiter_decides_alike_as_batch_and_stream(spark, tmp_path, parts):
    rng, most, window = random.Random(parts), 3, 10_000_000
    rows = sorted((1_700_000_000_000_000 + rng.randrange(200) * 1_000_000, i, f"k{rng.randrange(4)}") for i in range(300))
    want, held = {}, {}
    for at, i, k in rows:
        q = held.setdefault(k, deque())
        while q and q[0] <= at - window:
            q.popleft()
        want[i] = len(q) < most
        if want[i]:
            q.append(at)
    frame = lambda some: spark.createDataFrame([(k, at, i, datetime.fromtimestamp(at / 1e6, timezone.utc)) for at, i, k in some], "key string, at long, event_id long, ts timestamp")
    assert {r.event_id: r.allowed for r in accepted(frame(rows).drop("ts"), most, window).collect()} == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for p in range(parts):  # each part is a run of its own, from the checkpoint of the one before
        frame(rows[p * 300 // parts : (p + 1) * 300 // parts]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, at long, event_id long, ts timestamp").parquet(source)
        accepted_stream(stream, most, window).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    found = spark.read.parquet(f"{out}/rows").collect()
    assert len(found) == 300 and {r.event_id: r.allowed for r in found} == want
