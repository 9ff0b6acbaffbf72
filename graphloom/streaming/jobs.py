"""The queue of jobs: the state of each (project, kind) after its commands, folded in order; as a batch, and as a stream with the same fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ["pending_since", "claimed_at", "token", "attempts", "status", "quarantined"]
KINDS = "pending_since double, claimed_at double, token string, attempts int, status string, quarantined boolean"


def step(state: dict, command: str, at: float, token: str | None, lease: float = 600.0) -> dict:
    """The state after a command. Commands that do not fit it (a wrong token, a live lease, quarantine) leave it as it is."""
    s = dict(state)
    mine = s["token"] is not None and s["token"] == token
    if command == "enqueue":
        s["pending_since"] = s["pending_since"] if s["pending_since"] is not None else at
    elif command == "claim":
        free = s["token"] is None or at - s["claimed_at"] > lease
        if (s["pending_since"] is not None or s["token"] is not None) and free and not s["quarantined"]:
            s |= {"claimed_at": at, "token": token, "attempts": s["attempts"] + 1, "pending_since": None, "status": "running"}
    elif command == "renew" and mine and not s["quarantined"]:
        s["claimed_at"] = at
    elif command == "ack" and mine:
        s |= {"claimed_at": None, "token": None, "status": "done"}
    elif command == "retry" and mine:
        s |= {"claimed_at": None, "token": None, "status": "retry", "pending_since": max(at, (s["pending_since"] or at))}
    elif command == "reject" and mine:
        s |= {"claimed_at": None, "token": None, "status": "failed"}
    elif command == "quarantine":
        s["quarantined"] = True
    elif command == "release":
        s["quarantined"] = False
    elif command == "discard" and s["pending_since"] is not None and s["pending_since"] <= at:
        s["pending_since"] = None
    elif command == "reclaim" and s["token"] is not None:
        s |= {"pending_since": s["pending_since"] if s["pending_since"] is not None else s["claimed_at"], "claimed_at": None, "token": None, "status": "pending"}
    return s


EMPTY = {"pending_since": None, "claimed_at": None, "token": None, "attempts": 0, "status": "new", "quarantined": False}


def fold(commands: DataFrame) -> DataFrame:
    """commands: key, seq, command, at, token. The state of each key at the end; a key's commands pass one task in order, in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, dict(EMPTY)
        for pdf in frames:
            out = []
            for k, c, at, token in zip(pdf["key"], pdf["command"], pdf["at"], pdf["token"], strict=True):
                if k != key:
                    if key is not None:
                        out.append({"key": key, **state})
                    key, state = k, dict(EMPTY)
                state = step(state, c, float(at), token)
            yield pd.DataFrame(out, columns=["key", *STATE])
        if key is not None:
            yield pd.DataFrame([{"key": key, **state}])

    return commands.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, f"key string, {KINDS}")


def fold_stream(commands: DataFrame) -> DataFrame:
    """The same of a stream: after each batch the new state of each key that it touched."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = dict(zip(STATE, held.get, strict=True)) if held.exists else dict(EMPTY)
        for pdf in frames:
            for c, at, token in pdf.sort_values("seq")[["command", "at", "token"]].itertuples(index=False):
                state = step(state, c, float(at), token)
        held.update(tuple(state[c] for c in STATE))
        yield pd.DataFrame([{"key": key[0], **state}])

    return commands.groupBy("key").applyInPandasWithState(run, f"key string, {KINDS}", KINDS, "update", "NoTimeout")


def windowed_usage(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and mean values by type in windows of event time, for batches and streams."""
    at = F.col("ts").cast("timestamp")
    return events.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
