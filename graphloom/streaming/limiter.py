"""A sliding-window limiter: an event is allowed if fewer than a number of allowed events of its key came within the window before it.

Whether an event is allowed depends on what was allowed before, so each key is folded in order. A key's events are
folded in batches that Spark hands over in order, and only the allowed ones within the window are kept between them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted(events: DataFrame, most: int, window: int) -> DataFrame:
    """events: key, at, event_id. The same with allowed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, deque()
        for pdf in frames:
            out = []
            for k, at in zip(pdf["key"], pdf["at"], strict=True):
                if k != key:
                    key, held = k, deque()
                while held and held[0] <= at - window:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(at)
            yield pdf.assign(allowed=out)

    return events.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, "key string, at long, event_id long, allowed boolean")


def accepted_stream(events: DataFrame, most: int, window: int, late: str = "1 hour") -> DataFrame:
    """The same of a stream (key, at in microseconds, event_id, ts, the event time): a key's state is the times that were allowed and are still within the window.

    Events of a micro-batch are taken in order; a later micro-batch finds what was allowed before, also after a restart. The state of a key goes when the watermark is a window past its last event; events older than the watermark are left out by Spark."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for at in pdf["at"]:
            while held and held[0] <= at - window:
                held.popleft()
            out.append(len(held) < most)
            if out[-1]:
                held.append(at)
        state.update((list(held),))
        over = (int(pdf["at"].max()) + window) // 1000 + 1
        if over > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(over)
        yield pdf[["key", "at", "event_id"]].assign(allowed=out)

    keyed = events.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(run, "key string, at long, event_id long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
