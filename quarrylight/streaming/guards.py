"""The guards as streaming operators: state by key between micro-batches, decisions in event-time order within one."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.guards import Step


def stream_fold(events: DataFrame, guard: tuple[tuple, Step], name: str) -> DataFrame:
    """A stream of (key, t double, event_id, outcome) -> (key, event_id, name), as `operators.guards.fold` decides.

    Events of a key must reach the stream in order between micro-batches; within one they are sorted.
    """
    start, step = guard

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(parts)).sort_values(["t", "event_id"])
        now, out = (pickle.loads(state.get[0]) if state.exists else start), []
        for t, outcome in zip(group["t"], group["outcome"], strict=True):
            now, decision = step(now, t, outcome)
            out.append(decision)
        state.update((pickle.dumps(now),))
        yield pd.DataFrame({"key": group["key"], "event_id": group["event_id"], name: out})

    kind = events.schema["key"].dataType.simpleString()
    picked = events.select("key", "t", "event_id", "outcome")
    return picked.groupBy("key").applyInPandasWithState(run, f"key {kind}, event_id long, {name} boolean", "state binary", "append", GroupStateTimeout.NoTimeout)
