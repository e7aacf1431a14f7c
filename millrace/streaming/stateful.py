"""Arbitrary state: running counts by key, forgotten after a time without events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_counts(events: DataFrame, key: str = "user_id", ttl_minutes: int = 60) -> DataFrame:
    """``key, events``: the count so far of each key that a batch touches; state goes after ``ttl_minutes`` without an event.

    Timeouts by the clock keep a query alive: start it with an interval, not with ``availableNow``.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        state.setTimeoutDuration(ttl_minutes * 60_000)
        yield pd.DataFrame({"key": [str(k[0])], "events": [n]})

    return events.groupBy(key).applyInPandasWithState(step, "key string, events long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
