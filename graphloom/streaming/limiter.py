"""Request limits per principal: a fixed window that starts at the principal's first request, and a token bucket.

Both are folds over a principal's requests in order. The batch form folds each principal's sorted rows
in a stream of batches (state for one principal at a time); the streaming form keeps the same state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_window(requests: int, seconds: float) -> Callable:
    """A step (state, time) -> (state, admitted): a window begins with the first request after the last one ended."""

    def step(state: tuple | None, now: float) -> tuple[tuple, bool]:
        if state is None or now - state[0] >= seconds:
            state = (now, 0)
        admitted = state[1] < requests
        return (state[0], state[1] + admitted), bool(admitted)

    return step


def token_bucket(requests: int, seconds: float, burst: float, cost: float = 1.0) -> Callable:
    """A step (state, time) -> (state, admitted): tokens flow in at requests / seconds up to the burst; refused calls move the clock too."""

    def step(state: tuple | None, now: float) -> tuple[tuple, bool]:
        tokens = burst if state is None else min(burst, state[1] + (now - state[0]) * requests / seconds)
        admitted = tokens + 1e-12 >= cost
        return (now, tokens - cost if admitted else tokens), admitted

    return step


def limit(events: DataFrame, step: Callable, key: str = "user_id", time: str = "at", order: str = "event_id") -> DataFrame:
    """``events`` (key, order, time in seconds) with ``admitted``. A principal of any size is folded row by row."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            admitted = []
            for who, now in zip(frame[key], frame[time], strict=True):
                if who != last:
                    last, state = who, None
                state, ok = step(state, now)
                admitted.append(ok)
            yield frame.assign(admitted=admitted)

    rows = events.select(key, order, time)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", admitted boolean"
    return rows.repartition(key).sortWithinPartitions(key, time, order).mapInPandas(fold, schema)


def limit_stream(events: DataFrame, step: Callable, key: str = "user_id", time: str = "at", order: str = "event_id") -> DataFrame:
    """The same over a stream: (key, order, admitted) for each request, in order within a micro-batch."""

    def fold(who: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else None
        frame = pd.concat(list(frames)).sort_values([time, order])
        admitted = []
        for now in frame[time]:
            state, ok = step(state, now)
            admitted.append(ok)
        if state is not None:
            held.update((float(state[0]), float(state[1])))
        yield pd.DataFrame({key: frame[key], order: frame[order], "admitted": admitted})

    return events.groupBy(key).applyInPandasWithState(
        fold, f"{key} long, {order} long, admitted boolean", "at double, level double", "append", GroupStateTimeout.NoTimeout
    )
