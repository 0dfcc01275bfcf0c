"""The suppress flag of a live session: a marker silences audio until the session is reset.

batch_state() is the batch twin of the streaming operator: over the same events both give
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dispatch(kind: Column, routes: dict[str, str], default: str = "ignored") -> Column:
    """The route of an event type."""
    out = F.lit(default)
    for name, route in routes.items():
        out = F.when(kind == name, route).otherwise(out)
    return out


def chunks(length: Column, size: int) -> Column:
    """Array of (start, length) of the chunks that `length` bytes are sent in."""
    n = F.ceil(length / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i * size).alias("start"), F.least(F.lit(size), length - i * size).alias("length")))


def batch_state(events: DataFrame, key: str, order, sets: Column, resets: Column) -> DataFrame:
    """suppressed: whether the last setting or resetting event before this one of the key set the flag."""
    flag = F.when(sets, True).when(resets, False)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_flag", flag)
    return rows.withColumn("suppressed", F.coalesce(F.last("_flag", ignorenulls=True).over(before), F.lit(False))).drop("_flag")


def stream_state(events: DataFrame, key: str, order: list[str], kind: str, sets: str, resets: str) -> DataFrame:
    """The same over a stream; a key's state is one boolean. Events of a key come in order within a batch's trigger.

    Returns key, the order columns, kind and suppressed.
    """
    fields = [key, *order, kind]
    schema = ", ".join(f"`{c}` {t}" for c, t in events.select(*fields).dtypes)

    def advance(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for k in rows[kind]:
            out.append(held)
            held = True if k == sets else False if k == resets else held
        state.update((held,))
        yield rows[fields].assign(suppressed=out)

    grouped = events.select(*fields).groupBy(key)
    return grouped.applyInPandasWithState(advance, schema + ", suppressed boolean", "held boolean", "append", GroupStateTimeout.NoTimeout)


def with_timeout(responses: DataFrame, seconds: float = 30.0) -> DataFrame:
    """A turn that took longer than the limit answers [TIMEOUT], which counts as triggered."""
    return responses.withColumn("response", F.when(F.col("waited") > seconds, "[TIMEOUT]").otherwise(F.col("response")))


def stream_timeouts(events: DataFrame, key: str, kind: str, starts: str, ends: str, at: str, seconds: float = 30.0) -> DataFrame:
    """Per key and turn of a stream: its response, or [TIMEOUT] once event time passes its start by the limit.

    events need a watermark on `at` (a timestamp) and a column response. A key has one open turn at a
    time; a turn that answers late has timed out by then. Returns key, start and response.
    """
    schema = f"`{key}` {dict(events.dtypes)[key]}, start timestamp, response string"
    limit = int(seconds * 1000)

    def advance(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        begun = state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append((who[0], pd.Timestamp(begun, unit="ms"), "[TIMEOUT]"))
            begun = None
        else:
            rows = pd.concat(list(frames)).sort_values(at)
            for k, t, response in zip(rows[kind], rows[at], rows["response"], strict=True):
                now = int(t.timestamp() * 1000)
                if k == starts:
                    if begun is not None:
                        out.append((who[0], pd.Timestamp(begun, unit="ms"), "[TIMEOUT]"))
                    begun = now
                elif k == ends and begun is not None:
                    out.append((who[0], pd.Timestamp(begun, unit="ms"), response if now - begun <= limit else "[TIMEOUT]"))
                    begun = None
        if begun is None:
            if state.exists:
                state.remove()
        else:
            state.update((begun,))
            state.setTimeoutTimestamp(max(begun + limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "start", "response"])

    grouped = events.select(key, kind, at, "response").groupBy(key)
    return grouped.applyInPandasWithState(advance, schema, "begun long", "append", GroupStateTimeout.EventTimeTimeout)
