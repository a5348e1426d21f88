"""Streams of timed events: windows, throttling and carried state, for batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(events: DataFrame, size: str, slide: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of overlapping windows; ``late`` is a watermark for streams."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def throttled(events: DataFrame, every: str, keys: list[str], late: str | None = None) -> DataFrame:
    """The last value of each key in each interval."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", every), *keys).agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return out.select(F.col("window.start").alias("start"), *keys, F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


def smoothed(events: DataFrame, s: float) -> DataFrame:
    """Exponential smoothing of each user's values over a stream, the last result carried from batch to batch."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        y = state.get[0] if state.exists else None
        out = []
        for v in pdf["value"]:
            y = v if y is None else (1 - s) * v + s * y
            out.append(y)
        state.update((float(y),))
        yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "smoothed": out})

    grouped = events.select("user_id", "event_id", "ts", "value").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, event_id long, smoothed double", "y double", "append", GroupStateTimeout.NoTimeout)
