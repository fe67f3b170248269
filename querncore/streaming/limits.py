"""Streaming forms of the stateful operators. Watermarks and event-time windows are an extension: the tables they replace have none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_event_limit(stream: DataFrame, key: str, ts: str, tie: str, seconds: float, limit: int, delay: str = "10 minutes") -> DataFrame:
    """The rate limit whose window opens at a key's first event: key, tie, ts, n, allowed. State: a window's end and its count, dropped by the
    watermark when the window is over."""
    key_type, tie_type = (stream.schema[c].dataType.simpleString() for c in (key, tie))

    def walk(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        out = []
        for t, i in zip(rows[ts], rows[tie]):
            at = t.timestamp()
            if at >= reset:
                reset, n = at + seconds, 0
            n += 1
            out.append((k[0], i, t, n, n <= limit))
        state.update((reset, n))
        state.setTimeoutTimestamp(max(int(reset * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, tie, ts, "n", "allowed"])

    out = f"{key} {key_type}, {tie} {tie_type}, {ts} timestamp, n long, allowed boolean"
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.groupBy(key).applyInPandasWithState(walk, out, "reset double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_metrics(stream: DataFrame, ts: str, by: list[str], value: str, size: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums over tumbling or sliding event-time windows, late rows within the delay included."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", "window.end", *by, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key: start, end, n."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")
