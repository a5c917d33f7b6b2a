"""Streams: early stop on repeated outputs, and counts per window of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def repetition_alerts(stream: DataFrame, key: str, order: list[str], content: str, window: int) -> DataFrame:
    """Rows (key, stop_at) once per key: the position at which its last ``window`` contents were equal.

    State per key is the last content, its streak, the rows so far and whether it has stopped. Rows of a micro-batch
    are taken in ``order``; rows that arrive in later batches come after.
    """
    kind = dict(stream.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak, seen, stopped = state.get if state.exists else (None, 0, 0, False)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        found = []
        for value in rows[content]:
            seen += 1
            streak = streak + 1 if value == last else 1
            last = value
            if streak >= window > 0 and not stopped:
                stopped = True
                found.append(seen)
        state.update((last, streak, seen, stopped))
        yield pd.DataFrame({key: [keys[0]] * len(found), "stop_at": pd.Series(found, dtype="int64")})

    held = stream.select(key, *order, content)
    return held.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, stop_at long", f"last {kind[content]}, streak long, seen long, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def window_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per window of time and group, with a watermark."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
