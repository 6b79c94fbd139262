"""Structured Streaming forms of the series operators. Input: a stream with an event time ``ts``; late rows are dropped at the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gap_sessions(stream: DataFrame, by: list[str], gap: str, late: str, measure: str) -> DataFrame:
    """Sessions as the watermark passes their end; rows exactly one gap apart belong together, as in the batch form."""
    rows = stream.withWatermark("ts", late)
    width = f"{gap} 1 microsecond" if "microsecond" not in gap else gap
    return rows.groupBy(F.session_window("ts", width), *by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max(measure).alias("peak"))


def cells(stream: DataFrame, by: list[str], cell: str, late: str, level: str, key: str) -> DataFrame:
    """The row of least ``level`` of every tumbling cell."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", cell), *by).agg(F.min_by(key, F.struct(level, "ts", key)).alias(key), F.min(level).alias(level))


def dedupe_onsets(stream: DataFrame, by: str, gap_us: int, late: str, strength: str) -> DataFrame:
    """Onsets less than ``gap_us`` after the kept one merge into it. State: the kept onset; a kept onset leaves when a later one is kept or the watermark passes it."""
    rows = stream.withWatermark("ts", late).select(by, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col(strength).cast("double").alias("strength"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(state.get)
            state.remove()
        else:
            rows = sorted((int(t), float(s)) for p in parts for t, s in zip(p["t_us"], p["strength"]))
            kept = list(state.get) if state.exists else None
            for t, s in rows:
                if kept is not None and t - kept[0] < gap_us:
                    kept[1] = max(kept[1], s)
                else:
                    if kept is not None:
                        out.append(tuple(kept))
                    kept = [t, s]
            if kept is not None:
                state.update(tuple(kept))
                state.setTimeoutTimestamp(max(kept[0] // 1000 + gap_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[by, "t_us", "strength"])

    kind = stream.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, t_us long, strength double", "t_us long, strength double", "append", GroupStateTimeout.EventTimeTimeout)
