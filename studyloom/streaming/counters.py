"""Structured Streaming forms: running counters, one delivery of each row, windows over late data, admission by a rolling quota."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.schemas import COUNTER_KEY


def running_counters(graded: DataFrame) -> DataFrame:
    """Counters of graded answers in update mode; state is one pair of numbers for each key."""
    return graded.groupBy(*COUNTER_KEY).agg(
        F.sum(F.col("is_correct").cast("int")).alias("correct_count"), F.count(F.lit(1)).alias("total_count")
    )


def delivered_once(rows: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Drops rows sent again within the delay; older keys leave the state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, time: str, width: str = "1 day", slide: str = "1 hour", delay: str = "2 hours", *keys: str) -> DataFrame:
    """Counts in sliding windows; rows later than the delay are dropped."""
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, width, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("w.start", "w.end", *keys, "n")
    )


def sessions(rows: DataFrame, time: str, gap: str, delay: str, *keys: str) -> DataFrame:
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("w.start", "w.end", *keys, "n")
    )


def admitted(requests: DataFrame, limit: int = 10, width_s: int = 86_400, delay: str | None = None) -> DataFrame:
    """user_id, at, ok for each request (user_id, at): refused where the user was admitted `limit` times within the width before it.

    Refused requests don't count, so it is a fold over each user's own times; the state is at most `limit` times for each user. With a `delay` it
    leaves when the watermark (so far behind the latest request) has passed them all by the width, and later rows are dropped; without one it stays."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            ok = []
            times = sorted(frame["at"].astype("int64") // (10**9 if str(frame["at"].dtype).startswith("datetime64[ns") else 10**6))
            for t in times:
                kept = [x for x in kept if x > t - width_s]
                ok.append(len(kept) < limit)
                if ok[-1]:
                    kept.append(int(t))
            yield pd.DataFrame({"user_id": key[0], "at_s": times, "ok": ok})
        over = (max(kept, default=0) + width_s) * 1000
        if delay and over <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            return
        state.update((kept,))
        if delay:
            state.setTimeoutTimestamp(over)

    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    rows = requests.withWatermark("at", delay) if delay else requests
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id string, at_s long, ok boolean", "kept array<long>", "append", timeout)


def admitted_batch(requests: DataFrame, limit: int = 10, width_s: int = 86_400) -> DataFrame:
    """The same over a whole table."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        ok = []
        times = sorted(frame["at_s"])
        for t in times:
            kept = [x for x in kept if x > t - width_s]
            ok.append(len(kept) < limit)
            if ok[-1]:
                kept.append(t)
        return pd.DataFrame({"user_id": key[0], "at_s": times, "ok": ok})

    return requests.groupBy("user_id").applyInPandas(fold, "user_id string, at_s long, ok boolean")
