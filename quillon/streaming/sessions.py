"""The keyed state store as a Structured Streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.state import TTL_SECONDS


def keep_latest(events: DataFrame, key: str, at: str, payload: str, ttl_seconds: int = TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """One update ``(key, at, payload, n_seen, status)`` per key and batch; the state is dropped ``ttl_seconds`` after its newest event.

    Late events beyond ``delay`` are ignored, earlier events never replace newer ones, expiry follows the watermark and is reported once as status 'expired'.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            made, value, n = state.get
            state.remove()
            yield pd.DataFrame([(group[0], pd.Timestamp(made, unit="us"), value, n, "expired")], columns=["key", "at", "payload", "n_seen", "status"])
            return
        made, value, n = state.get if state.exists else (-1, None, 0)
        for pdf in batches:
            for t, v in pdf.sort_values(["_us", "payload"])[["_us", "payload"]].itertuples(index=False, name=None):
                n += 1
                if t >= made:
                    made, value = int(t), v
        state.update((made, value, n))
        state.setTimeoutTimestamp(max(made // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(group[0], pd.Timestamp(made, unit="us"), value, n, "stored")], columns=["key", "at", "payload", "n_seen", "status"])

    rows = events.withWatermark(at, delay).select(F.col(key).cast("string").alias("key"), F.col(at), F.unix_micros(at).alias("_us"), F.col(payload).cast("string").alias("payload"))
    return rows.groupBy("key").applyInPandasWithState(
        update, "key string, at timestamp, payload string, n_seen long, status string", "made long, value string, n long", "update", GroupStateTimeout.EventTimeTimeout
    )


def windowed_counts(events: DataFrame, at: str, by: list[str], window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Extension: counts per time window, closed by the watermark."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
