"""Incremental forms of tracked state on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_DAYS = 60


def first_seen(stream: DataFrame, key: list[str], at: str | None = None, watermark: str = "400 days") -> DataFrame:
    """Insert-if-new over a stream: rows of known keys do not come again.

    Without `at` a key is known for ever, and state grows with the keys. With it (event time) a key is forgotten once the
    watermark has passed its first row by as much: the range that a search is repeated over must be shorter.
    """
    return stream.dropDuplicates(key) if at is None else stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(key)


def lifecycle(events: DataFrame, key: str, what: str, at: str, idle_days: int = IDLE_DAYS, watermark: str = "1 day") -> DataFrame:
    """(key, state, at) whenever the state of a key moves. events: what is close, restart or change; silence makes it stalled.

    abierta -> cerrada (close), reiniciada (restart), parada (no event for idle_days); parada -> abierta (change).
    cerrada and reiniciada are final. The timer is event time: it goes off when the watermark passes.
    """
    schema = f"`{key}` long, state string, at timestamp"

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else ("", None)
        out = []
        if state.hasTimedOut:
            if now == "abierta":
                now = "parada"
                out.append((keys[0], now, pd.Timestamp(last, unit="ms") + pd.Timedelta(days=idle_days)))
                state.update((now, last))
        else:
            rows = pd.concat(list(frames)).sort_values([at, what])
            for kind, when in zip(rows[what], rows[at], strict=True):
                ms = int(pd.Timestamp(when).timestamp() * 1000)
                after = now
                if now not in ("cerrada", "reiniciada"):
                    if now == "abierta" and last is not None and ms - last > idle_days * 86_400_000:
                        out.append((keys[0], "parada", pd.Timestamp(last, unit="ms") + pd.Timedelta(days=idle_days)))
                        now = "parada"
                    after = {"close": "cerrada", "restart": "reiniciada"}.get(kind, "abierta")
                if after != now:
                    out.append((keys[0], after, when))
                now, last = after, max(ms, last or ms)
            state.update((now, last))
            if now == "abierta":
                state.setTimeoutTimestamp(max(last + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "state", "at"])

    watched = events.select(key, what, at).withWatermark(at, watermark)
    return watched.groupBy(key).applyInPandasWithState(fold, schema, "state string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def changes(readings: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, before, after) whenever a reading of a key differs from the last one; the first reading is no change."""

    def differ(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        known, before = (True, state.get[0]) if state.exists else (False, None)
        for now in pd.concat(list(frames)).sort_values(order)[value]:
            now = None if pd.isna(now) else now
            if known and now != before:
                out.append((keys[0], before, now))
            known, before = True, now
        state.update((before,))
        if out:
            yield pd.DataFrame(out, columns=[key, "before", "after"])

    return readings.select(key, F.col(value).cast("string").alias(value), order).groupBy(key).applyInPandasWithState(differ, f"`{key}` long, before string, after string", "value string", "append", GroupStateTimeout.NoTimeout)


def append_history(stream: DataFrame, path: str, checkpoint: str):
    """Write changes; a batch that is run again replaces what it wrote before, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
