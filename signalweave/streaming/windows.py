"""Structured Streaming: windowed counts behind a watermark, decayed topic state, idempotent sinks.

The batch series are the reference of meaning; these keep them up to date on a
stream. A watermark plays the role of the strict cutoff: a window is emitted
once no row can reach it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, topic: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Closed windows' counts per topic (append mode)."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), topic).agg(F.count("*").alias("works")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), topic, "works")


def session_counts(events: DataFrame, at: str, topic: str, gap: str, late: str) -> DataFrame:
    """Bursts of a topic that end after ``gap`` of silence."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), topic).agg(F.count("*").alias("works")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), topic, "works")


def live_popularity(events: DataFrame, at: str, topic: str, late: str, half_life_days: float, silent_days: int) -> DataFrame:
    """Decayed popularity per topic as events arrive; a topic that is silent for too long is reported dead and forgotten.

    Exponential decay is additive, so a late row is added with what is left of it
    and the state does not depend on the order of arrival. State is one small
    tuple a topic: popularity at its latest time, that time, rows seen.
    """
    schema = f"{topic} string, at timestamp, popularity double, works long, alive boolean"
    day_ms = 86_400_000

    def row(key: tuple, p: float, ms: int, n: int, alive: bool) -> pd.DataFrame:
        return pd.DataFrame({topic: [key[0]], "at": [pd.Timestamp(ms, unit="ms")], "popularity": [p], "works": [n], "alive": [alive]})

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            p, ms, n = state.get
            state.remove()
            yield row(key, p, ms, n, False)
            return
        p, ms, n = state.get if state.exists else (0.0, None, 0)
        for batch in batches:
            times = batch["at_ms"].to_numpy()
            latest = int(times.max()) if ms is None else max(ms, int(times.max()))
            if ms is not None:
                p *= 0.5 ** ((latest - ms) / day_ms / half_life_days)
            p += float((0.5 ** ((latest - times) / day_ms / half_life_days)).sum())
            ms, n = latest, n + len(times)
        state.update((p, ms, n))
        if (edge := ms + silent_days * day_ms) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(edge)
        yield row(key, p, ms, n, True)

    timed = events.withWatermark(at, late).select(F.col(topic).cast("string").alias(topic), at, F.unix_millis(at).alias("at_ms"))
    return timed.groupBy(topic).applyInPandasWithState(advance, schema, "popularity double, at long, works long", "append", GroupStateTimeout.EventTimeTimeout)


def append_once(path: str, key: str = "content_sha256"):
    """A foreachBatch function that appends each content hash once, however often a batch is replayed."""
    from signalweave.sources.publications import append_new

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, path, key)

    return write
