"""Lives of topics on a stream: decayed popularity while works arrive, death after silence, by keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000

LIVES = "topic string, started timestamp, latest timestamp, works long, popularity double, alive boolean, recent_days array<int>"


def needs_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TopicLives(StatefulProcessor):
    """One life at a time for each topic: its numbers, the days of its latest works, and a timer at the end of silence.

    A row adds what is left of it at the life's latest time, so rows may come in
    any order within the watermark. A gap of more than ``silent_days`` between
    rows of one batch ends a life as the timer would have: what is told does
    not depend on how rows fall into batches.
    """

    def __init__(self, half_life_days: float, silent_days: int, keep_days: int):
        self.half_life, self.silent, self.keep = half_life_days, silent_days * DAY_MS, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "started long, latest long, works long, popularity double")
        self.days = handle.getListState("days", "day int")

    def _row(self, topic: str, life: tuple, days: list[int], alive: bool) -> dict:
        started, latest, works, popularity = life
        return {"topic": topic, "started": pd.Timestamp(started, unit="ms"), "latest": pd.Timestamp(latest, unit="ms"), "works": works, "popularity": popularity, "alive": alive, "recent_days": days}

    def _forget(self) -> None:
        self.life.clear()
        self.days.clear()
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        topic, out = key[0], []
        life = tuple(self.life.get()) if self.life.exists() else None
        days = sorted(d[0] for d in self.days.get())
        # A batch of one topic is held as numbers only.
        for ms in sorted(t for batch in rows for t in batch["at_ms"].tolist()):
            if life is not None and ms > life[1] + self.silent:
                out.append(self._row(topic, life, days, False))
                life, days = None, []
            if life is None:
                life = (ms, ms, 1, 1.0)
            else:
                started, latest, works, popularity = life
                newest = max(latest, ms)
                popularity = popularity * 0.5 ** ((newest - latest) / DAY_MS / self.half_life) + 0.5 ** ((newest - ms) / DAY_MS / self.half_life)
                life = (min(started, ms), newest, works + 1, popularity)
            day = ms // DAY_MS
            days = sorted(d for d in {*days, day} if d > life[1] // DAY_MS - self.keep)
        self._forget()
        self.life.update(life)
        if days:
            self.days.put([(d,) for d in days])
        self.handle.registerTimer(max(life[1] + self.silent, timerValues.getCurrentWatermarkInMs() + 1))
        out.append(self._row(topic, life, days, True))
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.life.exists():
            return
        life = tuple(self.life.get())
        if expiredTimerInfo.getExpiryTimeInMs() >= life[1] + self.silent:
            days = sorted(d[0] for d in self.days.get())
            self._forget()
            yield pd.DataFrame([self._row(key[0], life, days, False)])

    def close(self) -> None:
        pass


def topic_lives(events: DataFrame, at: str, topic: str, late: str, half_life_days: float, silent_days: int, keep_days: int = 7) -> DataFrame:
    """Changes of topics' lives (update mode): the numbers after each batch, and a row with ``alive`` false when a life ends.

    A life ends once the watermark passes ``silent_days`` after its latest row;
    its state goes with it. Later rows begin a new life. Rows behind the
    watermark, and rows without time, are dropped; a null topic is one of its own.
    State is a few numbers and at most ``keep_days`` days a topic.
    """
    needs_rocksdb(events.sparkSession)
    timed = events.where(F.col(at).isNotNull()).withWatermark(at, late).select(F.col(topic).cast("string").alias("topic"), at, F.unix_millis(at).alias("at_ms"))
    return timed.groupBy("topic").transformWithStateInPandas(statefulProcessor=TopicLives(half_life_days, silent_days, keep_days), outputStructType=LIVES, outputMode="Update", timeMode="EventTime")


def last_told(changes: DataFrame) -> DataFrame:
    """The last change of each life: more works come later, the end comes last."""
    order = F.struct("works", (~F.col("alive")).alias("ended"), "latest")
    rest = F.struct("latest", "works", "popularity", "alive", "recent_days")
    return changes.groupBy("topic", "started").agg(F.max_by(rest, order).alias("x")).select("topic", "started", "x.*")
