"""Keyed claims with a fixed-origin time to live, as streaming state in RocksDB.

State per key is one time. A timer at the end of the claim, by the watermark, clears it, so keys that are not seen
again leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLAIMED = "t bigint, n bigint"
STATE = "claim"


class Claims(StatefulProcessor):
    """Hands on the rows of a key that make a claim: the first, then the first at least `width` microseconds later."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState(STATE, CLAIMED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # One row per arrival time, so a key with very many rows takes no more memory than it has times in a batch.
        first: dict[int, int] = {}
        for chunk in rows:
            for t, n in chunk.groupby("t")["n"].min().items():
                first[int(t)] = min(int(n), first.get(int(t), int(n)))
        held = self.claim.get()[0] if self.claim.exists() else None
        before, out = held, []
        for t in sorted(first):
            if held is None or t >= held + self.width:
                held = t
                out.append((key[0], first[t], t))
        if held is not None and held != before:
            self.claim.update((held, out[-1][1]))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max((held + self.width) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "n", "t"]).astype({"n": "int64", "t": "int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.claim.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "t": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def stream_claims(rows: DataFrame, key: str, at: str, order: str, ttl_seconds: float, delay: str = "1 hour") -> DataFrame:
    """First row per key and TTL: `key, order, at` of the rows that make a claim.

    Arrival time is the clock: a claim ends once its TTL has passed, its state is dropped once the watermark has, too.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    small = (
        rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("n"),
                    F.col(at).cast("timestamp").alias("at"))
        .withWatermark("at", delay).withColumn("t", F.unix_micros("at"))
    )
    claimed = small.groupBy("key").transformWithStateInPandas(
        Claims(int(ttl_seconds * 1_000_000)), "key string, n bigint, t bigint", "append", "eventTime"
    )
    return claimed.select(
        F.col("key").alias(key), F.col("n").alias(order), F.timestamp_micros("t").alias("claimed_at")
    )


def held_claims(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The claims that a stream holds now, read from its checkpoint: `key, claimed_at`."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.filter(F.col("value").isNotNull()).select(F.col("key.key").alias(key), F.timestamp_micros("value.t").alias("claimed_at"))


def stream_alerts(attempts: DataFrame, cooldown_seconds: float, delay: str = "1 hour") -> DataFrame:
    """Alerts to send: one per source and cool-down, restarted only by delivered ones."""
    usable = attempts.filter((F.col("source_id") != "") & F.col("delivered"))
    return stream_claims(usable, "source_id", "at", "attempt_id", cooldown_seconds, delay)
