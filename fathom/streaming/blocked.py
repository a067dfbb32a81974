"""Blocked sessions as keyed state: one value a session in the state store, a change published when a session is blocked or becomes clean, and a timer that
forgets sessions that no turn follows.

State is bounded by the sessions seen within `forget`; no earlier batch is read again. After a restart the query goes on from its checkpoint. Needs the RocksDB state store
(`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times as microseconds, so that no zone comes between the state and the rows.
STATE = "at long, verdict string, violations array<string>"
CHANGE = "sessionId string, at long, change string, violations array<string>"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BlockedSessions(StatefulProcessor):
    """The newest turn decides; at one time a blocked one, then the one with the greater list of violations. Turns older than what is known change nothing."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        order = lambda r: (r[0], r[1] == "blocked", list(r[2] or []))
        newest = max(((r["at"], r["verdict"], r["violations"]) for r in rows if r["at"] is not None), key=order, default=None)
        if newest is None or before is not None and order(newest) <= order(before):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(newest)
        self.handle.registerTimer(max(newest[0] // 1000 + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1))
        was, now = before is not None and before[1] == "blocked", newest[1] == "blocked"
        if now or was:
            yield Row(sessionId=key[0], at=newest[0], change="blocked" if now else "cleared", violations=newest[2] if now else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            at, verdict, _ = self.last.get()
            self.last.clear()
            if verdict == "blocked":
                yield Row(sessionId=key[0], at=at, change="forgotten", violations=[])

    def close(self) -> None:
        pass


def blocked_changes(turns: DataFrame, late: str = "1 hour", forget_hours: int = 24 * 30) -> DataFrame:
    """A stream of turns (sessionId, ts, verdict, violations) -> the changes (sessionId, ts, change: blocked, cleared or forgotten, violations)."""
    rows = turns.filter("sessionId IS NOT NULL").select("sessionId", "ts", F.unix_micros("ts").alias("at"), "verdict", "violations").withWatermark("ts", late)
    out = rows.groupBy("sessionId").transformWithState(statefulProcessor=BlockedSessions(forget_hours * 3_600_000), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")
    return out.select("sessionId", F.timestamp_micros("at").alias("ts"), "change", "violations")


def blocked_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(sessionId, ts, violations) of the sessions that are blocked, read from the state itself as of the last batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return state.select("key.sessionId", "value.*").filter("verdict = 'blocked'").select("sessionId", F.timestamp_micros("at").alias("ts"), "violations")
