"""Rules that fire on silence: timers in event time over keyed state that expires.

A rule watches the events that meet its condition. When a key that has had such an event has no other for the
rule's time, the rule fires for it once; the next event begins anew. State is one time a (rule, key), kept only
while its timer runs, so keys that fell silent cost nothing. Time is that of the events: a stream that is run
late, stopped and resumed, or replayed fires the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Silence:
    """``condition``: SQL over the events' columns; ``seconds`` without another one fire the rule."""

    rule_id: str
    condition: str
    seconds: int


class _Watch(StatefulProcessor):
    """State: the last time in microseconds; one timer at the time of firing."""

    def __init__(self, seconds: dict[str, int]):
        self.gap = {k: v * 1_000_000 for k, v in seconds.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gap, fired = self.gap[key[0]], []
        times = sorted(t for pdf in rows for t in pdf["us"].tolist())
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(_due(last + gap))
        for t in times:
            if last is not None and t > last + gap:
                fired.append(last)
            last = t if last is None else max(last, t)
        self.last.update((last,))
        self.handle.registerTimer(_due(last + gap))
        yield self._told(key, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = []
        if self.last.exists():
            fired = [self.last.get()[0]]
            self.last.clear()
        yield self._told(key, fired)

    def _told(self, key, fired: list[int]) -> pd.DataFrame:
        text = lambda v: pd.Series([v] * len(fired), dtype=object)
        return pd.DataFrame({"rule_id": text(key[0]), "key": text(key[1]), "last_us": pd.Series(fired, dtype="int64"), "fired_us": pd.Series([x + self.gap[key[0]] for x in fired], dtype="int64")})

    def close(self) -> None:
        pass


def _due(us: int) -> int:
    """The first millisecond that is not before ``us``."""
    return -(-us // 1000)


def silences(events: DataFrame, rules: list[Silence], key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """(rule_id, key, last_at, fired_at) as a stream (append mode) of a stream of events.

    Null keys and times take no part. The session's state store must be RocksDB (``run_silences`` sees to it).
    """
    met = F.filter(F.array(*[F.when(F.coalesce(F.expr(r.condition), F.lit(False)), F.lit(r.rule_id)) for r in rules]), lambda x: x.isNotNull())
    own = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    rows = own.select(F.explode(met).alias("rule_id"), F.col(key).cast("string").alias("key"), F.unix_micros("_at").alias("us"), "_at")
    told = rows.groupBy("rule_id", "key").transformWithStateInPandas(_Watch({r.rule_id: r.seconds for r in rules}), "rule_id string, key string, last_us long, fired_us long", "append", "eventTime")
    return told.select("rule_id", "key", F.timestamp_micros("last_us").alias("last_at"), F.timestamp_micros("fired_us").alias("fired_at"))


def run_silences(events: DataFrame, rules: list[Silence], key: str, at: str, log_path: str, checkpoint: str, late: str = "10 minutes"):
    """Runs the rules over all that the stream has, appends what fires to the log, each batch once; returns the started query."""
    from kbspark.sinks.notes import append_jsonl

    spark, stream = events.sparkSession, hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, _ROCKS)
    try:
        # Lines of a log keep milliseconds only; as text all digits stay.
        text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
        told = silences(events, rules, key, at, late).select("rule_id", "key", text("last_at"), text("fired_at"))
        return told.writeStream.foreachBatch(lambda batch, epoch: append_jsonl(batch, log_path, f"{stream}-{epoch:012d}") and None).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        # A started query keeps the settings it was started with.
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)
