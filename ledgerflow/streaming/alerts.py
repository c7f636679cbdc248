"""Latency alerts while the log streams in: minutes are closed by the watermark, and slow ones in a row raise an alert."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ledgerflow.operators.metrics import total_latency
from ledgerflow.operators.slo import QUERY_P95_MINUTES, QUERY_P95_MS

ALERT = "alert string, subject string, since timestamp"
#: Of the stretch of slow minutes that is open: its first and its last minute, in minutes since the epoch.
STRETCH = "first long, last long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_minutes(log: DataFrame, delay: str) -> DataFrame:
    """(subject, minute, p95) of every minute that no row can be added to any more; the percentile is a nearest rank."""
    timed = log.select("asked_at", total_latency(F.col("timings")).alias("latency_ms")).withWatermark("asked_at", delay)
    per_minute = timed.groupBy(F.window("asked_at", "1 minute")).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"))
    return per_minute.select(F.lit("all").alias("subject"), "window", F.col("window.start").alias("minute"), "p95")


def stretch_alerts(stretch: tuple[int, int] | None, slow: list[int], minutes: int) -> tuple[list[int], tuple[int, int] | None]:
    """(first minutes of the stretches that reach `minutes`, the stretch that stays open), given the slow minutes that are new, in order."""
    fired = []
    for minute in slow:
        first = stretch[0] if stretch and stretch[1] == minute - 1 else minute
        stretch = first, minute
        # Once: when the stretch gets as long as that.
        if minute - first == minutes - 1:
            fired.append(first)
    return fired, stretch


class SlowStretches(StatefulProcessor):
    """Carries the open stretch of slow minutes of a subject from batch to batch, as two numbers."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stretch = handle.getValueState("stretch", STRETCH)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = sorted(int(m) for frame in rows for m in frame["m"])
        known = self.stretch.get() if self.stretch.exists() else None
        fired, stretch = stretch_alerts(tuple(int(m) for m in known) if known else None, new, self.minutes)
        if stretch:
            self.stretch.update(stretch)
        if fired:
            yield pd.DataFrame({"alert": "query_p95", "subject": key[0], "since": pd.to_datetime([m * 60 for m in fired], unit="s")})

    def close(self) -> None:
        pass


def latency_alerts(log: DataFrame, *, delay: str, threshold_ms: float = QUERY_P95_MS, minutes: int = QUERY_P95_MINUTES) -> DataFrame:
    """Stream of the alerts that `slo.latency_alerts` gives for a whole log, as soon as the minute that completes one is closed.

    Minutes close in order, in one batch or in later ones. Rows that come later than `delay` behind the newest are left out of their minutes.
    """
    slow = closed_minutes(log, delay).where(F.col("p95") > threshold_ms)
    numbered = slow.select("subject", "window", (F.unix_seconds("minute") / 60).cast("long").alias("m"))
    return numbered.groupBy("subject").transformWithStateInPandas(
        statefulProcessor=SlowStretches(minutes), outputStructType=ALERT, outputMode="append", timeMode="None"
    )


def raise_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the alerts of what has arrived; their state needs the store that keeps it outside of the heap."""
    conf, name = alerts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STORE)
    try:
        return alerts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        conf.set(name, before) if before else conf.unset(name)
