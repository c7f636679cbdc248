"""Stage metrics of running streams: what each micro-batch took in, passed on and rejected, as Spark counts it on the way."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: The name under which a stream's counts are observed.
OBSERVED = "stage"
RUNS = "run_id string, stage string, records_in long, records_out long, quarantined long, duration_ms double"


def observed(rows: DataFrame, rejected: Column) -> DataFrame:
    """The same rows, counted as they pass."""
    refused = F.count_if(F.coalesce(rejected, F.lit(False)))
    return rows.observe(OBSERVED, F.count(F.lit(1)).alias("records_in"), refused.alias("quarantined"))


class StageListener(StreamingQueryListener):
    """Keeps a run of a data stage for every batch of the observed queries until it is taken.

    A batch that is repeated after a failure replaces its earlier run, so runs stay one per batch.
    """

    def __init__(self):
        self._runs: dict[tuple[str, int], tuple] = {}
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        counts = progress.observedMetrics.get(OBSERVED)
        if counts is None or not counts["records_in"]:
            return
        run = (
            f"{progress.name or progress.id}_{progress.batchId}", str(progress.name or progress.id), counts["records_in"],
            counts["records_in"] - counts["quarantined"], counts["quarantined"], float(progress.durationMs.get("triggerExecution", 0)),
        )
        with self._changed:
            self._runs[str(progress.id), progress.batchId] = run

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait_for(self, run_id: str, seconds: float = 60) -> None:
        """Until the events of a run that has ended are in."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(run_id) in self._ended, seconds):
                raise TimeoutError(f"no end of run {run_id}")

    def take(self, spark: SparkSession) -> DataFrame:
        """The runs so far, which are then forgotten; `operators.metrics.stage_metrics` makes metrics of them."""
        with self._changed:
            rows = [self._runs[k] for k in sorted(self._runs)]
            self._runs.clear()
        return spark.createDataFrame(rows, RUNS)
