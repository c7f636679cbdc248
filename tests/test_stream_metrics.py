from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import slo, snapshot
from ledgerflow.session import work_dir
from ledgerflow.streaming import alerts, ingest, metrics
from tests.conftest import collect
from tests.test_lakehouse import event, frame


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_stretches_do_not_depend_on_the_batches(cuts):
    draw = random.Random(cuts)
    slow = [m for m in range(400) if draw.random() < 0.8]
    want = [m for m in slow if m - 1 not in slow and all(m + i in slow for i in range(5))]
    fired, stretch = [], None
    for low in range(0, 400, 400 // cuts + 1):
        new, stretch = alerts.stretch_alerts(stretch, [m for m in slow if low <= m < low + 400 // cuts + 1], 5)
        fired += new
    assert fired == want and want


def test_alerts_of_a_stream_with_late_rows(spark):
    folder = work_dir(spark, "alerts")
    slow = {*range(3, 9), *range(20, 24), *range(40, 47)}
    rows = [(m, s, 9000.0 if m in slow else 10.0) for m in range(90) for s in range(0, 60, 10)]
    log = spark.createDataFrame(rows, "m long, s long, ms double").select(
        F.timestamp_seconds(F.lit(1_717_200_000) + F.col("m") * 60 + F.col("s")).alias("asked_at"), F.create_map(F.lit("synthesize"), F.col("ms")).alias("timings"), "m", "s"
    )
    # The last minutes before a cut come partly one delivery late, in no order.
    dealt = log.withColumn("delivery", F.floor(F.col("m") / 44) + F.when((F.col("m") % 44 > 36) & (F.col("s") % 20 == 0), 1).otherwise(0))
    for number in range(4):
        dealt.where(F.col("delivery") == number).select("asked_at", "timings").write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema("asked_at timestamp, timings map<string, double>").parquet(f"{folder}/log")
        alerts.raise_alerts(alerts.latency_alerts(stream, delay="20 minutes"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = collect(spark.read.parquet(f"{folder}/out"))
    assert found == collect(slo.latency_alerts(log)) and len(found) == 2


def test_listener_hears_every_batch(spark):
    folder, listener = work_dir(spark, "listener"), metrics.StageListener()
    spark.streams.addListener(listener)
    try:
        for first in (0, 10):
            spark.range(first, first + 10 + first).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema("id long").parquet(f"{folder}/in")
            query = ingest.ingest(metrics.observed(stream, F.col("id") % 4 == 0), f"{folder}/out", f"{folder}/checkpoint")
            query.awaitTermination()
            listener.wait_for(query.runId)
    finally:
        spark.streams.removeListener(listener)
    runs = listener.take(spark)
    assert collect(runs, "records_in", "records_out", "quarantined") == [(10, 7, 3), (20, 15, 5)]
    assert listener.take(spark).count() == 0
    with pytest.raises(TimeoutError):
        listener.wait_for("no such run", 0.1)


def test_counts_come_with_the_write(spark):
    events = frame(spark, [
        event("a1", "i1", 1, 1, amount="1"), event("a2", "i1", 5, 2, amount="2"), event("a1", "i1", 1, 1, amount="1"), event("d1", "i4", 1, 1, due=None), event("c1", "i3", 1, 1),
    ])
    base = work_dir(spark, "invoices")
    counts = snapshot.store_invoices(events, base)
    validated = snapshot.validate_invoices(snapshot.invoice_candidates(events))
    assert counts == snapshot.reconcile(events, validated).first().asDict()
    assert collect(snapshot.stored_invoices(spark, base, snapshot.CURATED)) == collect(snapshot.curated_invoices(validated))
    assert collect(snapshot.stored_invoices(spark, base, snapshot.QUARANTINED), "event_id") == [("d1",)]
