"""Event stream -> latest invoice state and quarantine, batch by batch.

A batch only adds its own rows, so its cost does not depend on the size of the table; readers pick
the newest state of each invoice, and now and then the parts are folded into a whole version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerflow.operators import snapshot, upsert

KEYS = ["tenant_id", "invoice_id"]

# The columns that tell which of two states is newer. They stay in the stored table, because a
# batch sees only its own events and a late one must not replace a newer state.
ORDER = ("updated_at", "source_sequence", "emitted_at", "source_event_id")


def current_state(spark: SparkSession, silver: str) -> DataFrame:
    """The newest stored state of each invoice."""
    return upsert.last_per_key(upsert.read_published(spark, silver), KEYS, [F.col(c).desc() for c in ORDER])


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """Rejected events, once each however often they were delivered."""
    first = Window.partitionBy("event_id").orderBy("quarantined_at")
    rows = upsert.read_published(spark, quarantine)
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def fold(spark: SparkSession, silver: str, quarantine: str) -> None:
    """Write the current state and the distinct rejects as whole versions."""
    for rows, base in ((current_state(spark, silver), silver), (quarantined(spark, quarantine), quarantine)):
        version, _ = upsert.published(spark, base)
        upsert.publish(rows, base, version)


def apply_batch(events: DataFrame, batch_id: int, silver: str, quarantine: str, *, fold_every: int = 100) -> None:
    """Store the state and the rejects of one batch of bronze events; repeating a batch changes nothing."""
    spark = events.sparkSession
    last = upsert.published(spark, silver)
    if last and last[0] >= batch_id:
        return
    validated = snapshot.validate_invoices(snapshot.invoice_candidates(events)).persist()
    try:
        upsert.publish(snapshot.quarantined_invoices(validated), quarantine, batch_id, whole=False)
        curated = snapshot.curated_invoices(validated, "source_sequence", "emitted_at")
        upsert.publish(curated, silver, batch_id, whole=False)
    finally:
        validated.unpersist()
    if (batch_id + 1) % fold_every == 0:
        fold(spark, silver, quarantine)


def upsert_stream(bronze: DataFrame, silver: str, quarantine: str, checkpoint: str, *, fold_every: int = 100) -> StreamingQuery:
    return (
        bronze.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda events, batch_id: apply_batch(events, batch_id, silver, quarantine, fold_every=fold_every))
        .start()
    )
