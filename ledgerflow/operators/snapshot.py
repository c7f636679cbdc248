"""Change events -> latest state per entity.

Both ranks keep one row per key. Catalyst turns `row_number() = 1` into a group limit that runs
before the shuffle, so a key that holds a third of the events still sends at most one row per
map partition to the reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas
from ledgerflow.operators import quality

# The payload fields of an invoice event.
INVOICE_PAYLOAD = (
    "customer_id", "engagement_id", "invoice_number", "invoice_amount", "currency", "status", "due_date", "invoice_date",
)


def _keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order if c in rows.columns])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def dedup_events(events: DataFrame) -> DataFrame:
    """Keep the copy of each event that was emitted last."""
    return _keep_first(events, ["event_id"], ["emitted_at", "source_sequence", "offset"])


def latest_state(events: DataFrame) -> DataFrame:
    """Keep the newest event of each entity; arrival order does not matter."""
    return _keep_first(events, ["tenant_id", "entity_id"], ["updated_at", "source_sequence", "emitted_at", "event_id"])


def extract_payload(events: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Add the payload fields as text.

    `inline` makes the parse a generator: later filters on the fields are not pushed below it, where
    every reference to a field would parse the payload again.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return events.select("*", F.inline(F.array(F.from_json("payload_json", schema))))


def invoice_candidates(events: DataFrame) -> DataFrame:
    """The latest event of each invoice with raw and typed payload fields side by side."""
    latest = latest_state(dedup_events(events.where(F.col("entity_name") == "invoice")))
    return type_invoice_payload(latest)


def type_invoice_payload(events: DataFrame) -> DataFrame:
    """Every payload field; one with a type of its own also keeps its raw text."""
    columns = []
    for name in INVOICE_PAYLOAD:
        kind = schemas.SILVER_INVOICES[name].dataType.simpleString()
        columns += [name] if kind == "string" else [F.col(name).alias(f"raw_{name}"), F.col(name).try_cast(kind).alias(name)]
    envelope = ("event_id", "batch_id", "payload_json", "updated_at", "emitted_at", "source_sequence")
    return extract_payload(events, INVOICE_PAYLOAD).select(
        "tenant_id", F.col("entity_id").alias("invoice_id"), *envelope, *columns, (F.col("op") == "delete").alias("is_deleted")
    )


def validate_invoices(candidates: DataFrame, *, validate_deletes: bool = True) -> DataFrame:
    """Candidates with quality codes; deletes are held to the same rules unless switched off."""
    annotated = quality.annotate(candidates, quality.invoice_rules())
    if validate_deletes:
        return annotated
    none = F.array().cast("array<string>")
    return annotated.withColumn("quality_errors", F.when(F.col("is_deleted"), none).otherwise(F.col("quality_errors")))


CURATED, QUARANTINED = "curated", "quarantined"


def curated_invoices(validated: DataFrame, *extra: str) -> DataFrame:
    """Valid candidates in the silver layout, followed by any extra columns asked for."""
    rows = quality.split(validated)[0].withColumns({"source_event_id": F.col("event_id"), "source_batch_id": F.col("batch_id")})
    return rows.select(*schemas.SILVER_INVOICES.fieldNames(), *extra)


def quarantined_invoices(validated: DataFrame, quarantined_at=None) -> DataFrame:
    """Rejected candidates in the quarantine layout."""
    rows = quality.split(validated)[1].withColumn("quarantined_at", F.current_timestamp() if quarantined_at is None else quarantined_at)
    return rows.select(*schemas.QUARANTINED_INVOICES.fieldNames())


def entity_snapshot(events: DataFrame, entity: str, key: str, fields: tuple[str, ...], required: tuple[str, ...] = ()) -> DataFrame:
    """Latest state of any entity: key, payload fields as text, lineage; incomplete rows are left out."""
    latest = latest_state(dedup_events(events.where(F.col("entity_name") == entity)))
    rows = extract_payload(latest, fields).select(
        "tenant_id",
        F.col("entity_id").alias(key),
        *fields,
        "updated_at",
        F.col("event_id").alias("source_event_id"),
        F.col("batch_id").alias("source_batch_id"),
        (F.col("op") == "delete").alias("is_deleted"),
    )
    rules = [quality.missing(f) for f in ("tenant_id", key, *required)]
    return quality.split(quality.annotate(rows, rules))[0].drop("quality_errors")


def reconcile(events: DataFrame, validated: DataFrame) -> DataFrame:
    """One row of counts: raw events, candidates, curated, quarantined."""
    raw = events.where(F.col("entity_name") == "invoice").select(F.lit("raw").alias("stage"))
    outcome = F.when(F.size("quality_errors") == 0, "curated").otherwise("quarantined")
    staged = raw.unionByName(validated.select(outcome.alias("stage")))
    return staged.agg(
        F.count_if(F.col("stage") == "raw").alias("raw_input"),
        F.count_if(F.col("stage") != "raw").alias("candidates"),
        F.count_if(F.col("stage") == "curated").alias("curated"),
        F.count_if(F.col("stage") == "quarantined").alias("quarantined"),
    )


def store_invoices(events: DataFrame, base: str) -> dict[str, int]:
    """Write the current invoices and the rejected ones in one pass, and count on the way: raw events, candidates, curated, quarantined.

    Both lie under `base`, apart by outcome; `stored_invoices` reads them. The counts are those of the write itself, so no job
    counts anything again.
    """
    raw, staged = Observation(), Observation()
    seen = events.where(F.col("entity_name") == "invoice").observe(raw, F.count(F.lit(1)).alias("raw_input"))
    outcome = F.when(F.size("quality_errors") == 0, CURATED).otherwise(QUARANTINED)
    rows = validate_invoices(invoice_candidates(seen)).withColumn("outcome", outcome)
    counted = rows.observe(
        staged, F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("outcome") == CURATED).alias("curated"),
        F.count_if(F.col("outcome") == QUARANTINED).alias("quarantined"),
    )
    counted.write.mode("overwrite").partitionBy("outcome").parquet(base)
    return {**raw.get, **staged.get}


def stored_invoices(spark: SparkSession, base: str, outcome: str) -> DataFrame:
    """The curated or the quarantined rows that `store_invoices` wrote; only their files are read."""
    rows = spark.read.parquet(base).where(F.col("outcome") == outcome).drop("outcome")
    return curated_invoices(rows) if outcome == CURATED else quarantined_invoices(rows)
