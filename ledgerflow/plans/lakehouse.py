"""Registered queries: change events, snapshots, the invoice product and its questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.operators import gold, partitioned, quality, serving, snapshot, upsert
from ledgerflow.plans import inputs, medallion
from ledgerflow.plans.common import materialize, portable, rounded
from ledgerflow.session import work_dir
from ledgerflow.sources import cdc, oltp


def cdc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cdc.decode(inputs.messages(spark, sf_dir)).withColumn("corrupt", cdc.is_corrupt())
    return portable(rows.drop("bronze_ingested_at"))


def oltp_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices written in the source contract and read back as a snapshot folder."""
    return _snapshot(spark, sf_dir, "invoices")


def _snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    folder = work_dir(spark, "oltp")
    schemas.conform(inputs.oltp_tables(spark, sf_dir)[name], oltp.TABLES[name]).write.parquet(f"{folder}/{name}")
    return portable(oltp.read_snapshot(spark, name, folder))


def oltp_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "customers")


def oltp_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "engagements")


def oltp_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "controls")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(snapshot.dedup_events(inputs.bronze_invoices(spark, sf_dir)).drop("topic", "partition", "offset"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot.latest_state(snapshot.dedup_events(inputs.bronze_invoices(spark, sf_dir)))
    return portable(rows.select("tenant_id", "entity_id", "event_id", "op", "updated_at", "emitted_at", "source_sequence"))


def payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and typed payload fields of every event."""
    rows = snapshot.type_invoice_payload(inputs.bronze_invoices(spark, sf_dir))
    return portable(rows.drop("payload_json"))


def silver_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(snapshot.invoice_candidates(inputs.bronze_invoices(spark, sf_dir)).drop("payload_json"))


def quality_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = medallion.validated(spark, sf_dir)
    return portable(rows.select("tenant_id", "invoice_id", "event_id", "quality_errors"))


def quality_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(quality.error_counts(medallion.validated(spark, sf_dir), by=("tenant_id",)))


def silver_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(medallion.silver(spark, sf_dir))


def silver_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(snapshot.quarantined_invoices(medallion.validated(spark, sf_dir)).drop("quarantined_at"))


def silver_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the write of silver and quarantine, taken while it runs."""
    counts = snapshot.store_invoices(inputs.bronze_invoices(spark, sf_dir), work_dir(spark, "invoices"))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def silver_snapshot_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest customers, engagements and controls, one under the other."""

    def common(rows: DataFrame, entity: str, key: str, name: str) -> DataFrame:
        return rows.select(
            F.lit(entity).alias("entity"), "tenant_id", F.col(key).alias("entity_id"), F.col(name).alias("name"),
            "updated_at", "source_event_id", "source_batch_id", "is_deleted",
        )

    parts = common(medallion.customers(spark, sf_dir), "customer", "customer_id", "customer_name")
    parts = parts.unionByName(common(medallion.engagements(spark, sf_dir), "engagement", "engagement_id", "engagement_name"))
    return portable(parts.unionByName(common(medallion.controls(spark, sf_dir), "control", "control_id", "control_name")))


def quarantine_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine after two runs: first without the updates, then over everything."""
    bronze = inputs.bronze_invoices(spark, sf_dir)
    first = snapshot.validate_invoices(snapshot.invoice_candidates(bronze.where(F.col("op") == "create")))
    stored = materialize(snapshot.quarantined_invoices(first), "quarantine")
    rejected = materialize(snapshot.quarantined_invoices(medallion.validated(spark, sf_dir)), "rejected")
    added = upsert.append_new(stored, rejected, ["event_id"])
    return portable(stored.unionByName(added).drop("quarantined_at"))


def silver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored silver, built from part of the creations, after merging newer states of two thirds of the invoices into it.

    The stored table has a column that the source lacks and must not touch.
    """
    bronze = inputs.bronze_invoices(spark, sf_dir)
    early = bronze.where((F.col("op") == "create") & (F.col("source_sequence") % 4 != 0))
    before = snapshot.curated_invoices(snapshot.validate_invoices(snapshot.invoice_candidates(early)))
    target = materialize(before.withColumn("first_batch", F.col("source_batch_id")), "silver")
    changed = F.substr("invoice_id", F.lit(5)).cast("long") % 3 != 1
    source = materialize(medallion.silver(spark, sf_dir).where(changed), "curated")
    return portable(upsert.merge(target, source, ["tenant_id", "invoice_id"]))


def silver_partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge into a table by tenant and year of the state; newer states leave the year of the older ones."""
    bronze = inputs.bronze_invoices(spark, sf_dir)
    early = bronze.where((F.col("op") == "create") & (F.col("source_sequence") % 4 != 0))
    year = F.date_format("updated_at", "yyyy")
    before = snapshot.curated_invoices(snapshot.validate_invoices(snapshot.invoice_candidates(early))).withColumn("year", year)
    base, by = work_dir(spark, "silver-partitions"), ["tenant_id", "year"]
    partitioned.create(before, base, by)
    changed = F.substr("invoice_id", F.lit(5)).cast("long") % 3 != 1
    source = materialize(medallion.silver(spark, sf_dir).where(changed).withColumn("year", year), "curated")
    partitioned.merge(source, base, ["tenant_id", "invoice_id"], by, 1)
    return portable(partitioned.read(spark, base, source.schema, by).drop("year"))


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers known to the change feed win over the rows of the customer table."""
    known = medallion.customers(spark, sf_dir).select("tenant_id", "customer_id", "customer_name")
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("tenant_"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("seed "), "c_name").alias("customer_name"),
    )
    return portable(upsert.insert_if_absent(known, rows, ["customer_id"]))


def gold_invoice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(medallion.gold_invoices(spark, sf_dir))


def gold_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product written by tenant and month, counted from the partition columns alone."""
    path = work_dir(spark, "gold")
    gold.write_partitioned(medallion.gold_invoices(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return portable(stored.groupBy("tenant_id", "invoice_month").agg(F.count("*").alias("invoices")))


def _laid_out(spark: SparkSession, rows: DataFrame, date_column: str | None) -> DataFrame:
    """A table written by tenant (and month), counted from the partition columns alone."""
    path = work_dir(spark, "layout")
    gold.write_partitioned(rows, path, date_column)
    by = ["tenant_id"] + ([gold.month_name(date_column)] if date_column else [])
    return portable(spark.read.parquet(path).groupBy(*by).agg(F.count("*").alias("rows")))


def bronze_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid_out(spark, inputs.bronze_invoices(spark, sf_dir), "emitted_at")


def silver_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid_out(spark, medallion.silver(spark, sf_dir), "invoice_date")


def quarantine_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid_out(spark, snapshot.quarantined_invoices(medallion.validated(spark, sf_dir)), None)


def v_invoice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(medallion.gold_invoices(spark, sf_dir).select(*serving.INVOICE_VIEW))


def v_control_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(medallion.control_summary(spark, sf_dir).select(*serving.CONTROL_VIEW))


def control_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(serving.control_exceptions(medallion.control_summary(spark, sf_dir)))


def overdue_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(rounded(serving.overdue_total(medallion.gold_invoices(spark, sf_dir)), 2, "total_overdue_amount"))


def overdue_total_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = serving.overdue_total_by_month(medallion.gold_invoices(spark, sf_dir))
    return portable(rounded(totals, 2, "total_overdue_amount"))


def open_invoice_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(serving.open_invoice_count(medallion.gold_invoices(spark, sf_dir)))


def aging_bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(rounded(serving.aging_totals(medallion.gold_invoices(spark, sf_dir)), 2, "total_amount"))


def customer_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(rounded(serving.customer_balance(medallion.gold_invoices(spark, sf_dir)), 2, "outstanding_balance"))


def engagement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(serving.engagement_status(medallion.engagements(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        cdc_decode, oltp_snapshot, oltp_customers, oltp_engagements, oltp_controls, dedup_events, latest_state, payload_extract, silver_candidates, quality_errors,
        quality_error_counts, silver_curated, silver_quarantine, silver_reconciliation, silver_snapshot_generic,
        quarantine_append, silver_merge, silver_partition_merge, insert_if_absent, gold_invoice_summary, gold_partitions,
        bronze_partitions, silver_partitions, quarantine_partitions, v_invoice_summary,
        v_control_exceptions, control_exceptions, overdue_total, overdue_total_month, open_invoice_count,
        aging_bucket_totals, customer_balance, engagement_status,
    )
}
