"""Bronze -> silver -> gold over the derived change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.operators import gold, serving, snapshot
from ledgerflow.plans import inputs


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.validate_invoices(snapshot.invoice_candidates(inputs.bronze_invoices(spark, sf_dir)))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.curated_invoices(validated(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("customer_name", "customer_status")
    return snapshot.entity_snapshot(inputs.bronze_customers(spark, sf_dir), "customer", "customer_id", fields, ("customer_name",))


def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("customer_id", "engagement_name", "engagement_status")
    return snapshot.entity_snapshot(
        inputs.bronze_engagements(spark, sf_dir), "engagement", "engagement_id", fields, ("engagement_name",)
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("engagement_id", "control_name", "severity", "status", "exception_count")
    return snapshot.entity_snapshot(inputs.bronze_controls(spark, sf_dir), "control", "control_id", fields)


def gold_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.invoice_summary(
        silver(spark, sf_dir), customers(spark, sf_dir), engagements(spark, sf_dir), inputs.AS_OF
    )


def control_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.control_summary(controls(spark, sf_dir), engagements(spark, sf_dir))
