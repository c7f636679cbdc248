"""Exact questions over the invoice product, always by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the two serving views.
INVOICE_VIEW = (
    "tenant_id", "invoice_id", "invoice_number", "engagement_name", "customer_name", "invoice_amount", "status",
    "is_overdue", "aging_bucket", "lineage_ref",
)
CONTROL_VIEW = (
    "tenant_id", "control_id", "control_name", "engagement_name", "severity", "status", "exception_count", "lineage_ref",
)


def for_tenant(rows: DataFrame, tenant_id: str | None) -> DataFrame:
    """Bind the tenant; None keeps the tenant column as the grouping instead."""
    return rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)


def overdue_total(gold: DataFrame, tenant_id: str | None = None) -> DataFrame:
    overdue = for_tenant(gold, tenant_id).where("is_overdue")
    return overdue.groupBy("tenant_id").agg(
        F.sum("invoice_amount").alias("total_overdue_amount"), F.count("*").alias("overdue_invoice_count")
    )


def overdue_total_by_month(gold: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Overdue totals by the month the invoices fell due."""
    overdue = for_tenant(gold, tenant_id).where("is_overdue")
    return overdue.groupBy("tenant_id", F.date_format("due_date", "yyyy-MM").alias("due_month")).agg(
        F.sum("invoice_amount").alias("total_overdue_amount"), F.count("*").alias("overdue_invoice_count")
    )


def open_invoice_count(gold: DataFrame, tenant_id: str | None = None) -> DataFrame:
    rows = for_tenant(gold, tenant_id).where(F.col("status") == "open")
    return rows.groupBy("tenant_id").agg(F.count("*").alias("open_invoices"))


def aging_totals(gold: DataFrame, tenant_id: str | None = None) -> DataFrame:
    return for_tenant(gold, tenant_id).groupBy("tenant_id", "aging_bucket").agg(
        F.count("*").alias("invoices"), F.sum("invoice_amount").alias("total_amount")
    )


def customer_balance(gold: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """What each customer still owes: invoices that are not paid."""
    unpaid = for_tenant(gold, tenant_id).where(F.col("status") != "paid")
    return unpaid.groupBy("tenant_id", "customer_id").agg(
        F.sum("invoice_amount").alias("outstanding_balance"), F.count("*").alias("unpaid_invoices")
    )


def engagement_status(engagements: DataFrame, tenant_id: str | None = None) -> DataFrame:
    live = for_tenant(engagements, tenant_id).where(~F.col("is_deleted"))
    return live.select("tenant_id", "engagement_id", "engagement_name", "engagement_status")


def control_summary(controls: DataFrame, engagements: DataFrame) -> DataFrame:
    """Live controls with the name of their engagement and a lineage reference."""
    titles = engagements.select(
        "tenant_id", "engagement_id", "engagement_name", F.col("source_event_id").alias("_engagement_event")
    )
    joined = controls.where(~F.col("is_deleted")).join(titles, ["tenant_id", "engagement_id"], "left")
    return joined.select(
        "tenant_id", "control_id", "control_name", "engagement_name", "severity", "status",
        F.col("exception_count").try_cast("int").alias("exception_count"),
        F.concat(F.lit("control:"), "source_event_id", F.lit("|engagement:"), "_engagement_event").alias("lineage_ref"),
    )


def control_exceptions(summary: DataFrame, tenant_id: str | None = None) -> DataFrame:
    return for_tenant(summary, tenant_id).where(F.col("exception_count") > 0)


def register_views(gold: DataFrame, controls: DataFrame) -> None:
    gold.select(*INVOICE_VIEW).createOrReplaceTempView("v_gold_invoice_summary")
    controls.select(*CONTROL_VIEW).createOrReplaceTempView("v_gold_control_exceptions")
