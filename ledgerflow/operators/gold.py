"""Invoice product: silver invoices with names, aging and lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import finance


def invoice_summary(
    invoices: DataFrame, customers: DataFrame, engagements: DataFrame, as_of: str | dt.date | None = None
) -> DataFrame:
    """One row per live invoice; an unknown deletion flag counts as deleted.

    The lineage reference is NULL unless invoice, customer and engagement are all known. The joins
    carry no hint: a dimension is broadcast only when its size allows, and otherwise AQE splits
    the partitions of a customer that holds much of the invoices.
    """
    today = finance.as_of_date(as_of)
    names = customers.select("tenant_id", "customer_id", "customer_name", F.col("source_event_id").alias("_customer_event"))
    titles = engagements.select(
        "tenant_id", "engagement_id", "engagement_name", F.col("source_event_id").alias("_engagement_event")
    )
    joined = (
        invoices.where(~F.col("is_deleted"))
        .join(names, ["tenant_id", "customer_id"], "left")
        .join(titles, ["tenant_id", "engagement_id"], "left")
        .withColumn("days_past_due", finance.days_past_due(F.col("due_date"), today))
    )
    return joined.select(
        "tenant_id", "invoice_id", "invoice_number", "engagement_id", "engagement_name", "customer_id",
        "customer_name", "invoice_amount", "currency", "status", "invoice_date", "due_date", "days_past_due",
        finance.is_overdue(F.col("status"), F.col("due_date"), today).alias("is_overdue"),
        finance.aging_bucket(F.col("days_past_due")).alias("aging_bucket"),
        "updated_at",
        F.concat(
            F.lit("invoice:"), "source_event_id", F.lit("|customer:"), "_customer_event",
            F.lit("|engagement:"), "_engagement_event",
        ).alias("lineage_ref"),
    )


def with_month(rows: DataFrame, date_column: str, into: str) -> DataFrame:
    return rows.withColumn(into, F.date_format(date_column, "yyyy-MM"))


def month_name(date_column: str) -> str:
    return date_column.removesuffix("_date").removesuffix("_at") + "_month"


def write_partitioned(rows: DataFrame, path: str, date_column: str | None = "invoice_date") -> None:
    """Rebuild a table laid out by tenant, and by month if a date is named.

    The rebalance step gathers a partition's rows into few files and lets AQE split a partition
    that is too large for one task.
    """
    by = ["tenant_id"]
    if date_column:
        by.append(month_name(date_column))
        rows = with_month(rows, date_column, by[-1])
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
