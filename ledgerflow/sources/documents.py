"""Document records: incremental reads, validation and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.operators.quality import Rule, annotate

# The fields an incremental document read returns.
SINCE_FIELDS = (
    "tenant_id", "document_id", "title", "doc_type", "classification", "retention_state", "updated_at",
    "source_uri", "text",
)

# created_at may be missing in stored records, so it is not among the required fields.
REQUIRED = (
    "tenant_id", "document_id", "title", "doc_type", "classification", "retention_state", "updated_at", "text",
    "source_uri",
)


def documents_since(documents: DataFrame, updated_after: Column) -> DataFrame:
    """Records changed at or after a time, oldest first."""
    return (
        documents.where(F.col("updated_at") >= updated_after)
        .select(*SINCE_FIELDS)
        .orderBy(F.col("updated_at").asc(), F.col("document_id").asc())
    )


def source_health(sources: dict[str, DataFrame], checked_at: Column | None = None) -> DataFrame:
    """Row count per source and the time of the check."""
    when = F.current_timestamp() if checked_at is None else checked_at
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("source"), "row_count") for name, df in sources.items()]
    report = counts[0]
    for other in counts[1:]:
        report = report.unionByName(other)
    return report.withColumn("checked_at", when)


def validation_rules() -> list[Rule]:
    missing = [Rule(f"missing_{f}", F.col(f).isNull()) for f in REQUIRED]
    domains = (("doc_type", schemas.DOC_TYPES), ("retention_state", schemas.RETENTION_STATES))
    return missing + [Rule(f"invalid_{f}", F.col(f).isNotNull() & ~F.col(f).isin(*values)) for f, values in domains]


def validate(documents: DataFrame) -> DataFrame:
    """Documents with the codes of the rules they break."""
    return annotate(documents, validation_rules(), into="validation_errors")
