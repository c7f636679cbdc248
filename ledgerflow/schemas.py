"""Declared table contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
DATE, TS = T.DateType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The field names of a change event; the first ten are mandatory.
CDC_REQUIRED = (
    "event_id", "entity_name", "op", "tenant_id", "entity_id", "updated_at", "emitted_at",
    "source_sequence", "payload_json", "source_system",
)
CDC_OPTIONAL = ("event_version", "batch_id", "source_file")
CDC_EVENT = T.StructType(
    [T.StructField(f, S, False) for f in CDC_REQUIRED] + [T.StructField(f, S, True) for f in CDC_OPTIONAL]
)

CDC_MESSAGE = _struct(topic=S, partition=I, offset=L, value=S)

BRONZE_EVENTS = _struct(
    topic=S, partition=I, offset=L, bronze_ingested_at=TS, event_id=S, entity_name=S, op=S, tenant_id=S,
    entity_id=S, updated_at=TS, emitted_at=TS, source_sequence=L, payload_json=S, source_system=S,
    batch_id=S, source_file=S, event_version=S,
)

SILVER_INVOICES = _struct(
    tenant_id=S, invoice_id=S, customer_id=S, engagement_id=S, invoice_number=S, invoice_amount=D,
    currency=S, status=S, due_date=DATE, invoice_date=DATE, updated_at=TS, source_event_id=S,
    source_batch_id=S, is_deleted=B,
)

QUARANTINED_INVOICES = _struct(
    tenant_id=S, invoice_id=S, event_id=S, batch_id=S, payload_json=S, raw_invoice_amount=S,
    raw_due_date=S, raw_invoice_date=S, quality_errors=T.ArrayType(S), updated_at=TS, emitted_at=TS,
    source_sequence=L, quarantined_at=TS,
)

GOLD_INVOICES = _struct(
    tenant_id=S, invoice_id=S, invoice_number=S, engagement_id=S, engagement_name=S, customer_id=S,
    customer_name=S, invoice_amount=D, currency=S, status=S, invoice_date=DATE, due_date=DATE,
    days_past_due=I, is_overdue=B, aging_bucket=S, updated_at=TS, lineage_ref=S,
)

DOCUMENTS = _struct(
    tenant_id=S, document_id=S, title=S, doc_type=S, classification=S, retention_state=S, created_at=TS,
    updated_at=TS, text=S, source_uri=S, contains_table_like_text=B,
)

CHUNKS = _struct(
    chunk_id=S, tenant_id=S, document_id=S, title=S, doc_type=S, classification=S, retention_state=S,
    source_uri=S, chunk_index=I, chunk_kind=S, text=S,
)

STORED_CHUNKS = _struct(
    chunk_id=S, tenant_id=S, document_id=S, doc_type=S, classification=S, retention_state=S,
    source_uri=S, chunk_text=S, embedding=T.ArrayType(T.FloatType()), created_at=TS,
)

OCR_BLOCK = _struct(
    Id=S, BlockType=S, Text=S, RowIndex=I, ColumnIndex=I, EntityTypes=T.ArrayType(S),
    Relationships=T.ArrayType(_struct(Type=S, Ids=T.ArrayType(S))),
)
OCR_RESULT = _struct(tenant_id=S, document_id=S, Blocks=T.ArrayType(OCR_BLOCK))

OLTP_CUSTOMERS = _struct(customer_id=S, tenant_id=S, customer_name=S, customer_status=S, updated_at=TS)
OLTP_ENGAGEMENTS = _struct(
    engagement_id=S, tenant_id=S, customer_id=S, engagement_name=S, engagement_status=S, updated_at=TS
)
OLTP_INVOICES = _struct(
    invoice_id=S, tenant_id=S, customer_id=S, engagement_id=S, invoice_number=S,
    invoice_amount=T.DecimalType(18, 2), currency=S, status=S, invoice_date=DATE, due_date=DATE, updated_at=TS,
)
OLTP_CONTROLS = _struct(
    control_id=S, tenant_id=S, engagement_id=S, control_name=S, severity=S, status=S, exception_count=I,
    updated_at=TS,
)

# The closed domains of a document.
DOC_TYPES = ("policy", "workpaper", "engagement_note", "issue_summary")
RETENTION_STATES = ("active", "archived", "legal_hold")


def ensure_table(
    spark: SparkSession, name: str, schema: T.StructType, *, partition_by: tuple[str, ...] = (), using: str = "parquet"
) -> None:
    """Create the table if it is absent; an existing table is left as it is."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    layout = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using}{layout}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the contract's columns, order and types; a missing column fails analysis."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
