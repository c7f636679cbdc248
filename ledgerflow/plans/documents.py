"""Registered queries: document records, chunks and OCR results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions import text as tx
from ledgerflow.operators import chunking, evaluation, ocr, upsert
from ledgerflow.plans import inputs
from ledgerflow.plans.common import materialize, portable
from ledgerflow.sources import documents as source

OBSERVED_AT = "2024-06-01 00:00:00"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(inputs.documents(spark, sf_dir))


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(inputs.table_documents(spark, sf_dir))


def _fingerprint(df: DataFrame, column: str = "text") -> DataFrame:
    """Replace a long text by its length and digest."""
    return df.withColumn(f"{column}_chars", F.length(column)).withColumn(f"{column}_md5", F.md5(column)).drop(column)


def documents_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = source.documents_since(inputs.documents(spark, sf_dir), F.lit(OBSERVED_AT).cast("timestamp"))
    return portable(_fingerprint(_fingerprint(changed), "title"))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "customer", "orders", "lineitem", "part", "events", "embeddings", "conversations")
    return portable(source.source_health({n: inputs.table(spark, sf_dir, n) for n in names}).drop("checked_at"))


def document_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.validate(inputs.raw_documents(spark, sf_dir))
    valid = (F.size("validation_errors") == 0).alias("valid")
    return portable(rows.select("document_id", "doc_type", "retention_state", "validation_errors", valid))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.documents(spark, sf_dir).select("document_id", tx.normalize(F.col("text")).alias("text"))
    return portable(_fingerprint(rows))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_paragraphs(inputs.documents(spark, sf_dir))
    listed = chunking.explode_rows(rows, "paragraphs", "p", "paragraph_index")
    return portable(_fingerprint(listed.select("document_id", "paragraph_index", F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))))


def table_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_paragraphs(inputs.table_documents(spark, sf_dir))
    listed = chunking.explode_rows(rows, "paragraphs", "p", "paragraph_index")
    return portable(listed.select("document_id", "paragraph_index", F.col("p.kind").alias("kind"), F.col("p.text").alias("text")))


def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_fragments(chunking.with_paragraphs(inputs.documents(spark, sf_dir)))
    listed = chunking.explode_rows(rows, "fragments", "f", "fragment_index")
    return portable(_fingerprint(listed.select("document_id", "fragment_index", F.col("f.kind").alias("kind"), F.col("f.text").alias("text"))))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(_fingerprint(_fingerprint(chunks(spark, sf_dir)), "title"))


def chunk_table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("chunk_id", "tenant_id", "document_id", "chunk_index", "chunk_kind", "text")
    return portable(table_chunks(spark, sf_dir).select(*kept))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(evaluation.chunk_stats(chunks(spark, sf_dir), "tenant_id"))


def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(evaluation.chunk_kinds(table_chunks(spark, sf_dir), "tenant_id"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(evaluation.chunk_overlap(chunks(spark, sf_dir), "tenant_id"))


def eval_table_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels say that every document has a table, except those of flag A."""
    flags = inputs.table(spark, sf_dir, "lineitem").select(
        inputs.line_document_id().alias("document_id"),
        (F.col("l_returnflag") != "A").alias("expected_table"),
    )
    return portable(evaluation.table_detection(table_chunks(spark, sf_dir), flags))


def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks after two rewrites of every first chunk and one added chunk per document."""
    stored_at = F.lit(OBSERVED_AT).cast("timestamp")

    def stored(rows: DataFrame) -> DataFrame:
        return rows.select(
            "chunk_id", "tenant_id", "document_id", "doc_type", "classification", "retention_state", "source_uri",
            F.col("text").alias("chunk_text"), F.array(F.length("text").cast("float")).alias("embedding"), stored_at.alias("created_at"),
        )

    change = inputs.documents(spark, sf_dir).select(
        "*", F.explode(F.array(F.lit("::chunk::0"), F.lit("::title"))).alias("suffix")
    ).withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2))))
    change = change.withColumns(
        {
            "chunk_id": F.concat("document_id", "suffix"),
            "text": F.concat(F.col("pass").cast("string"), F.lit(" "), "title"),
            "retention_state": F.lit("archived"),
            "classification": F.lit("restricted"),
        }
    )
    last = upsert.last_per_key(change, ["chunk_id"], [F.col("pass").desc()])
    merged = upsert.merge(
        stored(chunks(spark, sf_dir)), stored(last), ["chunk_id"], update=["chunk_text", "embedding", "retention_state"]
    )
    return portable(_fingerprint(merged.withColumn("embedding", F.get("embedding", F.lit(0))), "chunk_text"))


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.blocks(inputs.ocr_results(spark, sf_dir))
    return portable(rows.drop("relationships", "addressable").withColumn("entity_types", F.array_join("entity_types", ",")))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(ocr.lines(ocr.blocks(inputs.ocr_results(spark, sf_dir))))


def _table_text(table: str) -> Column:
    return F.array_join(F.transform(table, lambda row: F.array_join(row, "|")), ";")


def ocr_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.tables(ocr.blocks(inputs.ocr_results(spark, sf_dir)))
    return portable(rows.withColumn("table", _table_text("table")))


def ocr_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(ocr.key_values(ocr.blocks(inputs.ocr_results(spark, sf_dir))))


def ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.extracted_documents(inputs.spread_out(inputs.ocr_results(spark, sf_dir)))
    pairs = F.array_join(F.transform("key_value_pairs", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return portable(rows.withColumn("tables", F.size("tables")).withColumn("key_value_pairs", pairs))


def ocr_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR results stored, read back, turned into documents and chunked: tables come out whole."""
    results = materialize(inputs.ocr_results(spark, sf_dir), "ocr")
    records = ocr.to_documents(
        ocr.extracted_documents(results), doc_type="workpaper", classification="internal", retention_state="active",
        observed_at=F.lit(OBSERVED_AT).cast("timestamp"),
    )
    cut = chunking.chunk_documents(records)
    return portable(cut.select("chunk_id", "tenant_id", "document_id", "doc_type", "source_uri", "chunk_kind", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        documents_since, source_health, document_validation, normalize_text, paragraphs, table_paragraphs, sentence_windows,
        chunk_documents, chunk_table_documents, chunk_stats, chunk_kinds, chunk_overlap, eval_table_detection, chunk_upsert,
        ocr_blocks, ocr_lines, ocr_tables, ocr_key_values, ocr_documents, ocr_to_documents,
    )
}
