"""Relational source tables, read in parallel over JDBC or from a snapshot folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow import schemas

TABLES = {
    "customers": schemas.OLTP_CUSTOMERS,
    "engagements": schemas.OLTP_ENGAGEMENTS,
    "invoices": schemas.OLTP_INVOICES,
    "controls": schemas.OLTP_CONTROLS,
}


def read_jdbc(
    spark: SparkSession, table: str, *, url: str, predicates: list[str], properties: dict[str, str] | None = None
) -> DataFrame:
    """Read one published table; each predicate becomes one partition, so none may overlap."""
    if table not in TABLES:
        raise ValueError(f"not a published table: {table}")
    rows = spark.read.jdbc(url, f"accounting.{table}", predicates=predicates, properties=properties or {})
    return schemas.conform(rows, TABLES[table])


def read_snapshot(spark: SparkSession, table: str, folder: str, fmt: str = "parquet") -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"not a published table: {table}")
    return spark.read.format(fmt).schema(TABLES[table]).load(f"{folder.rstrip('/')}/{table}")
