"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.plans import answers, documents, lakehouse, streams
from ledgerflow.plans.oracle import answers as answers_sql
from ledgerflow.plans.oracle import documents as documents_sql
from ledgerflow.plans.oracle import lakehouse as lakehouse_sql
from ledgerflow.plans.oracle import streams as streams_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**lakehouse.QUERIES, **documents.QUERIES, **answers.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**lakehouse_sql.ORACLE, **documents_sql.ORACLE, **answers_sql.ORACLE, **streams_sql.ORACLE}
