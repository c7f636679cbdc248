"""Declarative row checks: every broken rule leaves its code, rows split by whether any did."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.text import is_blank


class Rule(NamedTuple):
    code: str
    broken: Column


def missing(field: str, column: str | None = None) -> Rule:
    return Rule(f"missing_{field}", is_blank(F.col(column or field)))


def unparsable(field: str, raw: str, parsed: str) -> Rule:
    """The raw text has content but did not parse."""
    return Rule(f"invalid_{field}", ~is_blank(F.col(raw)) & F.col(parsed).isNull())


def invoice_rules() -> list[Rule]:
    rules = [missing("tenant_id"), missing("invoice_id")]
    for field in ("invoice_amount", "due_date", "invoice_date"):
        rules += [missing(field, f"raw_{field}"), unparsable(field, f"raw_{field}", field)]
    return rules


def annotate(rows: DataFrame, rules: list[Rule], into: str = "quality_errors") -> DataFrame:
    """Add the codes of the broken rules, in rule order."""
    codes = [F.when(rule.broken, F.lit(rule.code)) for rule in rules]
    return rows.withColumn(into, F.filter(F.array(*codes), lambda code: code.isNotNull()))


def split(annotated: DataFrame, errors: str = "quality_errors") -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with errors)"""
    return annotated.where(F.size(errors) == 0), annotated.where(F.size(errors) > 0)


def error_counts(annotated: DataFrame, errors: str = "quality_errors", by: tuple[str, ...] = ()) -> DataFrame:
    """How often each code occurs."""
    codes = annotated.select(*by, F.explode(errors).alias("error_code"))
    return codes.groupBy(*by, "error_code").agg(F.count("*").alias("rows"))
