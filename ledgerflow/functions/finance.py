"""Invoice aging expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of: str | dt.date | None) -> Column:
    """The reporting date; the current date unless one is given."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def days_past_due(due_date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, due_date)


def is_overdue(status: Column, due_date: Column, as_of: Column) -> Column:
    """Marked overdue, or due before the reporting date. Unknown counts as not overdue."""
    return F.coalesce((status == "overdue") | (due_date < as_of), F.lit(False))


def aging_bucket(days: Column) -> Column:
    return (
        F.when(days.between(1, 30), "0_30")
        .when(days.between(31, 60), "31_60")
        .when(days > 60, "61_plus")
        .otherwise("current")
    )
