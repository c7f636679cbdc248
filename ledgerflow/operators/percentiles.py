"""Exact nearest-rank percentiles of huge groups.

Equal values are counted first. The counts are stored, range-partitioned and sorted by group and value; totals per stored
file and group (a few rows per file) tell how much of a group lies before each file, and a running sum inside the file
tells the rest. So the values of one group, however many, are spread over as many tasks as they fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.numeric import nearest_rank
from ledgerflow.session import materialize


def nearest_rank_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with one column per share; NULL values are left out, a NULL group is a group."""
    by = list(by)
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    counts = known.groupBy(*by, "_value").agg(F.count("*").alias("_n"))
    order = [*by, "_value"]
    stored = materialize(counts.repartitionByRange(*order).sortWithinPartitions(*order), "percentiles")
    placed = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    parts = placed.groupBy("_file", *by).agg(F.sum("_n").alias("_part"), F.min("_value").alias("_first"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_file").alias("_f"), *[F.col(c).alias(f"_by_{c}") for c in by],
        F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"), F.sum("_part").over(group).alias("_total"),
    )
    same = F.col("_file") == F.col("_f")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_file", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("_upto", F.sum("_n").over(inside)).join(offsets, same)
    reach = F.col("_before") + F.col("_upto")
    picks = [F.min(F.when(reach >= nearest_rank(F.col("_total"), share), F.col("_value"))).alias(name) for name, share in shares.items()]
    return running.groupBy(*by).agg(*picks)
