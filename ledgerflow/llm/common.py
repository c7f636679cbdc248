"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.plans.common import materialize

__all__ = ["FOLDS", "batches_of", "every_column", "fresh_name", "held_out", "is_training", "materialize", "numbered", "table", "with_facts"]

#: One fold of five is held out of every fit.
FOLDS = 5
#: A key with more than one row in so many is hot; there are fewer such keys than this.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every_column(df: DataFrame) -> list[Column]:
    """All columns as they are, whatever signs their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1 and so on: a map over batches takes no names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def held_out(doc_id: Column | str) -> Column:
    """Rows that no fit may see; a row without an id is held out too."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def is_training(doc_id: Column | str) -> Column:
    return ~held_out(doc_id)


def batches_of(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose text column holds at most `most_bytes` each, or one row."""
    offsets = [0]
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    held = 0
    for row, size in enumerate(sizes):
        if held and held + size > most_bytes:
            offsets.append(row)
            held = 0
        held += size
    for start, stop in zip(offsets, [*offsets[1:], batch.num_rows]):
        if stop > start:
            yield batch.slice(start, stop - start)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, *, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Every row with the facts of its key, nulls where there are none; `facts` has one row per key.

    Rows of a hot key stay where they are: fewer than `hot_keys` keys can hold more than one row in `hot_keys` each, so their facts
    are broadcast. All others meet their facts in a shuffle. Both tables are read more than once, so they should be stored.
    """
    total = rows.count()
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    hot = materialize(counted.where(F.col("_rows") * hot_keys > total).select(key), "hot-keys")
    few = F.broadcast(hot.join(facts, key, "left"))
    rest = rows.join(F.broadcast(hot), key, "left_anti").where(F.col(key).isNotNull()).join(facts, key, "left")
    without = rows.where(F.col(key).isNull())
    return rows.join(few, key).unionByName(rest).unionByName(without, allowMissingColumns=True)
