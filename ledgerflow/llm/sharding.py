"""Contiguous shards of equal bytes, cut from a global prefix sum.

Rows are range-partitioned and sorted by key, and stored. Each stored partition reports its total;
the running sum over these totals (one row per partition, whatever the number of rows) gives every
partition its place in the global order, and a window inside the partition gives every row its own.
A row goes to the shard in whose equal stretch of all bytes its middle byte lies, so a shard differs
from the target by at most one row's size.

Nulls and ties: a null key sorts first; a null text has no bytes. Rows that tie on key, checksum and
size may swap places, which changes no result. Every row counts at least one byte, so empty texts take
a place too. An empty table gives no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import every_column, materialize


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one for the separator."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_checksum(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def byte_shards(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8, whole_rows: bool = False) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row, in `shards` contiguous runs of equal bytes.

    With `whole_rows` each row also comes along as the struct `row`; else no text is moved.
    """
    carried = [F.struct(*every_column(docs)).alias("row")] if whole_rows else []
    sized = docs.select(
        F.col(key).alias("key"), text_size(F.col(text)).alias("size"), text_checksum(F.col(text)).alias("crc"),
        # Splits a key that many rows share.
        F.monotonically_increasing_id().alias("tie"), *carried,
    )
    order = ["key", "crc", "size", "tie"]
    stored = materialize(sized.repartitionByRange(*order).sortWithinPartitions(*order), "shards-sorted")
    placed = stored.select("*", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("at"))

    totals = placed.groupBy("part").agg(
        F.min(F.struct(*order)).alias("first"), F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows")
    )
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(inside)) - F.col("size")
    carried = ["row"] * whole_rows
    ranked = placed.join(offsets, "part").select(
        "key", "size", "crc", *carried, middle.alias("middle"), "all_bytes",
        (F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1).alias("place"),
    )
    # Exact, also where the product of bytes and shards goes beyond a long.
    stretch = F.expr(f"CAST(middle AS DECIMAL(20, 0)) * CAST({int(shards)} AS DECIMAL(10, 0)) DIV (2 * all_bytes)")
    ranked = ranked.withColumn("shard", stretch.cast("int")).drop("middle", "all_bytes")
    ranked = materialize(ranked, "shards-placed")
    # One row per shard.
    starts = F.broadcast(ranked.groupBy("shard").agg(F.min("place").alias("start")))
    return ranked.join(starts, "shard").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"), *carried,
    )


def write_shards(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", shards: int = 8) -> None:
    """Write the documents as one folder per shard, each file a run of slots."""
    placed = byte_shards(docs, key=key, text=text, shards=shards, whole_rows=True).select("row", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
