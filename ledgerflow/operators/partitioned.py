"""Merges that rewrite only the partitions they touch.

A table is a folder of versions, each with the partitions that it wrote, and a manifest per version that names, for every
partition, the version its rows are in. A merge reads the keys of the table and the partitions that the source's keys lie in or move to, writes
these partitions as a new version, and publishes it with its manifest, which is written last: readers see the old table or the new
one. Files of other partitions stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import upsert

VERSION = "_version"


def create(df: DataFrame, base: str, by: Sequence[str]) -> None:
    """Write a whole table as version 0, partitioned by the columns `by`."""
    _store(df, base, 0, by)
    _partitions(df.sparkSession, base, 0, df.schema, by).write.mode("overwrite").parquet(f"{base}/_manifest/number=0")


def _store(df: DataFrame, base: str, version: int, by: Sequence[str]) -> None:
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(f"{base}/{VERSION}={version}")


def _typed(schema: T.StructType, by: Sequence[str]) -> T.StructType:
    """Columns of partitions come last and keep their types, whatever their values look like."""
    return T.StructType([f for f in schema if f.name not in by] + [schema[c] for c in by])


def _partitions(spark: SparkSession, base: str, version: int, schema: T.StructType, by: Sequence[str]) -> DataFrame:
    """The partitions that a version wrote, from their folders' names."""
    rows = spark.read.schema(_typed(schema, by)).parquet(f"{base}/{VERSION}={version}")
    return rows.select(*by).distinct().withColumn(VERSION, F.lit(version).cast("long"))


def manifest(spark: SparkSession, base: str) -> tuple[int, DataFrame] | None:
    """(newest version, where the rows of each partition are); None before the first version."""
    try:
        stored = spark.read.parquet(f"{base}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = stored.agg(F.max(F.col("number").cast("long"))).first()[0]
    return newest, spark.read.parquet(f"{base}/_manifest/number={newest}")


def read(spark: SparkSession, base: str, schema: T.StructType, by: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """The rows of the table, or of the partitions in `only`; files of former versions and of other partitions are pruned."""
    _, where = manifest(spark, base)
    if only is not None:
        where = where.join(only, _same(where, only, by), "left_semi")
    versions = sorted(r[VERSION] for r in where.select(VERSION).distinct().collect())
    if not versions:
        return spark.createDataFrame([], _typed(schema, by)).select(*schema.names)
    full = T.StructType([*_typed(schema, by).fields, T.StructField(VERSION, T.LongType())])
    rows = spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/{VERSION}={v}" for v in versions])
    return rows.join(where, _same(rows, where, [*by, VERSION]), "left_semi").select(*schema.names)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def merge(source: DataFrame, base: str, keys: Sequence[str], by: Sequence[str], version: int, **how) -> None:
    """Upsert a source with one row per key, with all columns of the table, as `version`; a version that is there is not applied again.

    A row whose partition changes leaves its former one. `how` is passed on to `upsert.merge`.
    """
    spark, schema = source.sparkSession, source.schema
    newest, where = manifest(spark, base)
    if newest >= version:
        return
    # Only keys and partition columns of the table are read for this.
    known = read(spark, base, schema, by).select(*dict.fromkeys([*keys, *by]))
    touched = known.join(source.select(*keys), _same(known, source, keys), "left_semi").select(*by)
    touched = touched.unionByName(source.select(*by)).distinct().persist()
    try:
        old = read(spark, base, schema, by, only=touched)
        _store(upsert.merge(old, source, keys, **how), base, version, by)
        rest = where.join(touched, _same(where, touched, by), "left_anti")
        whole = rest.unionByName(_partitions(spark, base, version, schema, by))
        whole.write.mode("overwrite").parquet(f"{base}/_manifest/number={version}")
    finally:
        touched.unpersist()
