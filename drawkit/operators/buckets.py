"""Tables that are changed in place: hash buckets by key, and a list of which version holds each bucket.

A change reads and writes only the buckets that its keys fall into. Version n of a table is a list, one file in
versions/version=n that appears at once, of buckets and of the version that wrote each; the rows of a bucket are in
data/version=m/bucket=b. Who reads sees the newest list and with it either all of a change or nothing of it. A change
with a number of its own (a stream's batch) starts from the versions below that number, so doing it again gives the
same version. Everything is read and written by Spark, so any file system will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

BUCKETS = 64


def _bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias("bucket")


def _versions(spark: SparkSession, path: str, below: int | None) -> tuple[int, int, dict[int, int]]:
    """(version, number of buckets, bucket to the version that wrote it) of the newest version, or the newest below a number; -1 if there is none.

    A list holds `buckets` rows at most.
    """
    try:
        lists = spark.read.schema("bucket int, buckets int, written long, version long").parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, 0, {}
    lists = lists if below is None else lists.where(F.col("version") < below)
    newest = lists.agg(F.max("version")).first()[0]
    if newest is None:
        return -1, 0, {}
    rows = lists.where(F.col("version") == newest).collect()
    return newest, rows[0].buckets, {r.bucket: r.written for r in rows if r.bucket is not None}


def _publish(spark: SparkSession, path: str, version: int, n: int, written: dict[int, int]) -> None:
    rows = [(b, n, v) for b, v in sorted(written.items())] or [(None, n, None)]
    spark.createDataFrame(rows, "bucket int, buckets int, written long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}")


def _write(rows: DataFrame, path: str, version: int, key: list[str], n: int) -> None:
    held = rows.withColumn("bucket", _bucket(key, n))
    held.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")


def _rows(spark: SparkSession, path: str, schema, written: dict[int, int], only: set[int] | None = None) -> DataFrame:
    """The rows of some buckets, or of all."""
    parts = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(written.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def create(rows: DataFrame, path: str, key: list[str], n: int = BUCKETS) -> None:
    """Version 0 of a table with these rows."""
    _write(rows, path, 0, key, n)
    _publish(rows.sparkSession, path, 0, n, dict.fromkeys(_touched(rows, key, n), 0))


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of a given one. schema: the table's, without the bucket."""
    return _rows(spark, path, schema, _versions(spark, path, None if version is None else version + 1)[2])


def _touched(rows: DataFrame, key: list[str], n: int) -> set[int]:
    return {r.bucket for r in rows.select(_bucket(key, n)).distinct().collect()}


def change(spark: SparkSession, path: str, schema, key: list[str], changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None, n: int = BUCKETS) -> int:
    """A new version in which how(old rows, changes) stands for the buckets that changes fall into; gives its number.

    how must leave rows of other keys as they are. number: the version to write, else the next one. A table that isn't
    there yet is empty.
    """
    last, buckets, written = _versions(spark, path, number)
    n = buckets or n
    version = last + 1 if number is None else number
    touched = _touched(changes, key, n)
    if not touched:
        _publish(spark, path, version, n, written)
        return version
    new = how(_rows(spark, path, schema, written, touched), changes).select(*schema_names(schema))
    _write(new, path, version, key, n)
    there = {r.bucket for r in spark.read.parquet(f"{path}/data/version={version}").select("bucket").distinct().collect()} if _has_rows(spark, path, version) else set()
    _publish(spark, path, version, n, {b: v for b, v in written.items() if b not in touched} | dict.fromkeys(there, version))
    return version


def schema_names(schema) -> list[str]:
    from pyspark.sql.types import StructType

    return (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names


def _has_rows(spark: SparkSession, path: str, version: int) -> bool:
    try:
        spark.read.parquet(f"{path}/data/version={version}")
    except AnalysisException as empty:  # nothing but the mark that the write ended
        if empty.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return False
    return True


def upsert(key: list[str], version: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """U3, S14 as a change."""
    return lambda old, new: tables.upsert(old, new.select(*old.columns), key, version)


def insert_ignore(key: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """U2 as a change."""
    return lambda old, new: tables.insert_ignore(old, new, key)


def update(key: list[str], allowed: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """U4 as a change."""
    return lambda old, patch: tables.keyed_update(old, patch, key, allowed)


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    """U5 as a change."""
    return tables.keyed_delete(old, keys)


def replace(group: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """U10 as a change of a table with buckets by its group."""
    return lambda old, new: tables.replace_group(old, new, group)
