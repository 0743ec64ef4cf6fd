"""Stored tables in buckets of their key: a batch of changes reads and rewrites only the buckets that it touches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import delete, written
from .tables import guarded_upsert, replace_by_key


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def _save(df: DataFrame, path: str, key: str, buckets: int, tasks: int) -> None:
    rows = df.withColumn("bucket", _bucket(key, buckets)).repartition(tasks, "bucket").sortWithinPartitions("bucket", key)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Writes a table anew. Rows of one key lie in one bucket; null keys are a bucket's too."""
    spark = df.sparkSession
    delete(spark, f"{path}/rows")
    about = spark.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(df.schema.json()).alias("schema"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    _save(df, path, key, buckets, buckets)


def _about(spark: SparkSession, path: str) -> tuple[str, int, str]:
    row = spark.read.parquet(f"{path}/about").first()
    return row["key"], row["buckets"], row["schema"]


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets: only their files are listed for the scan."""
    fields = T.StructType.fromJson(json.loads(_about(spark, path)[2])).fields
    rows = spark.read.schema(T.StructType([*fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/rows")
    return (rows.where(F.col("bucket").isin(only)) if only is not None else rows).drop("bucket")


def _rewrite(spark: SparkSession, path: str, after: DataFrame, touched: list[int]) -> None:
    """after holds all rows of the touched buckets; it is stored before their files are replaced."""
    key, buckets, _ = _about(spark, path)
    now = written(after, "buckets")
    left = {r[0] for r in now.select(_bucket(key, buckets)).distinct().collect()}
    if left:
        _save(now, path, key, buckets, len(touched))
    for b in set(touched) - left:  # a bucket without rows isn't replaced by a write
        delete(spark, f"{path}/rows/bucket={b}")


def _touched(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of some rows' keys, at most `buckets` numbers."""
    return sorted(r[0] for r in rows.select(_bucket(key, buckets)).distinct().collect())


def upsert(path: str, incoming: DataFrame, guards: list[str], keep_nonempty: list[str] = (), first: list[str] = ()) -> DataFrame:
    """tables.guarded_upsert on a stored table; returns the conflicts. One incoming row per key."""
    spark = incoming.sparkSession
    key, buckets, _ = _about(spark, path)
    incoming = written(incoming, "incoming")
    touched = _touched(incoming, key, buckets)
    after, conflicts = guarded_upsert(read(spark, path, touched), incoming, key, guards, keep_nonempty, first)
    conflicts = written(conflicts, "conflicts")
    if touched:
        _rewrite(spark, path, after, touched)
    return conflicts


def replace(path: str, new: DataFrame, touched: DataFrame | None = None) -> list[int]:
    """tables.replace_by_key on a stored table, whose key is the parent's; returns the buckets that were rewritten."""
    spark = new.sparkSession
    key, buckets, _ = _about(spark, path)
    new = written(new, "incoming")
    keys = new.select(key) if touched is None else new.select(key).unionByName(touched.select(key))
    numbers = _touched(keys, key, buckets)
    if numbers:
        _rewrite(spark, path, replace_by_key(read(spark, path, numbers), new, key, touched), numbers)
    return numbers
