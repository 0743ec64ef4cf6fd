"""Reading and writing the platform's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import JSON_COLUMNS, TABLES


def read_table(spark: SparkSession, name: str, path: str, kind: str = "parquet", partitions: int | None = None, **options: str) -> DataFrame:
    """A platform table with its declared schema: parquet, JSON lines, or JDBC (path: the URL); JSON columns are typed.

    A table behind JDBC is read by `partitions` connections (twice the default parallelism if not given), each a range of its split_column between its least and largest value; tables without
    such a column, and empty ones, by one. Types are the declared ones, whatever the server's.
    """
    reader = spark.read.options(**options)
    if kind != "jdbc":
        return type_json(reader.schema(TABLES[name]).format(kind).load(path), name)
    reader = reader.format("jdbc").option("url", path)
    split = split_column(name)
    if split:
        low, high = reader.option("query", f'select min("{split}") as low, max("{split}") as high from {name}').load().first()
        if low is not None and low != high:
            bounds = {"lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions or 2 * spark.sparkContext.defaultParallelism)}
            reader = spark.read.options(**options).format("jdbc").option("url", path).options(partitionColumn=split, **bounds)
        else:
            reader = spark.read.options(**options).format("jdbc").option("url", path)
    return type_json(reader.option("dbtable", name).option("customSchema", TABLES[name]).load(), name)


def split_column(name: str) -> str | None:
    """The column that ranges of a table are read by: a numeric id, else the first time column; None without either."""
    fields = T.StructType.fromDDL(TABLES[name]).fields
    ids = [f.name for f in fields if f.name == "id" and isinstance(f.dataType, T.LongType)]
    return next(iter(ids + [f.name for f in fields if isinstance(f.dataType, T.TimestampType)]), None)


def type_json(df: DataFrame, name: str) -> DataFrame:
    for (table, column), schema in JSON_COLUMNS.items():
        if table == name and column in df.columns:
            df = df.withColumn(column, F.from_json(column, schema))
    return df


def guarded_upsert(current: DataFrame, incoming: DataFrame, key: str, guards: list[str], keep_nonempty: list[str] = (), first: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(table after, conflicts): an incoming row replaces the stored one only where all guards agree.

    `keep_nonempty` columns aren't overwritten by an empty value, `first` columns keep the stored one. One
    incoming row per key. A full join on the key; null keys never meet.
    """
    columns = current.columns
    old, new = current.alias("o"), incoming.select(*columns).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, comes = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    agree = F.lit(True)
    for g in guards:
        agree = agree & F.col(f"o.{g}").eqNullSafe(F.col(f"n.{g}"))
    takes = comes & (~there | agree)

    def value(c: str):
        fresh = F.col(f"n.{c}")
        if c in keep_nonempty:
            fresh = F.when(F.coalesce(fresh.cast("string"), F.lit("")) == "", F.coalesce(F.col(f"o.{c}"), fresh)).otherwise(fresh)
        if c in first:
            fresh = F.coalesce(F.col(f"o.{c}"), fresh)
        return F.when(takes, fresh).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[value(c) for c in columns]), both.where(there & comes & ~agree).select(*[F.col(f"n.{c}").alias(c) for c in columns])


def replace_by_key(current: DataFrame, new: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """current with all children of a key replaced by its new ones; a key without new rows keeps its old ones, unless it is in `touched` (a document that now fits one chunk)."""
    keys = new.select(key).distinct()
    if touched is not None:
        keys = keys.unionByName(touched.select(key)).distinct()
    return current.join(keys, key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def number_versions(versions: DataFrame, current: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """versions with the next numbers after their parent's current largest one. current: parent, version."""
    from pyspark.sql import Window

    top = current.groupBy(parent).agg(F.max("version").alias("_m"))
    w = Window.partitionBy(parent).orderBy(*order)
    return versions.join(top, parent, "left").withColumn("version", F.coalesce("_m", F.lit(0)) + F.row_number().over(w)).drop("_m")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; only partitions with rows are replaced. Rows are dealt so that each partition has few files, and a hot one several."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
