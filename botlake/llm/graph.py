"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A local master may do without: its warehouse is in reach of all its tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base.rstrip("/")


_OPEN: list[list[DataFrame]] = []


@contextmanager
def gathered() -> Iterator[list[DataFrame]]:
    """The tables that are stored inside, to be discarded when their last reader has run."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about so many bytes for what is run (stored, counted) inside; a longer row stands alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(size, int(re.sub(r"\D", "", before)))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _OPEN:
        made.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for df in tables:
        if df is not None and getattr(df, "_stored_at", None):
            spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the smallest node reachable. A stored table.

    Each round turns every node's larger neighbours, then its smaller ones, towards its
    smallest neighbour; the number of links never grows. Minima are partial
    aggregates, and hot nodes only meet in joins that adaptive execution can split. Every round
    is written to the shared folder. It ends when a round changes nothing.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = stored(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, stored(small.where(F.col("a") != F.col("b")).distinct(), "links")
        discard(before)
    members = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = stored(members.unionByName(roots.join(members.select("node"), "node", "left_anti")), "components")
    discard(edges)
    return out
