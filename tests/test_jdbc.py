"""Tables behind JDBC: Spark's own in-process database, read by several connections."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from botlake.schemas import TABLES
from botlake.sources import tables


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex}"


def test_a_table_is_read_by_ranges_of_its_id(spark, url):
    rows = spark.range(1000).select(
        "id", F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit(dt.datetime(2024, 1, 1))).alias("at"), F.lit("o").alias("org_id"), *[F.lit("x").alias(c) for c in ("user_id", "source", "item_type", "item_id", "model")],
        F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit("0.5").cast("decimal(18,6)").alias("cost_usd"), F.lit("0.25").cast("decimal(31,12)").alias("charged_usd"),
    )
    rows.write.jdbc(f"{url};create=true", "llm_usage")
    got = tables.read_table(spark, "llm_usage", url, "jdbc", partitions=5)
    assert got.rdd.getNumPartitions() == 5 and dict(got.dtypes)["charged_usd"] == "decimal(38,12)"
    assert got.count() == 1000 and got.agg(F.sum("id"), F.sum("charged_usd")).first()[:] == (499500, 250)
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 5 and max(parts) <= 250
    assert tables.read_table(spark, "llm_usage", url, "jdbc").where("id = 7").first()["at"] == dt.datetime(2024, 1, 1, 0, 7)


def test_text_ids_go_by_time_and_empty_tables_by_one(spark, url):
    assert tables.split_column("chat_sessions") == "started_at" and tables.split_column("llm_usage") == "id" and tables.split_column("access_grants") is None
    sessions = spark.createDataFrame([(f"s{i}", "a", "widget", None, '[{"role":"user","content":"hi"}]', dt.datetime(2024, 1, 1 + i % 20), None) for i in range(60)], TABLES["chat_sessions"])
    sessions.write.jdbc(f"{url};create=true", "chat_sessions")
    sessions.limit(0).write.jdbc(url, "empty_sessions")
    got = tables.read_table(spark, "chat_sessions", url, "jdbc", partitions=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 60 and got.first()["messages"][0]["content"] == "hi"
    spark.createDataFrame([], TABLES["access_grants"]).write.jdbc(url, "access_grants")
    grants = tables.read_table(spark, "access_grants", url, "jdbc")
    assert grants.rdd.getNumPartitions() == 1 and grants.count() == 0
