"""Structured Streaming jobs: dedupe, bursts, counters, triggers, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import money, tables, triggers
from ..sources.tables import guarded_upsert


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone: wall clocks without zone are taken as UTC."""
    return stream.withColumn(column, F.to_timestamp_ltz(F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))))


def dedupe_messages(stream: DataFrame, keep: str = "3 days", late_minutes: int = 10) -> DataFrame:
    """The first delivery of every (number, message id) within `keep`, with `late`: too old for a turn when it arrived (it is stored all the same)."""
    late = F.unix_micros(F.to_timestamp_ltz("arrived_at")) - F.unix_micros(F.to_timestamp_ltz("ts")) > late_minutes * 60_000_000
    return stream.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["number_id", "wa_id"]).withColumn("late", late)


def stream_bursts(stream: DataFrame, gap: str = "4 seconds", delay: str = "1 minute") -> DataFrame:
    """Bursts of one chat as session windows: count, text in order, addressed if any is."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))), lambda m: m["text"]), "\n")
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "number_id", "chat").agg(F.count("*").alias("messages"), F.max("addressed").alias("addressed"), text.alias("text")).select("number_id", "chat", F.col("w.start").alias("started"), "messages", "addressed", "text")


def stream_spend(usage: DataFrame, delay: str = "1 day") -> DataFrame:
    """Month counters of charged usage in four scopes; late rows count within the watermark."""
    return money.spend_scopes(usage.withWatermark("at", delay)).groupBy("scope", "key", F.date_trunc("month", "at").alias("month")).agg(F.sum("amount").alias("spent_usd"))


def stream_rates(stream: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per key in tumbling (or sliding) windows."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def stream_triggers(stream: DataFrame, automations: DataFrame) -> DataFrame:
    """Row triggers of a stream of added rows: a stream-static join."""
    return tables.row_triggers(stream, automations)


def stream_message_triggers(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """Message triggers of a stream of messages: the rules are a table, and no message meets a join or a state."""
    return triggers.match_messages(stream, rules)


def upsert_sink(read_current, write, key: str, guards: list[str]):
    """A foreachBatch function that upserts every batch into a table by guarded_upsert; read_current() and write(df) are the table."""

    def run(batch: DataFrame, _: int) -> None:
        after, _conflicts = guarded_upsert(read_current(), batch, key, guards)
        write(after)

    return run
