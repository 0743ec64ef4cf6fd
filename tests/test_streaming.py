"""Streams over files against their batch twins."""

from __future__ import annotations

import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

from botlake.operators import chats, money, tables
from botlake.plans.inputs import view
from botlake.streaming import stateful, streams


@pytest.fixture(scope="module")
def messages(spark, sf, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("stream") / "messages")
    m = view(spark, sf, "messages").withColumn("success", F.col("id") % 5 == 0).withColumn("addressed", F.col("id") % 3 == 0)
    streams.event_time(streams.event_time(m), "arrived_at").repartitionByRange(3, "id").write.parquet(where)
    return where


def collect(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def read(spark, where):
    return spark.readStream.schema(spark.read.parquet(where).schema).parquet(where)


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_rate_limit(spark, messages, tmp_path):
    batch = spark.read.parquet(messages)
    got = collect(spark, stateful.stream_rate_limit(read(spark, messages).withColumn("bucket", F.col("phone")).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 3, 86_400, 86_400), tmp_path, "limits")
    want = stateful.rate_limit(batch.withColumn("bucket", F.col("phone")).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 3, 86_400, 86_400)
    assert rows(got.select("bucket", "id", "refused")) == rows(want.select("bucket", "id", "refused"))


def test_sessions_with_ended_marks(spark, messages, tmp_path):
    batch = spark.read.parquet(messages).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = collect(spark, stateful.stream_sessions(read(spark, messages).withColumn("ts", F.col("ts").cast("timestamp_ntz"))), tmp_path, "sessions")
    want = chats.sessionize(batch, ["phone"]).select("phone", "id", "session")
    assert rows(got.select("phone", "id", "session")) == rows(want)


def test_dedupe(spark, messages, tmp_path):
    got = collect(spark, streams.dedupe_messages(read(spark, messages)).select("number_id", "wa_id"), tmp_path, "dedupe")
    assert rows(got) == rows(spark.read.parquet(messages).select("number_id", "wa_id").distinct())


def test_rates(spark, messages, tmp_path):
    got = collect(spark, streams.stream_rates(read(spark, messages), "chat", "1 hour"), tmp_path, "rates", "complete")
    want = spark.read.parquet(messages).groupBy("chat", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"))
    assert rows(got.select("chat", "start", "n")) == rows(want)


def test_spend(spark, sf, tmp_path):
    where = str(tmp_path / "usage")
    usage = streams.event_time(money.charge_usage(view(spark, sf, "llm_usage"), view(spark, sf, "org_billing")), "at")
    usage.write.parquet(where)
    stream = spark.readStream.schema(spark.read.parquet(where).schema).parquet(where)
    got = collect(spark, streams.stream_spend(stream).select("scope", "key", "spent_usd"), tmp_path, "spend", "complete")
    assert rows(got) == rows(money.month_spend(spark.read.parquet(where)).select("scope", "key", "spent_usd"))


def test_bursts(spark, messages, tmp_path):
    got = collect(spark, streams.stream_bursts(read(spark, messages), "240 seconds").select("number_id", "chat", "messages"), tmp_path, "bursts", "complete")
    want = chats.merge_bursts(spark.read.parquet(messages).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["number_id", "chat"], 240.0).select("number_id", "chat", "messages")
    assert rows(got) == rows(want)


def test_loops(spark, messages, tmp_path):
    plain = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("chat", F.col("phone"))
    got = collect(spark, stateful.stream_loops(plain(read(spark, messages)), 600.0, 2, 1800), tmp_path, "loops")
    want = stateful.detect_loops(plain(spark.read.parquet(messages)), 600.0, 2, 1800)
    assert rows(got.select("chat", "id", "paused")) == rows(want.select("chat", "id", "paused"))


def test_triggers(spark, messages, tmp_path):
    automations = spark.createDataFrame([("a1", "0", "1", True), ("a2", "1", "2", True), ("a3", "0", "1", False), ("a4", "2", "3", True)], "id string, org_id string, table_id string, enabled boolean")
    added = lambda df: df.select("id", F.col("number_id").alias("org_id"), F.col("chat").alias("table_id"), F.concat(F.lit("automation:a"), (F.col("id") % 3).cast("string")).alias("written_by"))
    got = collect(spark, streams.stream_triggers(added(read(spark, messages)), automations), tmp_path, "triggers")
    want = tables.row_triggers(added(spark.read.parquet(messages)), automations)
    assert rows(got) == rows(want) and got.count() > 0


def test_upserts(spark, messages, tmp_path):
    """Batches upserted one after the other leave what one upsert of the newest rows leaves."""
    state = {"df": spark.createDataFrame([("0", "x", "kept")], "phone string, number_id string, text string")}

    def write(df):
        path = str(tmp_path / f"table{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        state["df"] = spark.read.parquet(path)

    one = read(spark, messages).select("phone", "number_id", "text").dropDuplicates(["phone"])
    q = one.writeStream.foreachBatch(streams.upsert_sink(lambda: state["df"], write, "phone", ["number_id"])).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    after = {r["phone"]: (r["number_id"], r["text"]) for r in state["df"].collect()}
    known = {r["phone"] for r in spark.read.parquet(messages).select("phone").distinct().collect()}
    assert set(after) == known | {"0"} and after["0"] == ("x", "kept")


def test_admission_refuses_in_order():
    """Each of the five refusals, a settled hold, and a hold that lapsed after ten minutes."""
    minute, n = 60 * stateful.SECOND, iter(range(100))
    scopes = [["platform", ""], ["org-public", "o"], ["item", "o:i"], ["member", "o:m"]]
    event = lambda at, kind, call, estimate=0.0, actual=0.0, of=scopes: {"id": next(n), "us": at, "kind": kind, "call": call, "org_id": "o", "scopes": of, "estimate": estimate, "actual": actual}

    def refusals(events, caps, balances):
        return stateful.admit_group(pd.DataFrame(events), caps, balances)["refusal"].tolist()

    caps = {("platform", ""): 10.0, ("org-public", "o"): 8.0, ("item", "o:i"): 4.0, ("member", "o:m"): 2.0}
    asks = [event(0, "ask", k, e) for k, e in enumerate((11.0, 9.0, 5.0, 3.0, 1.0))]
    assert refusals(asks, caps, {}) == ["platform", "org-public", "item", "member", None]
    assert refusals([event(0, "ask", 1, 6.0)], caps, {"o": 5.0}) == ["balance"]
    held = [event(0, "ask", 1, 1.5), event(1, "ask", 2, 1.0), event(2, "settle", 1, actual=0.5), event(3, "ask", 3, 1.5), event(11 * minute, "ask", 4, 1.5)]
    assert refusals(held, caps, {}) == [None, "member", None, None]


def test_a_key_may_span_batches(spark):
    """One hot key, a null key and small ones, dealt in batches of seven rows, against the step function by hand."""
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i, i * 97 % 400, i % 4 == 0) for i in range(400)]
    events = spark.createDataFrame(rows, "bucket string, id long, s int, success boolean").withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.lit("2024-01-01").cast("timestamp_ntz")))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["id"]: r["refused"] for r in stateful.rate_limit(events, 3, 60, 30).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    states, want = {}, {}
    for key, i, s, success in sorted(rows, key=lambda r: (r[2], r[1])):
        states[key], want[i] = stateful.limiter_step(states.get(key, (0, None, None)), s * 1_000_000, success, 3, 60, 30)
    assert got == want and set(want.values()) == {True, False}
    assert stateful.rate_limit(events.limit(0)).count() == 0


def test_a_platform_cap_orders_all_calls(spark):
    """Two organizations share the platform's cap; a settled call gives its hold back."""
    of = "array(struct('platform' as scope, '' as key))"
    rows = [(1, 0, "ask", 1, "a", 6.0, 0.0), (2, 1, "ask", 2, "b", 5.0, 0.0), (3, 2, "settle", 1, "a", 0.0, 1.0), (4, 3, "ask", 3, "b", 5.0, 0.0)]
    events = spark.createDataFrame(rows, "id long, s int, kind string, call long, org_id string, estimate double, actual double")
    events = events.withColumn("scopes", F.expr(of)).withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.lit("2024-01-01").cast("timestamp_ntz")))
    caps = spark.createDataFrame([], "scope string, key string, org_id string, cap_usd double")
    billing = spark.createDataFrame([("b", 100.0)], "org_id string, balance_usd double")
    got = {r["id"]: r["refusal"] for r in stateful.admit_calls(events, caps, billing, 10.0).collect()}
    assert got == {1: None, 2: "platform", 4: None}
    assert {r["id"]: r["refusal"] for r in stateful.admit_calls(events, caps, billing).collect()} == {1: None, 2: None, 4: None}
