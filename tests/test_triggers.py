"""Message triggers: one pass over the text against the join, and the stream against the batch."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from botlake.operators import triggers
from botlake.streaming import streams

RULES = "trigger_id string, number_id string, senders array<string>, match string, words string"
TEXTS = "id long, number_id string, phone string, text string"


def tables(spark, rules, texts):
    rng = random.Random(rules)
    word = lambda: "".join(rng.choices("ab AB", k=rng.randrange(0, 5)))
    number = lambda: None if rng.random() < 0.03 else str(0 if rng.random() < 0.34 else rng.randrange(4))
    r = [(f"t{i}", number(), rng.choice([None, [], ["p1"], ["p1", "p2", None]]), rng.choice(["any", "contains", "starts", None]) if i % 9 == 0 else rng.choice(["contains", "starts"]), rng.choice([None, word()])) for i in range(rules)]
    m = [(i, number(), rng.choice([None, "p1", "p2", "p3"]), rng.choice([None, "", "  ", " ".join(word() for _ in range(6)), " ÀÉ abba İstanbul"])) for i in range(texts)]
    return spark.createDataFrame(r, RULES), spark.createDataFrame(m, TEXTS)


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("rules, texts", [(0, 5), (60, 200), (300, 0)])
def test_one_pass_fires_what_the_join_fires(spark, monkeypatch, rules, texts):
    r, m = tables(spark, rules, texts)
    got = triggers.match_messages(m, r)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    got = rows(got)
    monkeypatch.setattr(triggers, "MOST_TRIGGERS", -1 if not rules else 0)
    assert got == rows(triggers.match_messages(m, r)) and (not rules or not texts or len(got) > 100)


def test_ten_thousand_words_on_one_number(spark):
    r = spark.range(10_000).select(F.concat(F.lit("t"), "id").alias("trigger_id"), F.lit("1").alias("number_id"), F.lit(None).cast("array<string>").alias("senders"), F.lit("contains").alias("match"), F.concat(F.lit("Word"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("words"))
    m = spark.range(300).select("id", F.lit("1").alias("number_id"), F.lit("p").alias("phone"), F.concat(F.lit("say WORD"), F.lpad((F.col("id") * 7).cast("string"), 5, "0"), F.lit(" now")).alias("text"))
    assert rows(triggers.match_messages(m, r)) == {(i, f"t{7 * i}"): 1 for i in range(300)}


def test_the_stream_fires_what_the_batch_fires(spark, tmp_path):
    r, m = tables(spark, 80, 300)
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_message_triggers(stream, r).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert rows(spark.table("fired")) == rows(triggers.match_messages(m, r))
