"""Ordered jobs over bins and sweeps against plain loops, with one key that holds a third of all rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from botlake.operators import bins, chats, groups, tables

START = dt.datetime(2024, 1, 1)


def messages(seed, n, keys=9, step=900):
    """(number_id, chat, phone, id, ts, from_me, ended): times with ties, one busy key, null keys."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if rng.random() < 0.34 else rng.randrange(keys)
        out.append((None if k == 7 else str(k % 3), str(k), f"p{rng.randrange(4)}", i, START + dt.timedelta(seconds=rng.randrange(n * step // 10) // 30 * 30), rng.random() < 0.3, rng.random() < 0.05))
    return out


SCHEMA = "number_id string, chat string, phone string, id long, ts timestamp_ntz, from_me boolean, ended boolean"


@pytest.mark.parametrize("n", [0, 1, 800])
def test_islands_and_positions(spark, n):
    rows = messages(1, n)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["session"] for r in chats.sessionize(df, ["number_id", "chat"], 10).collect()}
    at = {r["id"]: r["pos"] for r in bins.positions(df.withColumn("_k", F.col("id")), ["number_id", "chat"], "_k", ["id"], "pos", 40).collect()}
    want, places, by = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        last = by.get(r[:2])
        s = 1 if last is None else last[1] + (last[2] or r[4] - last[0] > dt.timedelta(minutes=10))
        by[r[:2]] = (r[4], s, r[6])
        want[r[3]] = s
    for r in rows:
        places.setdefault(r[:2], []).append(r[3])
    assert got == want and at == {i: k for ids in places.values() for k, i in enumerate(ids)}


def test_no_bin_holds_much_more_than_its_share(spark):
    """A key with a third of all rows is cut like the rest."""
    df = spark.createDataFrame(messages(2, 6000), SCHEMA).withColumn("_us", chats.micros(F.col("ts")))
    sizes = df.withColumn("b", bins.bin_of(df, "_us", 50)).groupBy("number_id", "chat", "b").count().agg(F.max("count")).first()[0]
    assert df.groupBy("number_id", "chat").count().agg(F.max("count")).first()[0] > 1900 and sizes < 150


@pytest.mark.parametrize("count", [1, 7, 64])
def test_counts_before(spark, count):
    rows = messages(3, 700) + [(None, "x", "p", 9000, None, False, False)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_us", chats.micros(F.col("ts")))
    got = bins.counts_before(df, ["number_id", "chat"], "_us", 3600 * 10**6, {"n": F.lit(1).cast("long"), "mine": F.col("from_me").cast("long")}, count).collect()
    assert len(got) == len(rows)
    for r in got:
        met = [m for m in rows if m[:2] == (r["number_id"], r["chat"]) and m[4] and r["ts"] and dt.timedelta() < r["ts"] - m[4] < dt.timedelta(hours=1)]
        assert (r["n"], r["mine"]) == (len(met), sum(m[5] for m in met))


@pytest.mark.parametrize("ordered", [True, False])
def test_recaps(spark, monkeypatch, ordered):
    monkeypatch.setattr(groups, "BLOCK", 4)
    monkeypatch.setattr(groups, "STRETCH", 3)
    rng = random.Random(5)
    rows = messages(4, 900)
    if ordered:  # ids rise with times, as stored messages do
        rows = [(*r[:3], i, *r[4:]) for i, r in enumerate(sorted(rows, key=lambda r: r[4]))]
    rows.append((None, "1", "p1", 7777, None, False, False))
    asks = [(i, r[0], r[1], r[2], r[4], rng.choice([1, 5, 48])) for i, r in enumerate(rng.sample(rows[:900], 80))]
    joins = [(r[0], r[1], r[2], r[4]) for r in rng.sample(rows[:900], 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = groups.recap_messages(
        spark.createDataFrame(asks, "request_id long, number_id string, chat string, phone string, asked_at timestamp_ntz, hours int"),
        df, spark.createDataFrame(joins, "number_id string, chat string, phone string, joined_at timestamp_ntz"), 10,
    )
    want = set()
    for i, number, chat, phone, asked, hours in asks:
        joined = [j[3] for j in joins if j[:3] == (number, chat, phone)]
        own = [r[4] for r in rows if r[:3] == (number, chat, phone) and not r[5] and r[4]]
        first = max(joined) if joined else min(own) if own else None
        if number is None:  # nothing joins a null number: no join time, and no messages
            continue
        start = max(t for t in (asked - dt.timedelta(hours=hours), first) if t)
        met = sorted((r for r in rows if r[:2] == (number, chat) and r[4] and r[4] > start), key=lambda r: -r[3])[:10]
        want |= {(i, r[3], r[4]) for r in met}
    assert {tuple(r) for r in got.collect()} == want and want


def plain_matches(rows, waits):
    out, used = set(), set()
    for number, phone, i, ts, answer in sorted(rows, key=lambda r: (r[3], r[2])):
        met = [w for w in waits if w[1:3] == (number, phone) and w[4] <= ts <= w[5] and (w[3] == "reply" or answer) and (w[1:3], w[0]) not in used]
        if met:
            w = min(met, key=lambda w: (w[3] != "approval", w[4], w[0]))
            used.add((w[1:3], w[0]))
            out.add((i, w[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_replies_are_matched_in_one_sweep(spark, seed):
    rng = random.Random(seed)
    when = lambda: START + dt.timedelta(minutes=rng.randrange(3000))
    person = lambda: ("1", "hot") if rng.random() < 0.34 else (str(rng.randrange(2)), f"p{rng.randrange(6)}")
    rows = [(*person(), i, when(), rng.choice([None, "yes"])) for i in range(500)]
    waits = []
    for i in range(400):
        start = when()
        waits.append((i if rng.random() < 0.9 else i // 2, *person(), rng.choice(["reply", "approval", "timer"]), start, start + dt.timedelta(minutes=rng.choice([0, 5, 60, 4000]))))
    got = tables.match_replies(
        spark.createDataFrame([*rows, (None, "x", 900, when(), "yes"), ("1", "hot", 901, None, "yes")], "number_id string, phone string, id long, ts timestamp_ntz, answer string"),
        spark.createDataFrame([*waits, (900, None, "x", "reply", START, when()), (901, "1", "hot", "reply", None, None)], "run_id long, number_id string, phone string, kind string, started_at timestamp_ntz, until timestamp_ntz"),
    )
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_matches(rows, waits) and len(found) > 50


def test_a_hot_person_holds_open_waits_only():
    state = tables.OpenWaits()
    state.add(0, 0, 10**12, "reply", 10**6, False)  # one that waits for good
    for n in range(1, 20_000):
        state.add(n, n, n + 5, "approval", n, False)
        state.answer(n, False) if n == 1 else state.answer(n, True)
        assert len(state.live) < 10 and sum(map(len, state.by_age.values())) < 200


def test_outbox_plan_sends_the_first_five(spark):
    rows = [(i, None if i % 5 == 0 else "1", "queued" if i % 3 else "sent", START + dt.timedelta(seconds=i)) for i in range(100)]
    got = groups.outbox_plan(spark.createDataFrame(rows, "id long, number_id string, status string, created_at timestamp_ntz"), "2024-01-02 00:00:00").collect()
    queued = {n: [r[0] for r in rows if r[1] == n and r[2] == "queued"][:5] for n in (None, "1")}
    assert {r["id"] for r in got if r["step"] == "send"} == {*queued[None], *queued["1"]} and len(got) == 100
