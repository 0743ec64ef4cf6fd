"""Spend admission in parallel against the sequential walk over all calls."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from botlake.streaming import stateful

ZERO = pd.Timestamp("2024-01-01")


def calls(seed, n, orgs=4, seconds=3000):
    """Events of n calls: most settle, some are released, some lapse; ties in time, calls without an organization or platform scope."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        org = None if rng.random() < 0.05 else f"o{0 if rng.random() < 0.34 else rng.randrange(orgs)}"
        scopes = [("platform", "")] if rng.random() < 0.95 else []
        scopes += [("item", f"{org}:i{rng.randrange(3)}")] if rng.random() < 0.6 else []
        scopes += [("member", f"{org}:m{rng.randrange(5)}")] if rng.random() < 0.5 else [("org-public", org or "")]
        at, cost = rng.randrange(seconds), rng.choice([0.01, 0.2, 0.5, 1.25])
        out.append((2 * i, at, "ask", i, org, scopes, cost * 2, 0.0))
        end = rng.random()
        if end < 0.85:
            kind = "settle" if end < 0.7 else "release"
            out.append((2 * i + 1, at + rng.choice([0, 20, 300, 900]), kind, i, org, scopes, 0.0, cost if kind == "settle" else 0.0))
    return out


CAPS = [("item", f"o{k}:i{j}", f"o{k}", 8.0) for k in range(4) for j in range(2)] + [("member", f"o{k}:m1", f"o{k}", 3.0) for k in range(4)] + [("org-public", "o1", "o1", 10.0)]
BILLING = [("o0", 50.0), ("o2", 25.0), ("o3", None)]
SCHEMA = "id long, s int, kind string, call long, org_id string, scopes array<struct<scope:string,key:string>>, estimate double, actual double"


def walked(rows, cap):
    events = pd.DataFrame([{"id": i, "us": s * stateful.SECOND, "kind": k, "call": c, "org_id": o, "scopes": sc, "estimate": e, "actual": a} for i, s, k, c, o, sc, e, a in sorted(rows, key=lambda r: (r[1], r[2], r[0]))])
    caps = {(s, k): v for s, k, _, v in CAPS} | ({("platform", ""): cap} if cap is not None else {})
    found = stateful.admit_group(events, caps, {o: b for o, b in BILLING if b is not None})
    return {r.id: r.refusal for r in found.itertuples()}


def admitted(spark, rows, cap):
    events = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.lit("1970-01-01").cast("timestamp_ntz")))
    caps = spark.createDataFrame(CAPS, "scope string, key string, org_id string, cap_usd double")
    return {r["id"]: r["refusal"] for r in stateful.admit_calls(events, caps, spark.createDataFrame(BILLING, "org_id string, balance_usd double"), cap).collect()}


@pytest.mark.parametrize("seed, cap", [(1, 40.0), (2, 90.0), (3, 1e6), (4, 0.0), (5, 60.0)])
def test_a_platform_cap_in_parallel_is_the_sequential_walk(spark, seed, cap):
    rows = calls(seed, 400)
    want = walked(rows, cap)
    assert admitted(spark, rows, cap) == want
    if cap in (40.0, 60.0, 90.0):
        assert {"platform", None} <= set(want.values())


def test_all_five_refusals_and_no_cap(spark):
    rows = calls(8, 500)
    assert admitted(spark, rows, None) == walked(rows, None)
    want = walked(rows, 120.0)
    assert admitted(spark, rows, 120.0) == want and set(want.values()) == {None, *stateful.ORDER}


def test_only_the_open_stretch_is_one_group(spark, monkeypatch):
    """Far from the cap nothing is walked jointly; near it, what lies between the bounds alone."""
    sizes = []
    plain = stateful._walk
    monkeypatch.setattr(stateful, "_walk", lambda rows, caps, balances, joint: sizes.append((joint, rows.count())) or plain(rows, caps, balances, joint))
    rows = calls(9, 300)
    admitted(spark, rows, 1e6)
    assert [joint for joint, _ in sizes] == [False]
    sizes.clear()
    admitted(spark, rows, 60.0)
    assert [joint for joint, _ in sizes] == [False, True, False] and sizes[1][1] < len(rows) / 2


@pytest.mark.parametrize("cap", [None, 60.0])
def test_no_group_of_a_stretch_grows_with_the_table(spark, monkeypatch, cap):
    """Stretches are cut between bins, the joint one too; sums and open holds go on from one to the next."""
    monkeypatch.setattr(stateful, "MOST_WALKED", 60, raising=False)
    monkeypatch.setattr(stateful, "BIN_ROWS", 10, raising=False)
    sizes = []
    plain = stateful._walk

    def walk(rows, caps, balances, joint):
        groups = rows.where("kind <> 'hold'").groupBy("org_id").count().collect()
        sizes.append(sum(r["count"] for r in groups) if joint else max((r["count"] for r in groups), default=0))
        return plain(rows, caps, balances, joint)

    monkeypatch.setattr(stateful, "_walk", walk)
    rows = calls(12, 500)
    assert admitted(spark, rows, cap) == walked(rows, cap)
    assert len(sizes) >= 6 and max(sizes) <= 60
