"""Jobs whose tasks grew with one key, or whose rows did far more than their share: plans, and results against plain statements."""

from __future__ import annotations

import datetime as dt
import decimal
import zoneinfo

import pytest
from pyspark.sql import functions as F

from botlake.operators import knowledge, money, schedule


def slow_next_run(row, now, days=400):
    """The earliest of all candidate days of a schedule, one by one."""
    zone, utc = zoneinfo.ZoneInfo(row["timezone"] or "UTC"), dt.timezone.utc
    today = now.replace(tzinfo=utc).astimezone(zone).date()
    last = lambda d: ((d.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)).day
    found = []
    for n in range(days + 1):
        d = today + dt.timedelta(n)
        if row["repeat"] == "weekly" and (d.weekday() + 1) % 7 not in (row["weekdays"] or []):
            continue
        if row["repeat"] == "monthly" and d.day != min(1 if row["month_day"] is None else row["month_day"], last(d)):
            continue
        at = dt.datetime.combine(d, dt.time.fromisoformat(row["at_time"]), zone)
        offset = at.utcoffset()
        found.append((at.replace(tzinfo=None) - offset))
    return min((x for x in found if x > now), default=None)


@pytest.mark.parametrize("as_of", ["2024-01-31 23:30:00", "2024-02-29 12:00:00", "2023-12-31 00:00:00", "2024-03-30 23:59:59"])
@pytest.mark.parametrize("days", [400, 5])
def test_next_group_runs_of_every_day(spark, as_of, days):
    zones, rows = ["UTC", "Asia/Jerusalem", "Pacific/Kiritimati", "America/Adak", None], []
    for i, zone in enumerate(zones):
        for at in ("00:00", "12:00", "23:59", "13:30"):
            rows += [(zone, at, "daily", None, None), (zone, at, None, None, None)]
            rows += [(zone, at, "weekly", w, None) for w in ([0], [1, 3], [6], [5], [4], [2], [], None, [7])]
            rows += [(zone, at, "monthly", None, m) for m in (None, 0, -3, 1, 15, 28, 29, 30, 31, 40)]
    rows = [(i, repeat, "2024-01-01", at, w, m, zone) for i, (zone, at, repeat, w, m) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, repeat string, on_date string, at_time string, weekdays array<int>, month_day int, timezone string")
    got = {r["id"]: r["next_run_at"] for r in schedule.next_group_runs(df, as_of, days).collect()}
    now = dt.datetime.fromisoformat(as_of)
    assert got == {r["id"]: slow_next_run(r, now, days) for r in df.collect()}


def test_next_group_runs_tries_few_days(spark):
    """A day's text, cast and zone are the work of a row: no row tries hundreds of days."""
    df = spark.createDataFrame([(1, "daily", "2024-01-01", "10:00", [1], 1, "UTC")], "id long, repeat string, on_date string, at_time string, weekdays array<int>, month_day int, timezone string")
    plan = schedule.next_group_runs(df, "2024-01-15 12:00:00")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" in plan and " 400), None" not in plan


def test_limit_audit_spreads_the_platform(spark):
    """The platform's only key has all calls: no task of the windows takes more than a few bins of it."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "o1", None, "home", None, None, decimal.Decimal("0.01"), decimal.Decimal("0.01")) for i in range(4000)]
    usage = spark.createDataFrame(rows, "id long, at timestamp_ntz, org_id string, user_id string, source string, item_type string, item_id string, cost_usd decimal(18,6), charged_usd decimal(18,6)")
    caps = spark.createDataFrame([("platform", "", 20.0), ("platform", "", 1.0)], "scope string, key string, cap_usd double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("16", "false", "-1")):
        spark.conf.set(k, v)
    try:
        out = money.limit_audit(usage, caps)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        got = sorted((r["id"], r["spent_before"], r["crossed"]) for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) > 8 and max(sizes) < 2000
    want = []
    for cap in (20.0, 1.0):
        spent, month = decimal.Decimal(0), None
        for i, at, *_ in rows:
            spent, month = (decimal.Decimal(0) if at.month != month else spent), at.month
            want.append((i, float(spent), float(spent) < cap <= float(spent + decimal.Decimal("0.01"))))
            spent += decimal.Decimal("0.01")
    assert [(i, round(s, 9)) for i, s, _ in got] == [(i, round(s, 9)) for i, s, _ in sorted(want)]
    assert sum(c for _, _, c in got) == sum(c for _, _, c in want)


@pytest.mark.parametrize("english", [False, True])
def test_search_brings_asked_words_to_units(spark, monkeypatch, english):
    """Units' words aren't shuffled by word, whatever the sizes are thought to be; past the bound they are counted first, with equal results."""
    units = spark.createDataFrame([(str(i), "a" if i % 3 else "b", f"doc {i}", "the cats run " * (i % 5 + 1) + f"w{i % 7}") for i in range(60)], "unit_id string, agent_id string, title string, content string")
    asked = spark.createDataFrame([(1, "a", "the cat runs w3"), (2, "b", "doc w5"), (3, "c", "the"), (4, "a", "")], "query_id long, agent_id string, question string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = knowledge.search(units, asked, english=english)
        assert "BroadcastHashJoin [agent_id" in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(knowledge, "SMALL", 0)
    assert len(got) == 12 and got == sorted(map(tuple, knowledge.search(units, asked, english=english).collect()))


def test_lexemes_are_counted_where_texts_are_read(spark, monkeypatch):
    """One shuffle; rows that share a key (null too) are summed, null and empty texts have no lexemes, counts in several batches stay whole."""
    monkeypatch.setattr(knowledge, "COUNTED", 3)
    rows = [("1", "The Cats run running runs"), ("1", "cats"), (None, "flies fly"), (None, "fly"), ("2", None), ("3", " ,. "), ("4", "the the")]
    df = spark.createDataFrame(rows, "id string, text string")
    out = knowledge.lexeme_counts(df, "id", F.col("text"))
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    want = {("1", "the"): 1, ("1", "cats"): 2, ("1", "cat"): 2, ("1", "run"): 4, ("1", "running"): 1, ("1", "runs"): 1, (None, "flies"): 1, (None, "fli"): 3, (None, "fly"): 2, ("4", "the"): 2}
    assert {(r["id"], r["lexeme"]): r["tf"] for r in out.collect()} == want
