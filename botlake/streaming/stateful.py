"""Keyed state machines, each as one step function that both the batch twin and the stream use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bins import BINS, bin_of
from ..operators.chats import micros
from ..sources.shared import written

SECOND = 1_000_000


def limiter_step(state: tuple, us: int, success: bool, limit: int, window: int, lock: int, cleared: bool = False) -> tuple[tuple, bool]:
    """State (hits, window start, locked until) after an attempt, and whether it was refused. Times in microseconds.

    Every attempt counts before its outcome is known; the window restarts at the first one after more than its length. Past the limit the key locks for `lock` seconds, which
    each further attempt over it pushes on. An attempt that succeeds (it wasn't refused) takes back what it counted, and nothing else; `cleared` forgets the key.
    """
    if cleared:
        return (0, None, None), False
    hits, start, until = state
    if start is None or us - start > window * SECOND:
        hits, start = 0, us
    hits += 1
    if hits > limit:
        until = us + lock * SECOND
    refused = until is not None and us < until
    return (hits - 1 if success and not refused else hits, start, until), refused


def loop_step(state: tuple, us: int, from_me: bool, fast: float, streak_max: int, pause: int) -> tuple[tuple, bool]:
    """State (replied at, awaiting, streak, paused until) after a message, and whether the chat is paused for it.

    Only the first message after each reply counts; within `fast` seconds it adds to the streak, slower it resets; one second of clock slack.
    """
    replied, awaiting, streak, until = state
    if from_me:
        return (us, True, streak, until), False
    if until is not None and us < until:
        return state, True
    if not awaiting or replied is None or us - replied < -SECOND:
        return state, False
    streak = streak + 1 if us - replied < fast * SECOND else 0
    if streak >= streak_max:
        return (replied, False, 0, us + pause * SECOND), True
    return (replied, False, streak, until), False


def session_step(state: tuple, us: int, ended: bool, idle: int) -> tuple[tuple, int]:
    """State (last time, session, ended) after a message, and its session number."""
    last, session, over = state
    if last is None or over or us - last > idle * SECOND:
        session += 1
    return (us, session, ended), session


def in_order(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, to: str, kind: str, parts: int | None = None) -> DataFrame:
    """(keys, id, to) of rows walked key by key in the given order; step(state, row) returns the next state and the row's value. parts: keys are dealt to so many tasks.

    Spark shuffles by key and sorts; a task walks its rows Arrow batch by Arrow batch and holds one state and one batch,
    so a key of any number of rows is bounded in memory (its rows stay sequential, as the rule is). Null keys are one key.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, start()
                state, value = step(state, row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, "id"]), pa.array(out, {"boolean": pa.bool_(), "string": pa.string()}[kind])], names=[*keys, "id", to])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['id']}", f"{to} {kind}"])
    return rows.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def replay(rows: DataFrame, keys: list[str], start: tuple, step: Callable, inputs: list[str], to: str, kind: str) -> DataFrame:
    """The batch twin: rows (keys, id, ts, inputs) of a key in (ts, id) order through step."""
    rows = rows.withColumn("_us", micros(F.col("ts"))).select(*keys, "id", "_us", *inputs)
    return in_order(rows, keys, ["_us", "id"], lambda: start, lambda s, r: step(s, r["_us"], *(r[c] for c in inputs)), to, kind)


def rate_limit(events: DataFrame, limit: int = 10, window: int = 900, lock: int = 900) -> DataFrame:
    """(bucket, id, refused) of attempts (bucket, id, ts, success, and maybe cleared: the row empties the bucket)."""
    inputs = ["success", "cleared"] if "cleared" in events.columns else ["success"]
    return replay(events, ["bucket"], (0, None, None), lambda s, us, ok, clear=False: limiter_step(s, us, ok, limit, window, lock, bool(clear)), inputs, "refused", "boolean")


def detect_loops(messages: DataFrame, fast: float = 5.0, streak: int = 4, pause: int = 1800) -> DataFrame:
    """(chat, id, paused) of messages (chat, id, ts, from_me)."""
    return replay(messages, ["chat"], (None, False, 0, None), lambda s, us, me: loop_step(s, us, me, fast, streak, pause), ["from_me"], "paused", "boolean")


def stream_state(rows: DataFrame, keys: list[str], start: tuple, state: str, step: Callable, inputs: list[str], to: str, kind: str, timeout_ms: int | None = None) -> DataFrame:
    """The streaming twin of replay(): the state outlives batches in Spark's state store; rows of one batch are taken in (ts, id) order."""
    rows = rows.withColumn("_us", micros(F.col("ts"))).select(*keys, "id", "_us", *inputs)
    kinds = dict(rows.dtypes)
    names = [f.strip().split()[0] for f in state.split(",")]

    def run(key, frames, held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        s = tuple(None if pd.isna(x) else x for x in held.get) if held.exists else start
        t = pd.concat(list(frames)).sort_values(["_us", "id"])
        out = []
        for args in zip(t["_us"].astype("int64"), *[t[c] for c in inputs]):
            s, value = step(s, *args)
            out.append(value)
        held.update(s)
        if timeout_ms:
            held.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({**{k: t[k] for k in keys}, "id": t["id"], to: out})

    assert names
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "id long", f"{to} {kind}"])
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def stream_rate_limit(events: DataFrame, limit: int = 10, window: int = 900, lock: int = 900) -> DataFrame:
    inputs = ["success", "cleared"] if "cleared" in events.columns else ["success"]
    step = lambda s, us, ok, clear=False: limiter_step(s, us, ok, limit, window, lock, bool(clear))
    return stream_state(events, ["bucket"], (0, None, None), "hits long, start long, until long", step, inputs, "refused", "boolean")


def stream_loops(messages: DataFrame, fast: float = 5.0, streak: int = 4, pause: int = 1800) -> DataFrame:
    return stream_state(messages, ["chat"], (None, False, 0, None), "replied long, awaiting boolean, streak long, until long", lambda s, us, me: loop_step(s, us, me, fast, streak, pause), ["from_me"], "paused", "boolean")


def stream_sessions(messages: DataFrame, idle: int = 1800) -> DataFrame:
    """(phone, id, session) of messages (phone, id, ts, ended): new after idle seconds or an ended mark, which a plain session window can't see."""
    return stream_state(messages, ["phone"], (None, 0, False), "last long, session long, over boolean", lambda s, us, e: session_step(s, us, e, idle), ["ended"], "session", "long")


# ---- spend admission

HOLD_SECONDS = 600


ORDER = ("platform", "org-public", "balance", "item", "member")
NANO = 10**9


class Admission:
    """What decides on the calls of one ordered group: amounts spent and held a scope, balances, caps and open holds, all in billionths of a dollar.

    Running sums make a decision cost its own scopes only; holds lie in time order, so those that lapsed are at the front.
    """

    def __init__(self, caps: dict[tuple[str, str], int], balances: dict[str, int]):
        self.caps, self.left = dict(caps), dict(balances)
        self.used: dict[tuple[str, str], int] = {}
        self.held: dict[str | None, int] = {}
        self.holds: dict[int, tuple[int, str | None, list[tuple[str, str]], int]] = {}

    def _add(self, org: str | None, scopes: list[tuple[str, str]], amount: int) -> None:
        for scope in scopes:
            self.used[scope] = self.used.get(scope, 0) + amount
        self.held[org] = self.held.get(org, 0) + amount

    def release(self, call: int) -> None:
        """Takes a call's hold back, if it has one."""
        hold = self.holds.pop(call, None)
        if hold:
            self._add(hold[1], hold[2], -hold[3])

    def hold(self, us: int, call: int, org: str | None, scopes: list[tuple[str, str]], amount: int) -> None:
        self.release(call)
        self.holds[call] = (us, org, scopes, amount)
        self._add(org, scopes, amount)

    def step(self, us: int, kind: str, call: int, org: str | None, scopes: list[tuple[str, str]], estimate: int, actual: int, barred: bool = False) -> str | None:
        """The refusal of an ask, or None; `barred`: it is known that the platform refuses. Amounts in billionths."""
        while self.holds and next(iter(self.holds.values()))[0] <= us - HOLD_SECONDS * SECOND:
            self.release(next(iter(self.holds)))
        if kind != "ask":
            self.release(call)
            if kind == "settle":
                for scope in scopes:
                    self.used[scope] = self.used.get(scope, 0) + actual
                if org in self.left:
                    self.left[org] -= actual
            return None
        found = {s[0] for s in scopes if s in self.caps and self.used.get(s, 0) + estimate > self.caps[s]} | ({"platform"} if barred else set())
        if org in self.left and self.left[org] - self.held.get(org, 0) < estimate:
            found.add("balance")
        refusal = next((name for name in ORDER if name in found), None)
        if refusal is None:
            self.hold(us, call, org, scopes, estimate)
        return refusal


def nano(dollars: float) -> int:
    return round(dollars * NANO)


def admit_group(events: pd.DataFrame, caps: dict[tuple[str, str], float], balances: dict[str, float]) -> pd.DataFrame:
    """Decisions on the asks of one ordered group: refusal or null.

    events in time order: id, us, kind (ask, settle or release), call, org_id, scopes (list of scope, key), estimate, actual. An ask
    is refused by the first of platform, org-public, balance, item, member whose spend, holds and estimate pass the cap; else
    its estimate is held on every scope until it settles, is released, or ten minutes pass.
    """
    state = Admission({k: nano(v) for k, v in caps.items()}, {k: nano(v) for k, v in balances.items()})
    out = [(e.id, e.kind, state.step(e.us, e.kind, e.call, e.org_id, [tuple(x) for x in e.scopes], nano(e.estimate), nano(e.actual))) for e in events.itertuples()]
    return pd.DataFrame([(i, refusal) for i, kind, refusal in out if kind == "ask"], columns=["id", "refusal"])


NANOS = lambda c: F.rint(F.col(c).cast("double") * NANO).cast("long")
#: Rows of a group that are walked in one stretch of the time, and rows of a bin of the first pass, about. Tasks that groups are dealt to.
MOST_WALKED, BIN_ROWS, DEALT = 1_000_000, 100_000, 96
WALKED = ["g", "id", "_us", "kind", "call", "org_id", "scopes", "estimate", "actual", "barred"]


def _walk(rows: DataFrame, caps: DataFrame, balances: DataFrame, joint: bool) -> DataFrame:
    """(id, refusal) of the asks among rows, group by group. A group's caps and balances come once, as its first rows."""
    group = F.lit("all") if joint else F.coalesce("org_id", F.lit(""))
    none = F.lit(None).cast("long")
    scope = F.array(F.struct("scope", "key"))
    first = caps.select(group.alias("g"), none.alias("id"), none.alias("_us"), F.lit("cap").alias("kind"), none.alias("call"), "org_id", scope.alias("scopes"), F.col("cap").alias("estimate"), none.alias("actual"), F.lit(False).alias("barred"))
    empty = F.array().cast("array<struct<scope:string,key:string>>")
    money = balances.select(group.alias("g"), none.alias("id"), none.alias("_us"), F.lit("balance").alias("kind"), none.alias("call"), "org_id", empty.alias("scopes"), F.col("balance").alias("estimate"), none.alias("actual"), F.lit(False).alias("barred"))
    every = rows.withColumn("g", group).select(*WALKED).unionByName(first).unionByName(money)

    def step(state: Admission, row: dict) -> tuple[Admission, str | None]:
        scopes = [(s["scope"], s["key"]) for s in row["scopes"] or []]
        if row["kind"] == "cap":
            state.caps[scopes[0]] = row["estimate"]
        elif row["kind"] == "balance":
            state.left[row["org_id"]] = row["estimate"]
        elif row["kind"] == "hold":
            state.hold(row["_us"], row["call"], row["org_id"], scopes, row["estimate"])
        else:
            refusal = state.step(row["_us"], row["kind"], row["call"], row["org_id"], scopes, row["estimate"], row["actual"], row["barred"])
            if row["kind"] == "ask":
                return state, refusal
        return state, "-"

    walked = in_order(every, ["g"], ["_us", "kind", "id"], lambda: Admission({}, {}), step, "refusal", "string", 1 if joint else DEALT)
    return walked.where("refusal is null or refusal <> '-'").select("id", "refusal")


def _screen(rows: DataFrame, bins: int) -> DataFrame:
    """rows with their bin of the time and, for asks that name the platform, high and low: the most and the least that it can have spent and held, the ask included, whatever was decided before.

    What settles doesn't depend on decisions. At most, every earlier ask is held until it settles, is released or lapses; at least, none is. Both are
    running sums over all calls, inside bins of the time and over the bins before. Rows go with their marks, so no join by id follows; every shuffle has as many parts as there are bins.
    """
    on_platform = F.exists("scopes", lambda s: s["scope"] == "platform")
    asks, settled = on_platform & (F.col("kind") == "ask"), on_platform & (F.col("kind") == "settle")
    zero = F.lit(0).cast("long")
    us, e, a = F.col("_us"), F.col("estimate"), F.col("actual")
    mark = lambda at, low, high: F.struct(at.alias("at"), low.alias("l"), high.alias("h"))
    # the hold of an ask and its end, by call; only what is needed for that is shuffled
    closed = rows.where("kind <> 'ask'").select("call", "_us").repartition(bins, "call").groupBy("call").agg(F.min("_us").alias("_c"))
    lapse = us + HOLD_SECONDS * SECOND
    closes = F.least(F.coalesce(F.when(F.col("_c") >= us, F.col("_c")), lapse), lapse)
    held = rows.where(asks).select("call", "_us", "estimate").repartition(bins, "call").join(closed, "call", "left")
    marks = held.select(F.explode(F.array(mark(us - 1, zero, e), mark(closes, zero, -e))).alias("m"))
    marks = marks.unionByName(rows.where(settled).select(F.explode(F.array(mark(us, a, zero), mark(us - 1, zero, a))).alias("m")))
    every = [F.col(c) for c in rows.columns]
    marks = marks.select("m.*", F.lit(None).cast(rows.schema).alias("row")).unionByName(rows.select(us.alias("at"), zero.alias("l"), zero.alias("h"), F.struct(*every).alias("row")))
    marks = marks.withColumn("_bin", bin_of(rows.select(us.alias("at")), "at", bins))
    over = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.groupBy("_bin").agg(F.sum("l").alias("_l"), F.sum("h").alias("_h"))
    bases = sums.select("_bin", *[F.coalesce(F.sum(c).over(over), zero).alias(c) for c in ("_l", "_h")])
    inside = Window.partitionBy("_bin").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    run = marks.repartition(bins, "_bin").withColumns({c: F.coalesce(F.sum(c).over(inside), zero) for c in ("l", "h")}).where("row is not null")
    out = run.join(F.broadcast(bases), "_bin").select("_bin", "row.*", (F.col("_h") + F.col("h")).alias("high"), (F.col("_l") + F.col("l")).alias("low"))
    return out.withColumns({"high": F.when(asks, F.col("high")), "low": F.when(asks, F.col("low") + e)})


def _stretches(rows: DataFrame, first: int | None, last: int | None) -> list[tuple[int | None, int | None, bool]]:
    """(from, to, joint) of the stretches of the time, one after the other: those before, from and after the first and last open call (joint), and each cut between bins so that no group has
    more than about MOST_WALKED rows. Per bin its bounds and its largest group's rows, with and without organizations, are what reaches the driver.
    """
    part = (F.when(F.col("_us") < first, 0).when(F.col("_us") <= last, 1).otherwise(2) if first is not None else F.lit(0)).alias("part")
    groups = rows.where(F.col("_us").isNotNull()).groupBy("_bin", part, F.coalesce("org_id", F.lit("")).alias("g")).agg(F.count("*").alias("n"), F.min("_us").alias("at"))
    found = groups.groupBy("part", "_bin").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.min("at").alias("at")).collect()
    cuts, size, before = [], 0, None
    for r in sorted(found, key=lambda r: (r["part"], r["_bin"])):
        rows_of = r["all"] if r["part"] == 1 else r["most"]
        if r["part"] != before or size + rows_of > MOST_WALKED:
            cuts.append((r["at"], r["part"] == 1))
            size, before = 0, r["part"]
        size += rows_of
    ends = [at for at, _ in cuts[1:]] + [None]
    return [(at if i else None, end, joint) for i, ((at, joint), end) in enumerate(zip(cuts, ends))]


def admit_calls(events: DataFrame, caps: DataFrame, billing: DataFrame, platform_cap: float | None = None) -> DataFrame:
    """(id, refusal) of every ask in events (id, ts, kind, call, org_id, scopes array<struct<scope,key>>, estimate, actual).

    kind: ask, settle (its actual cost goes to the scopes that it names) or release. Organizations are walked in parallel, each in time order; a task holds one batch of rows and the
    group's sums. A platform cap orders all calls: a first pass bounds what the platform can have spent and held at each ask. Most asks can't reach the cap, or must pass it,
    whatever was decided before, and their organizations are still walked in parallel. Only the stretch from the first to the last ask that is open is walked as one group. Stretches
    are cut where a group would have more than MOST_WALKED rows, so that what a task sorts doesn't grow with the tables. What a stretch starts from are sums: caps and balances less
    what was settled, and the holds that are open. caps: scope, key, org_id, cap_usd; billing: org_id, balance_usd (null: none).
    """
    spark = events.sparkSession
    rows = events.select("id", micros(F.col("ts")).alias("_us"), "kind", F.col("call").cast("long").alias("call"), "org_id", F.col("scopes").cast("array<struct<scope:string,key:string>>").alias("scopes"), NANOS("estimate").alias("estimate"), NANOS("actual").alias("actual"))
    limits = caps.groupBy("scope", "key").agg(F.max(NANOS("cap_usd")).alias("cap"), F.max("org_id").alias("org_id")).withColumn("joint", F.lit(False))
    balances = billing.where(F.col("balance_usd").isNotNull()).select("org_id", NANOS("balance_usd").alias("balance"))
    rows = written(rows, "events")
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(BINS, -(-rows.count() // BIN_ROWS)))
    first = last = None
    if platform_cap is None:
        rows = rows.withColumns({"_bin": bin_of(rows, "_us", bins), "barred": F.lit(False)})
    else:
        cap = nano(platform_cap)
        rows = written(_screen(rows, bins), "calls")
        unsure = (F.col("high") > cap) & (F.col("low") <= cap)
        first, last = rows.agg(F.min(F.when(unsure, F.col("_us"))), F.max(F.when(unsure, F.col("_us")))).first()
        rows = rows.withColumn("barred", F.coalesce(F.col("low") > cap, F.lit(False)))
        platform = spark.range(1).select(F.lit("platform").alias("scope"), F.lit("").alias("key"), F.lit(cap).cast("long").alias("cap"), F.lit(None).cast("string").alias("org_id"), F.lit(True).alias("joint"))
        limits = limits.unionByName(platform)
    decided: list[tuple[int | None, DataFrame]] = []
    stretches = _stretches(rows, first, last)
    for lo, hi, joint in stretches or [(None, None, False)]:
        part = rows
        part = part.where(F.col("_us") >= lo) if lo is not None else part
        part = part.where(F.col("_us") < hi) if hi is not None else part
        walked = part.select(*[c for c in WALKED if c != "g"])
        if lo is not None:
            recent = rows.where((F.col("_us") < lo) & (F.col("_us") > lo - HOLD_SECONDS * SECOND))
            known = reduce(DataFrame.unionByName, [d for end, d in decided if end > lo - HOLD_SECONDS * SECOND])
            held = recent.where("kind = 'ask'").join(known.where("refusal is null").select("id"), "id", "left_semi")
            newest = held.groupBy("call").agg(F.max(F.struct("_us", "id")).alias("m"))
            closed = recent.where("kind <> 'ask'").groupBy("call").agg(F.max("_us").alias("_c"))
            held = held.join(newest.select("call", F.col("m.id").alias("id")), ["call", "id"], "left_semi").join(closed, "call", "left").where(F.col("_c").isNull() | (F.col("_c") < F.col("_us")))
            walked = walked.unionByName(held.withColumn("kind", F.lit("hold")).select(*walked.columns))
        own = limits if joint else limits.where(~F.col("joint"))
        found = _walk(walked, own.drop("joint"), balances, joint)
        if hi is None:
            decided.append((hi, found))
            break
        decided.append((hi, written(found, "decided")))
        settled = part.where("kind = 'settle'")
        spent = settled.select(F.explode("scopes").alias("s"), "actual").groupBy("s.scope", "s.key").agg(F.sum("actual").alias("spent"))
        limits = written(limits.join(spent, ["scope", "key"], "left").withColumn("cap", F.col("cap") - F.coalesce("spent", F.lit(0))).drop("spent"), "limits")
        paid = settled.groupBy("org_id").agg(F.sum("actual").alias("paid"))
        balances = written(balances.join(paid, "org_id", "left").withColumn("balance", F.col("balance") - F.coalesce("paid", F.lit(0))).drop("paid"), "balances")
    return reduce(DataFrame.unionByName, [d for _, d in decided])
