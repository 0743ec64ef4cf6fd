"""User-shaped tables: columns, rows, search, materialised tables; and rules over rows."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compare import coerce, compare, fill_template, folded_name
from ..sources.shared import dealt_join
from .chats import micros

MOST_COLUMNS, MOST_ITEMS, TYPES = 40, 500, ("text", "number", "date", "boolean")
COLUMN = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "name", "type")])


def column_keys(columns: list) -> list[dict]:
    """Unique keys for column definitions (key, name, type): a given free key, else the folded name with _2, _3 on a clash."""
    taken: set[str] = set()
    out = []
    for c in [c for c in columns or [] if c and (c["name"] or c["key"])][:MOST_COLUMNS]:
        key = c["key"]
        if not key or key in taken:
            base = re.sub(r"[^a-z0-9_֐-׿]+", "_", (c["name"] or c["key"]).strip().lower()).strip("_") or "column"
            key, n = base, 2
            while key in taken:
                key, n = f"{base}_{n}", n + 1
        taken.add(key)
        out.append({"key": key, "name": (c["name"] or c["key"]).strip()[:60], "type": c["type"] if c["type"] in TYPES else "text"})
    return out


@F.pandas_udf(T.ArrayType(COLUMN))
def normalize_columns(columns: pd.Series) -> pd.Series:
    return columns.map(lambda cs: column_keys(list(cs)) if cs is not None else [])


def shape_rows(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, table_id, data, unknown, refused) of rows (id, table_id, data: map of texts) by tables (id, columns).

    A field is the column of that key or name, else of the folded one (the first in order); a value that its column's type
    refuses is reported, not stored.
    """
    fields = rows.select("id", "table_id", F.explode_outer("data").alias("field", "value"))
    columns = tables.select(F.col("id").alias("table_id"), F.posexplode("columns").alias("n", "c"))
    exact = columns.select("table_id", "n", "c", F.explode(F.array_distinct(F.array("c.key", "c.name"))).alias("field"))
    exact = exact.groupBy("table_id", "field").agg(F.min_by("c", "n").alias("exact"))
    folded = columns.select("table_id", "n", "c", F.explode(F.array_distinct(F.array(folded_name(F.col("c.key")), folded_name(F.col("c.name"))))).alias("fold"))
    folded = folded.groupBy("table_id", "fold").agg(F.min_by("c", "n").alias("folded"))
    met = fields.withColumn("fold", folded_name(F.col("field"))).join(exact, ["table_id", "field"], "left").join(folded, ["table_id", "fold"], "left").withColumn("c", F.coalesce("exact", "folded"))
    # a generator is a boundary of projections: each value is coerced once, in code of its own
    met = met.select("id", "table_id", "field", "value", "c", F.explode(F.array(F.when(F.col("c").isNotNull(), coerce(F.col("value"), F.col("c.type"))))).alias("out"))
    ok, lost = F.col("out").isNotNull(), F.col("c").isNull() & F.col("field").isNotNull()
    refused = F.col("c").isNotNull() & F.col("out").isNull()
    # two fields of one column: the last in field order counts
    pairs = F.array_sort(F.collect_list(F.when(ok, F.struct("field", F.col("c.key").alias("key"), "out"))))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["out"])))
    return met.groupBy("id", "table_id").agg(
        last.alias("data"),
        F.sort_array(F.collect_list(F.when(lost, F.col("field")))).alias("unknown"),
        F.array_sort(F.collect_list(F.when(refused, F.struct(F.col("c.name").alias("column"), F.col("c.type").alias("type"), F.substring("value", 1, 60).alias("value"))))).alias("refused"),
    )


def materialize_table(rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Typed columns from rows (id, data map) by (key, type); dates stay texts."""
    kind = {"number": "double", "boolean": "boolean"}
    return rows.select("id", *[F.col("data")[k].try_cast(kind.get(t, "string")).alias(k) for k, t in columns])


def search_rows(rows: DataFrame, q: str | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of rows (id, data) whose JSON text holds q; % and _ in q are wildcards."""
    out = rows.where(F.to_json("data").ilike(f"%{q}%")) if q else rows
    return out.orderBy("id").offset(max(offset, 0)).limit(min(limit, 500))


def patch_rows(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """rows (id, data map, written_by) with the fields of patches (id, data, written_by) changed and their writer noted."""
    p = patches.select("id", F.col("data").alias("_p"), F.col("written_by").alias("_w"))
    out = rows.join(p, "id", "left")
    kept = F.map_filter("data", lambda k, _: ~F.map_contains_key("_p", k))
    return out.withColumns({"data": F.when(F.col("_p").isNotNull(), F.map_concat(kept, "_p")).otherwise(F.col("data")), "written_by": F.coalesce("_w", "written_by")}).drop("_p", "_w")


def tables_for_bots(bots: DataFrame, tables: DataFrame) -> DataFrame:
    """(agent_id, table_id): ticked on the agent and of its owner's organization. bots: id, org_id, tables (array of ids); tables: id, org_id."""
    ticked = bots.select(F.col("id").alias("agent_id"), "org_id", F.explode(F.array_distinct("tables")).alias("table_id"))
    return ticked.join(tables.select(F.col("id").alias("table_id"), "org_id"), ["table_id", "org_id"], "left_semi").select("agent_id", "table_id")


def find_tables(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """(request_id, table_id): by id, else by folded name within the organization (the smallest id). wanted: request_id, org_id, ref."""
    by_id = tables.select("org_id", F.col("id").alias("ref"), F.col("id").alias("_i"))
    by_name = tables.groupBy("org_id", folded_name(F.col("name")).alias("_f")).agg(F.min("id").alias("_n"))
    return wanted.withColumn("_f", folded_name(F.col("ref"))).join(by_id, ["org_id", "ref"], "left").join(by_name, ["org_id", "_f"], "left").select("request_id", F.coalesce("_i", "_n").alias("table_id"))


# ---- rules


def route_if(df: DataFrame, conditions: list[tuple[Column, str, Column]], match: str = "all") -> DataFrame:
    """df with port `yes` or `no`; without conditions `all` passes and `any` doesn't."""
    passed = F.lit(match != "any")
    for left, op, right in conditions:
        one = F.coalesce(compare(left, op, right), F.lit(False))
        passed = passed | one if match == "any" else passed & one
    return df.withColumn("port", F.when(passed, "yes").otherwise("no"))


def route_switch(df: DataFrame, value: Column, cases: list[tuple[str, Column]]) -> DataFrame:
    """df with the port of the first equal case, else `default`."""
    port = F.lit("default")
    for name, right in reversed(cases):
        port = F.when(compare(value, "eq", right), name).otherwise(port)
    return df.withColumn("port", port)


def fill_templates(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df with the fields of a Set or Output step (name: template); those without a name are skipped."""
    return df.withColumns({k.strip(): fill_template(v) for k, v in fields.items() if k.strip()})


def loop_rows(df: DataFrame, items: str, body, key: str = "id") -> DataFrame:
    """(key, count, results, error): body(item, index) over the list of texts of each row, in order.

    items: a column of JSON text. What isn't a list, or has more than 500 items, is an error row.
    """
    parsed = F.from_json(items, "array<string>")
    is_list = F.coalesce(F.trim(F.col(items)).startswith("["), F.lit(False)) & parsed.isNotNull()
    error = F.when(~is_list, "not a list").when(F.size(parsed) > MOST_ITEMS, "too many items")
    rows = df.withColumns({"_e": error, "_i": F.when(error.isNull(), parsed)})
    results = F.transform("_i", body)
    return rows.select(key, F.size("_i").alias("count"), results.alias("results"), F.col("_e").alias("error")).withColumn("count", F.when(F.col("error").isNull(), F.col("count")))


def apply_user_fn(df: DataFrame, fn, inputs: list[str], schema: T.DataType, to: str = "result") -> DataFrame:
    """df with the result of a user's vectorized function (pandas Series in, Series or DataFrame out) over the named columns."""
    return df.withColumn(to, F.pandas_udf(fn, schema)(*[F.col(c) for c in inputs]))


def listening(automations: DataFrame, connections: DataFrame, users: DataFrame) -> DataFrame:
    """(automation_id, connection_id): by organization and folded name, where the publisher may use the connection: shared, its own, or as an admin of the platform or organization."""
    who = users.select(F.col("id").alias("publisher"), "is_admin", (F.col("org_role") == "admin").alias("_a"), F.col("org_id").alias("_o"))
    # an automation meets its publisher before the connections: the pairs are shuffled no more
    live = automations.where("enabled").select(F.col("id").alias("automation_id"), "org_id", F.lower("connection").alias("n"), "publisher").join(who, "publisher", "left")
    met = dealt_join(connections.select(F.col("id").alias("connection_id"), "org_id", F.lower("name").alias("n"), "shared", "created_by"), live, ["org_id", "n"], "connection_id")
    may = F.coalesce("shared", F.lit(True)) | (F.col("created_by") == F.col("publisher")) | F.col("is_admin") | (F.col("_a") & (F.col("_o") == F.col("org_id")))
    return met.where(F.coalesce(may, F.lit(False))).select("automation_id", "connection_id")


def row_triggers(new_rows: DataFrame, automations: DataFrame) -> DataFrame:
    """(row_id, automation_id): every added row and the live automations that watch its table, but the one that wrote it."""
    watching = automations.where("enabled").select(F.col("id").alias("automation_id"), "org_id", "table_id")
    met = dealt_join(new_rows.select(F.col("id").alias("row_id"), "org_id", "table_id", "written_by"), watching, ["org_id", "table_id"], "row_id")
    return met.where(F.coalesce(F.col("written_by") != F.concat(F.lit("automation:"), "automation_id"), F.lit(True))).select("row_id", "automation_id")


class OpenWaits:
    """The waits of one person that are open at a time, oldest first; what lapsed or was answered is forgotten."""

    def __init__(self):
        self.live: dict[int, tuple[int, bool]] = {}  # number of a wait: its run, and whether the run has other waits
        self.by_end: list[tuple[int, int]] = []
        self.by_age: dict[str, list[tuple[int, int, int]]] = {"approval": [], "reply": [], "other": []}
        self.spent: set[int] = set()  # answered runs that have other waits

    def add(self, number: int, start: int, until: int, kind: str, run: int, again: bool) -> None:
        if run in self.spent:
            return
        self.live[number] = (run, again)
        heapq.heappush(self.by_end, (until, number))
        heapq.heappush(self.by_age[kind if kind in ("approval", "reply") else "other"], (start, run, number))

    def oldest(self, kind: str) -> tuple[int, int, int] | None:
        heap = self.by_age[kind]
        while heap and heap[0][2] not in self.live:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def answer(self, at: int, decides: bool) -> int | None:
        """The run that a message at this time answers; `decides`: it is a yes or a no."""
        while self.by_end and self.by_end[0][0] < at:
            self.live.pop(heapq.heappop(self.by_end)[1], None)
        for kind, heap in self.by_age.items():
            if len(heap) > 2 * len(self.live) + 64:  # what is no longer live lies behind something that is
                self.by_age[kind] = [w for w in heap if w[2] in self.live]
                heapq.heapify(self.by_age[kind])
        found = self.oldest("approval") if decides else None
        if found is None:
            found = min((w for w in (self.oldest("reply"), self.oldest("other") if decides else None) if w), default=None)
        if found is None:
            return None
        run, again = self.live.pop(found[2])
        if again:
            self.spent.add(run)
            self.live = {n: w for n, w in self.live.items() if w[0] != run}
        return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state, number = None, OpenWaits(), 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            person = (row["number_id"], row["phone"])
            if person != at:
                at, state = person, OpenWaits()
            if row["side"] == 0:
                number += 1
                state.add(number, row["us"], row["until"], row["kind"], row["id"], row["flag"])
            else:
                run = state.answer(row["us"], row["flag"])
                if run is not None:
                    out.append((row["id"], run))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["message_id", "run_id"])


def match_replies(messages: DataFrame, waits: DataFrame) -> DataFrame:
    """(message_id, run_id): each message answers one run at most and each run takes one message.

    Candidates: same number and phone, the run waiting already and still at the message's time. In message
    order, a yes or no goes to an approval first, else to what has waited longest; any other message only to a run that waits for a reply. messages: id, number_id, phone, ts, answer;
    waits: run_id, number_id, phone, kind, started_at, until. Messages of people with waits and the waits are one stream, shuffled by person and swept in time order: no pairs are
    built, and a task holds one batch and the waits that are open. Rows without a person or a time match nothing.
    """
    keys = ["number_id", "phone"]
    same = Window.partitionBy(*keys, "run_id")
    opened = waits.where(F.col("started_at").isNotNull() & F.col("until").isNotNull()).withColumn("_again", F.count("*").over(same) > 1)
    opened = opened.select(*keys, micros(F.col("started_at")).alias("us"), F.lit(0).alias("side"), F.col("run_id").cast("long").alias("id"), micros(F.col("until")).alias("until"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("_again").alias("flag"))
    asked = messages.where(F.col("ts").isNotNull()).join(waits.select(*keys).distinct(), keys, "left_semi")
    asked = asked.select(*keys, micros(F.col("ts")).alias("us"), F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("until"), F.lit("").alias("kind"), F.col("answer").isNotNull().alias("flag"))
    rows = opened.unionByName(asked).dropna(subset=keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "us", "side", "id").mapInArrow(_sweep, "message_id long, run_id long")


def run_health(runs: DataFrame, as_of: str) -> DataFrame:
    """runs with health: a running one without heartbeat for ten minutes is stale, and failed after more than three reclaims."""
    age = F.timestamp_diff("SECOND", F.col("heartbeat_at"), F.lit(as_of).cast("timestamp_ntz"))
    stale = (F.col("status") == "running") & F.coalesce(age > 600, F.lit(True))
    return runs.withColumn("health", F.when(stale & (F.col("reclaims") > 3), "failed").when(stale, "stale").otherwise(F.col("status")))


def invite_state(invites: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return invites.withColumn("state", F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("used_at").isNotNull(), "used").when(F.col("expires_at") <= now, "expired").otherwise("open"))
