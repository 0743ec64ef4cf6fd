"""Conversations: measures, search, transcripts, sessions, bursts, turns, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import counts_before, islands

#: Messages kept of a transcript, shown to a turn, longest user message, cut of an answer.
MOST_STORED, TURN, MOST_USER, MOST_ANSWER = 500, 20, 4000, 8000
IDLE_MINUTES, DIRECT_GAP, GROUP_GAP, LATE_MINUTES = 30, 2.5, 4.0, 10


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def session_measures(sessions: DataFrame) -> DataFrame:
    """sessions (messages: array of role, content) with duration in whole seconds, message count and the first user message."""
    user = F.filter("messages", lambda m: m["role"] == "user")
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("updated_at")) / 1_000_000)
    return sessions.withColumns({
        "duration_seconds": F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)).cast("long"),
        "message_count": F.size("messages").cast("long"),
        "first_user_message": F.substring(F.get(user, 0)["content"], 1, 300),
    })


def search_sessions(
    sessions: DataFrame, bots: DataFrame, users: DataFrame, *, agent: str | None = None, source: str | None = None, q: str | None = None, day_from: str | None = None, day_to: str | None = None,
    min_seconds: int | None = None, max_seconds: int | None = None, min_messages: int | None = None,
) -> DataFrame:
    """Conversations that pass every given filter, with agent and owner names; without a channel, all but `test`.

    Filters on plain columns come first, so they reach the scan. The text is searched
    without escaping: % and _ are wildcards. Days are inclusive.
    """
    out = sessions.where(F.col("source") == source) if source else sessions.where(F.col("source") != "test")
    if agent:
        out = out.where(F.col("agent_id") == agent)
    if day_from:
        out = out.where(F.col("started_at") >= F.lit(day_from).cast("timestamp_ntz"))
    if day_to:
        out = out.where(F.col("started_at") <= F.lit(f"{day_to} 23:59:59.999").cast("timestamp_ntz"))
    if q:
        out = out.where(F.to_json("messages").ilike(f"%{q}%"))
    out = session_measures(out)
    for column, low, high in (("duration_seconds", min_seconds, max_seconds), ("message_count", min_messages, None)):
        out = out.where(F.col(column) >= low) if low is not None else out
        out = out.where(F.col(column) <= high) if high is not None else out
    named = bots.select(F.col("id").alias("agent_id"), F.col("name").alias("agent_name"), F.col("user_id").alias("_owner"))
    return out.join(named, "agent_id").join(users.select(F.col("id").alias("_owner"), F.col("username").alias("owner_name")), "_owner", "left").drop("_owner")


def page(rows: DataFrame, sort: str = "started", descending: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page of search_sessions, ties by id."""
    column = {"started": "started_at", "updated": "updated_at", "duration": "duration_seconds", "messages": "message_count"}.get(sort, "started_at")
    order = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    return rows.orderBy(order, "id").offset(max(offset, 0)).limit(min(limit or 25, 200))


def channel_counts(sessions: DataFrame) -> DataFrame:
    return sessions.where("source <> 'test'").groupBy("source").agg(F.count("*").alias("sessions"))


def public_history(sessions: DataFrame) -> DataFrame:
    """sessions with `recent` (what a stranger's turn may use) or `error`, and `kept` (all that is stored).

    The last 500 messages, of them user and assistant ones with text; answers cut to 8000 characters; of
    these the last 20 from the first user message on, ending with a user's text.
    """
    last = F.slice("messages", -F.least(F.size("messages"), F.lit(MOST_STORED)), F.least(F.size("messages"), F.lit(MOST_STORED)))
    last = F.when(F.size("messages") > 0, last)
    talk = F.filter(last, lambda m: m["role"].isin("user", "assistant"))
    cut = F.transform(talk, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", F.substring(m["content"], 1, MOST_ANSWER)).otherwise(m["content"]).alias("content")))
    out = sessions.withColumns({"_talk": talk, "kept": cut})
    n = F.least(F.size("kept"), F.lit(TURN))
    out = out.withColumn("_tail", F.when(F.size("kept") > 0, F.slice("kept", -n, n)))
    first = F.array_position(F.transform("_tail", lambda m: m["role"]), "user")
    out = out.withColumn("recent", F.when(first > 0, F.slice("_tail", first.cast("int"), F.size("_tail"))))
    end = F.try_element_at("recent", F.lit(-1))
    error = (
        F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "messages array required")
        .when(F.exists("_talk", lambda m: m["content"].isNull()), "Message content must be text")
        .when(F.exists("_talk", lambda m: (m["role"] == "user") & (F.length(m["content"]) > MOST_USER)), "A message can be at most 4000 characters long")
        .when(F.coalesce((end["role"] != "user") | (F.trim(end["content"]) == ""), F.lit(True)), "The last message must be the person's, with some text")
    )
    return out.withColumn("error", error).withColumn("recent", F.when(F.col("error").isNull(), F.col("recent"))).drop("_talk", "_tail")


def stored_transcript(histories: DataFrame, reply: str = "reply", mask=None) -> DataFrame:
    """What is stored: all kept messages, user ones masked, and the reply; the last 500."""
    mask = mask or (lambda text: text)
    masked = F.transform("kept", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", mask(m["content"])).otherwise(m["content"]).alias("content")))
    full = F.concat(masked, F.array(F.struct(F.lit("assistant").alias("role"), F.col(reply).alias("content"))))
    return histories.withColumn("stored", F.slice(full, -F.least(F.size(full), F.lit(MOST_STORED)), F.least(F.size(full), F.lit(MOST_STORED))))


def append_exchange(sessions: DataFrame, exchanges: DataFrame) -> DataFrame:
    """sessions with the messages of exchanges (id, agent_id, source, messages) appended where agent and channel agree."""
    new = exchanges.select("id", "agent_id", "source", F.col("messages").alias("_new"))
    out = sessions.join(new, ["id", "agent_id", "source"], "left")
    return out.withColumn("messages", F.when(F.col("_new").isNotNull(), F.concat("messages", "_new")).otherwise(F.col("messages"))).drop("_new").select(*sessions.columns)


def first_deliveries(messages: DataFrame) -> DataFrame:
    """One row per (number, message id), the earliest arrival, with `late`: over ten minutes old when it arrived."""
    order = Window.partitionBy("number_id", "wa_id").orderBy("arrived_at", "ts")
    late = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("arrived_at")) > LATE_MINUTES * 60_000_000
    return messages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumn("late", late)


def sessionize(messages: DataFrame, keys: list[str], idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """messages with `session`: a new one after idle_minutes of silence, or after a message that is marked as ended. Keys of any size are cut by time (bins.islands)."""
    idle = idle_minutes * 60_000_000
    rows = messages.withColumn("_us", micros(F.col("ts")))
    opens = lambda before, here: (here("_us") - before("_us") > idle) | F.coalesce(before("ended"), F.lit(False))
    return islands(rows, keys, "_us", ["ts", "id"], ["_us", "ended"], opens, "session").drop("_us")


def merge_bursts(messages: DataFrame, keys: list[str], gap_seconds: float) -> DataFrame:
    """One row per burst: messages of one chat closer than the gap; text joined by lines, addressed if any is. Chats of any size are cut by time."""
    gap = int(gap_seconds * 1_000_000)
    rows = islands(messages.withColumn("_us", micros(F.col("ts"))), keys, "_us", ["ts", "id"], ["_us"], lambda before, here: here("_us") - before("_us") >= gap, "burst")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))), lambda m: m["text"]), "\n")
    return rows.groupBy(*keys, "burst").agg(F.min("ts").alias("started"), F.count("*").alias("messages"), F.max("addressed").alias("addressed"), text.alias("text"))


def alternate_turns(messages: DataFrame, key: str) -> DataFrame:
    """(key, turn, role, content): blank and foreign messages dropped, nothing before the first user message, neighbours of one role merged.

    messages: key, pos, role, content. Transcripts of any size are cut by position.
    """
    clean = messages.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("content", F.lit(""))) != "")).withColumn("_p", F.col("pos").cast("long"))
    start = clean.where("role = 'user'").groupBy(key).agg(F.min("pos").alias("_start"))
    clean = clean.join(start, key).where(F.col("pos") >= F.col("_start")).drop("_start")
    turns = islands(clean, [key], "_p", ["pos"], ["role"], lambda before, here: before("role") != here("role"), "turn")
    return turns.groupBy(key, "turn").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]), "\n").alias("content"))


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of every key; the group limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_first(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def newest_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_n(rows, keys, order, 1)


def pace_flags(replies: DataFrame, chat_most: int = 15, chat_seconds: int = 600, number_most: int = 300, number_seconds: int = 3600) -> DataFrame:
    """replies (number_id, chat, id, ts) with counts before each in its chat's and its number's window, and whether it may go. Numbers of any size are cut by time."""
    rows = replies.withColumn("_us", micros(F.col("ts")))
    rows = counts_before(rows, ["number_id", "chat"], "_us", chat_seconds * 1_000_000, {"chat_replies": F.lit(1).cast("long")})
    rows = counts_before(rows, ["number_id"], "_us", number_seconds * 1_000_000, {"number_replies": F.lit(1).cast("long")})
    return rows.withColumn("allowed", (F.col("chat_replies") < chat_most) & (F.col("number_replies") < number_most)).drop("_us")


def retention_days() -> dict[str, int]:
    """Days that each log is kept."""
    return {"error_log": 14, "wa_group_messages": 30, "wa_group_events": 30, "wa_group_joins": 90, "wa_outbox": 14, "automation_runs": 30, "wa_seen": 3, "message_claims": 30, "wa_dm_replies": 1, "throttle": 1, "wa_group_schedules": 30}


def apply_retention(rows: DataFrame, table: str, as_of: str, at: str = "created_at") -> DataFrame:
    """Rows that a table keeps at as_of. Runs go once finished, throttle rows once unlocked, schedules once spent; others by age alone."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(retention_days()[table]))
    old = F.col(at) < limit
    if table == "automation_runs":
        old = F.col("finished_at").isNotNull() & (F.col("finished_at") < limit)
    elif table == "throttle":
        old = old & F.coalesce(F.col("locked_until") < F.lit(as_of).cast("timestamp_ntz"), F.lit(True))
    elif table == "wa_group_schedules":
        old = old & (F.col("repeat") == "once") & F.col("next_run_at").isNull()
    return rows.where(~F.coalesce(old, F.lit(False)))


def recent_errors(errors: DataFrame, agent: str | None = None, source: str | None = None, limit: int = 100) -> DataFrame:
    out = errors.where(F.col("agent_id") == agent) if agent else errors
    out = out.where(F.col("source") == source) if source else out
    return out.orderBy(F.desc_nulls_first("created_at"), F.desc("id")).limit(min(limit, 100))
