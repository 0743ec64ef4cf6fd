"""Queries and oracles of conversations and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chats, groups
from .inputs import view, with_views


def _sessions(s: SparkSession, d: str) -> DataFrame:
    made = F.transform(F.arrays_zip("roles", "texts"), lambda m: F.struct(m["roles"].alias("role"), m["texts"].alias("content")))
    return view(s, d, "chat_sessions").withColumn("messages", made).drop("roles", "texts")


def _long(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "messages")


def _sha(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.sha2(F.col(n), 256) for n in names})


def q_sessions(s: SparkSession, d: str) -> DataFrame:
    out = chats.search_sessions(_sessions(s, d), view(s, d, "bots"), view(s, d, "users"), q="an%the", day_to="2024-01-30", min_messages=2)
    return _sha(out.select("id", "agent_id", "source", "duration_seconds", "message_count", "first_user_message", "agent_name", "owner_name"), "first_user_message")


def q_dates(s: SparkSession, d: str) -> DataFrame:
    """Yearly dates of customers: key arithmetic gives days and months, some of them impossible."""
    n = F.col("id").cast("int")
    return view(s, d, "users").select(n.alias("id"), (n % 5).cast("string").alias("chat"), F.concat(F.lit(" P"), (n % 60).cast("string"), F.lit(" ")).alias("name"), (n % 33).alias("day"), (n % 14).alias("month"), (1890 + n % 230).alias("year"), F.element_at(F.array(F.lit("birthday"), F.lit("memorial"), F.lit("party")), n % 3 + 1).alias("kind"))


def q_recap(s: SparkSession, d: str) -> DataFrame:
    m = _messages(s, d)
    asks = m.where("id % 50 = 0 and not from_me").select(F.col("id").alias("request_id"), "number_id", "chat", "phone", F.col("ts").alias("asked_at"), (F.col("id") % 48 + 1).cast("int").alias("hours"))
    return groups.recap_messages(asks, m, m.where("text = ''").select("number_id", "chat", "phone", F.col("ts").alias("joined_at")), 50)


def _told(messages: str):
    """Roles and texts of messages as one digest."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"), 256).alias(messages)


def q_append(s: SparkSession, d: str) -> DataFrame:
    """A third of the sessions get their own messages again, half of these by another channel, which is refused."""
    again = _sessions(s, d).where("cast(id as int) % 3 = 0").withColumn("source", F.when(F.col("id").cast("int") % 2 == 0, F.col("source")).otherwise("x"))
    return chats.append_exchange(_sessions(s, d), again).select("id", _told("messages"))


M = "#messages"
QUERIES = {
    "js01_session_measures": lambda s, d: _sha(chats.session_measures(_sessions(s, d)).select("id", "duration_seconds", "message_count", "first_user_message"), "first_user_message"),
    "pf01_search_sessions": q_sessions,
    "tk02_session_page": lambda s, d: chats.page(chats.session_measures(_sessions(s, d).where("source <> 'test'")), "messages", True, 25, 5).select("id", "source", "message_count"),
    "ag05_channel_counts": lambda s, d: chats.channel_counts(view(s, d, "chat_sessions")),
    "ar01_public_history": lambda s, d: chats.public_history(_sessions(s, d)).select("id", "error", _told("recent"), _told("kept")),
    "ar02_stored_transcript": lambda s, d: chats.stored_transcript(chats.public_history(_sessions(s, d)).withColumn("reply", F.lit("Thanks")), mask=lambda t: F.regexp_replace(t, "the", "***")).select("id", F.size("stored").alias("stored"), F.sha2(F.array_join(F.transform("stored", lambda m: m["content"]), "|"), 256).alias("sha")),
    "ss06_append_exchange": q_append,
    "st01_first_deliveries": lambda s, d: chats.first_deliveries(_messages(s, d).withColumn("wa_id", (F.col("id") % 4000).cast("string"))).select("id", "number_id", "wa_id", "late"),
    "wn02_last_n": lambda s, d: chats.last_n(_messages(s, d), ["number_id", "chat"], ["id"], 20).select("number_id", "chat", "id"),
    "wn03_sessionize": lambda s, d: chats.sessionize(_messages(s, d), ["number_id", "phone"]).select("id", "number_id", "phone", "session"),
    "wn04_merge_bursts": lambda s, d: _sha(chats.merge_bursts(_messages(s, d).withColumn("addressed", F.col("id") % 3 == 0), ["number_id", "chat"], 240.0), "text"),
    "wn05_alternate_turns": lambda s, d: _sha(chats.alternate_turns(_long(s, d), "conv_id"), "content"),
    "wn06_pace_flags": lambda s, d: chats.pace_flags(_messages(s, d).select("number_id", "chat", "id", "ts"), 2, 1800, 8, 7200),
    "wn12_newest_per": lambda s, d: chats.newest_per(_messages(s, d), ["phone"], ["ts", "id"]).select("phone", "id"),
    "ss07_apply_retention": lambda s, d: chats.apply_retention(_messages(s, d).select("id", F.col("ts").alias("created_at")), "error_log", "2024-01-30 00:00:00"),
    "tk03_recent_errors": lambda s, d: chats.recent_errors(s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("string").alias("agent_id"), F.lit("chat").alias("source"), F.col("ts").alias("created_at")), "3"),
    "jn06_resolve_quotes": lambda s, d: groups.resolve_quotes(_messages(s, d).withColumn("quoted_text", F.when(F.col("quoted_wa_id").isNotNull(), F.concat(F.lit("said "), "quoted_wa_id")))).select("id", "quote"),
    "jn11_recap_messages": q_recap,
    "pf09_calls_agent": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", groups.calls_agent(F.col("text"), ["the", "que"]).alias("called")),
    "pf10_turn_mode": lambda s, d: groups.turn_mode(view(s, d, "organizations").select("id", F.element_at(F.array(F.lit("smart"), F.lit("always"), F.lit("mention"), F.lit("off")), F.col("id").cast("int") % 4 + 1).alias("mode"), F.lit("22:00").alias("quiet_from"), F.when(F.col("id").cast("int") % 3 > 0, "07:30").alias("quiet_to"), F.when(F.col("id").cast("int") % 2 == 0, "Asia/Jerusalem").alias("timezone"), F.when(F.col("id").cast("int") % 5 == 0, F.lit("2024-01-20").cast("timestamp_ntz")).alias("muted_until")), "2024-01-15 05:10:00").select("id", "mode", "effective_mode"),
    "wn07_group_budget_flags": lambda s, d: groups.group_budget_flags(view(s, d, "group_events"), 3, 1, 4).select("id", "actions", "unsolicited_actions", "decisions", "limited"),
    "wn08_quiet_gap": lambda s, d: groups.quiet_gap(_messages(s, d), 5),
    "ag12_activity_counts": lambda s, d: groups.activity_counts(view(s, d, "group_events"), "2024-01-15 12:00:00"),
    "wn13_outbox_plan": lambda s, d: groups.outbox_plan(_messages(s, d).select("id", "number_id", F.when(F.col("id") % 3 == 0, "queued").when(F.col("id") % 3 == 1, "sending").otherwise("sent").alias("status"), F.col("ts").alias("created_at")), "2024-01-15 12:00:00", 5),
    "so03_record_joins": lambda s, d: groups.record_joins(_messages(s, d).select("number_id", F.col("chat").alias("jid"), F.array("phone", F.col("chat"), "phone").alias("members"), F.col("ts").alias("at"))),
    "ag07_number_people": lambda s, d: groups.number_people(_messages(s, d).select("number_id").distinct(), _messages(s, d).groupBy("number_id", F.col("phone").alias("name")).agg(F.min("ts").alias("joined_at")).withColumn("active", F.col("name").cast("int") % 50 == 1)),
    "tx19_transcript": lambda s, d: _sha(groups.transcript(_messages(s, d).select("number_id", "chat", "id", "ts", F.col("phone").alias("sender"), F.col("quoted_wa_id").alias("quote"), "text"), "UTC"), "text"),
    "tx18_resolve_mentions": lambda s, d: groups.resolve_mentions(_messages(s, d).select("id", "chat", F.concat(F.lit("hi @Customer "), "phone", F.lit(" and @"), "chat", F.lit(" "), "text").alias("text")), _messages(s, d).select("chat", F.concat("phone", F.lit("@s")).alias("jid"), F.concat(F.lit("Customer "), "phone").alias("name"), "phone").distinct()).select("id", "text", F.size("mentions").alias("mentions")),
    "js05_clean_dates": lambda s, d: groups.clean_dates(q_dates(s, d)).select("id", "name", "year", "kind", "error"),
    "so02_import_dates": lambda s, d: groups.import_dates(q_dates(s, d).where("id % 4 = 0"), q_dates(s, d).where("id % 4 <> 1")).select("id", "outcome"),
}

US = "epoch_us({0})"
ORACLES = {
    "js01_session_measures": "SELECT id, greatest(cast(epoch(updated_at - started_at) AS bigint), 0) AS duration_seconds, len(roles) AS message_count, sha256(substr(texts[list_position(roles, 'user')], 1, 300)) AS first_user_message FROM #chat_sessions",
    "pf01_search_sessions": """SELECT c.id, agent_id, source, greatest(cast(epoch(updated_at - started_at) AS bigint), 0) AS duration_seconds, len(roles) AS message_count, sha256(substr(texts[list_position(roles, 'user')], 1, 300)) AS first_user_message, a.name AS agent_name, u.username AS owner_name
  FROM #chat_sessions c JOIN #bots a ON a.id = agent_id LEFT JOIN #users u ON u.id = a.user_id
  WHERE source <> 'test' AND started_at <= timestamp '2024-01-30 23:59:59.999' AND len(roles) >= 2 AND '[' || array_to_string(list_transform(list_zip(roles, texts), lambda m: '{"role":"' || m[1] || '","content":"' || replace(replace(m[2], '"', '\\"'), chr(10), '\\n') || '"}'), ',') || ']' ILIKE '%an%the%'""",
    "tk02_session_page": "SELECT id, source, cast(len(roles) AS bigint) AS message_count FROM #chat_sessions WHERE source <> 'test' ORDER BY len(roles) DESC, id LIMIT 25 OFFSET 5",
    "ag05_channel_counts": "SELECT source, count(*) AS sessions FROM #chat_sessions WHERE source <> 'test' GROUP BY 1",
    "st01_first_deliveries": "SELECT id, number_id, wa_id, epoch_us(arrived_at) - epoch_us(ts) > 600000000 AS late FROM (SELECT * REPLACE (cast(id % 4000 AS string) AS wa_id) FROM #messages) QUALIFY row_number() OVER (PARTITION BY number_id, wa_id ORDER BY arrived_at, ts) = 1",
    "wn02_last_n": "SELECT number_id, chat, id FROM #messages QUALIFY row_number() OVER (PARTITION BY number_id, chat ORDER BY id DESC) <= 20",
    "wn03_sessionize": """SELECT id, number_id, phone, sum(o) OVER (PARTITION BY number_id, phone ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 OR lag(ended) OVER w THEN 1 ELSE 0 END AS o FROM #messages WINDOW w AS (PARTITION BY number_id, phone ORDER BY ts, id))""",
    "wn04_merge_bursts": """SELECT number_id, chat, burst, min(ts) AS started, count(*) AS messages, bool_or(id % 3 = 0) AS addressed, sha256(string_agg(text, chr(10) ORDER BY ts, id)) AS text FROM (
  SELECT *, sum(o) OVER (PARTITION BY number_id, chat ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS burst FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY number_id, chat ORDER BY ts, id)) < 240000000 THEN 0 ELSE 1 END AS o FROM #messages)) GROUP BY 1, 2, 3""",
    "wn05_alternate_turns": """WITH c AS (SELECT conv_id, turn AS pos, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
  u AS (SELECT * FROM c QUALIFY count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) > 0),
  b AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY pos) = role THEN 0 ELSE 1 END AS n FROM u),
  t AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS turn FROM b)
  SELECT conv_id, turn, any_value(role) AS role, sha256(string_agg(text, chr(10) ORDER BY pos)) AS content FROM t GROUP BY 1, 2""",
    "wn06_pace_flags": """WITH m AS (SELECT number_id, chat, id, ts, epoch_us(ts) AS u FROM #messages), c AS (SELECT *, count(*) OVER (PARTITION BY number_id, chat ORDER BY u RANGE BETWEEN 1799999999 PRECEDING AND 1 PRECEDING) AS chat_replies, count(*) OVER (PARTITION BY number_id ORDER BY u RANGE BETWEEN 7199999999 PRECEDING AND 1 PRECEDING) AS number_replies FROM m)
  SELECT number_id, chat, id, ts, chat_replies, number_replies, chat_replies < 2 AND number_replies < 8 AS allowed FROM c""",
    "wn12_newest_per": "SELECT phone, arg_max(id, (ts, id)) AS id FROM #messages GROUP BY 1",
    "ss07_apply_retention": "SELECT id, ts AS created_at FROM #messages WHERE ts >= timestamp '2024-01-16 00:00:00'",
    "tk03_recent_errors": "SELECT event_id AS id, '3' AS agent_id, 'chat' AS source, ts AS created_at FROM events WHERE event_type = 'error' AND user_id % 10 = 3 ORDER BY ts DESC, event_id DESC LIMIT 100",
    "jn06_resolve_quotes": "SELECT m.id, coalesce('#' || q.id, 'said ' || m.quoted_wa_id) AS quote FROM #messages m LEFT JOIN #messages q ON q.number_id = m.number_id AND q.chat = m.chat AND q.wa_id = m.quoted_wa_id",
    "jn11_recap_messages": """WITH r AS (SELECT id AS request_id, number_id, chat, phone, ts - to_hours(id % 48 + 1) AS since FROM #messages WHERE id % 50 = 0 AND NOT from_me),
  s AS (SELECT r.*, greatest(since, coalesce((SELECT max(ts) FROM #messages j WHERE j.text = '' AND j.number_id = r.number_id AND j.chat = r.chat AND j.phone = r.phone), (SELECT min(ts) FROM #messages f WHERE NOT f.from_me AND f.number_id = r.number_id AND f.chat = r.chat AND f.phone = r.phone))) AS start FROM r)
  SELECT request_id, m.id, m.ts FROM s JOIN #messages m ON m.number_id = s.number_id AND m.chat = s.chat AND m.ts > s.start QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY m.id DESC) <= 50""",
    "pf09_calls_agent": "SELECT conv_id, turn, regexp_matches(regexp_replace(text, '[׳''’`\"״]', '', 'g'), '(?i)(^|[^\\p{L}\\p{N}])[והלשבכמ]{0,2}(the|que)($|[^\\p{L}\\p{N}])') AS called FROM conversations",
    "pf10_turn_mode": """WITH g AS (SELECT id, cast(id AS int) AS n, ['smart', 'always', 'mention', 'off'][cast(id AS int) % 4 + 1] AS mode FROM #organizations)
  SELECT id, mode, CASE WHEN mode IN ('smart', 'always') AND (n % 5 = 0 OR n % 3 > 0 AND (CASE WHEN n % 2 = 0 THEN 430 ELSE 310 END < 450)) THEN 'mention' ELSE mode END AS effective_mode FROM g""",
    "wn07_group_budget_flags": """WITH e AS (SELECT *, epoch_us(at) AS u, action IN ('reply', 'react', 'poll') AS acted FROM #group_events),
  c AS (SELECT *, count(*) FILTER (acted) OVER w AS actions, count(*) FILTER (acted AND unsolicited) OVER w AS unsolicited_actions, count(*) FILTER ((acted OR action = 'silent') AND unsolicited) OVER w AS decisions FROM e WINDOW w AS (PARTITION BY number_id, jid ORDER BY u RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING))
  SELECT id, actions, unsolicited_actions, decisions, CASE WHEN actions >= 3 THEN 'actions' WHEN unsolicited AND unsolicited_actions >= 1 THEN 'unsolicited' WHEN unsolicited AND decisions >= 4 THEN 'decisions' END AS limited FROM c""",
    "wn08_quiet_gap": "SELECT number_id, chat, cast(min(p) FILTER (from_me) AS int) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY number_id, chat ORDER BY id DESC) - 1 AS p FROM #messages) WHERE p < 5 GROUP BY 1, 2",
    "ag12_activity_counts": """SELECT number_id, jid, count(*) FILTER (a AND d > 0 AND d < 3600000000 OR a AND d = 0) AS hour, count(*) FILTER (a AND d >= 0 AND d < 86400000000) AS day FROM (SELECT *, action IN ('reply', 'react', 'poll') AS a, epoch_us(timestamp '2024-01-15 12:00:00') - epoch_us(at) AS d FROM #group_events) GROUP BY 1, 2""",
    "wn13_outbox_plan": """WITH o AS (SELECT id, number_id, CASE id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'sending' ELSE 'sent' END AS status, ts AS created_at FROM #messages),
  c AS (SELECT *, count(*) OVER (PARTITION BY number_id ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) < 5 AS accepted, row_number() OVER (PARTITION BY number_id, status ORDER BY id) AS n, epoch_us(timestamp '2024-01-15 12:00:00') - epoch_us(created_at) AS age FROM o)
  SELECT id, number_id, status, created_at, accepted, CASE WHEN status = 'queued' AND n <= 5 THEN 'send' WHEN status = 'sending' AND age > 180000000 AND age < 3600000000 THEN 'requeue' ELSE 'keep' END AS step FROM c""",
    "so03_record_joins": "SELECT number_id, chat AS jid, member, max(ts) AS joined_at FROM (SELECT number_id, chat, ts, unnest(list_distinct([phone, chat])) AS member FROM #messages) GROUP BY 1, 2, 3",
    "ag07_number_people": """WITH p AS (SELECT number_id, phone AS name, min(ts) AS j FROM #messages GROUP BY 1, 2), n AS (SELECT DISTINCT number_id FROM #messages)
  SELECT n.number_id, count(p.name) AS people, coalesce(list(p.name ORDER BY j, p.name) FILTER (p.name IS NOT NULL), []) AS names FROM n LEFT JOIN p ON p.number_id = n.number_id AND cast(p.name AS int) % 50 = 1 GROUP BY 1""",
    "tx19_transcript": """SELECT number_id, chat, b AS block, sha256(string_agg(l, chr(10) ORDER BY id)) AS text FROM (SELECT number_id, chat, id, cast(floor((row_number() OVER (PARTITION BY number_id, chat ORDER BY id) - 1) / 10) AS bigint) AS b,
  '#' || id || ' [' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || phone || coalesce(' ↪ ' || quoted_wa_id, '') || ': ' || text AS l FROM #messages) GROUP BY 1, 2, 3""",
    "js05_clean_dates": """WITH r AS (SELECT cast(id AS int) AS id FROM #users) SELECT id, 'P' || (id % 60) AS name, CASE WHEN 1890 + id % 230 BETWEEN 1900 AND 2100 THEN 1890 + id % 230 END AS year, CASE WHEN id % 3 = 1 THEN 'memorial' ELSE 'birthday' END AS kind,
  CASE WHEN id % 14 NOT BETWEEN 1 AND 12 THEN 'month' WHEN id % 33 < 1 OR id % 33 > [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][id % 14] THEN 'day' END AS error FROM r""",
    "so02_import_dates": """WITH r AS (SELECT cast(id AS int) AS id, cast(id AS int) % 5 AS chat, 'p' || (cast(id AS int) % 60) AS name, cast(id AS int) % 33 AS day, cast(id AS int) % 14 AS month, cast(id AS int) % 3 AS kind FROM #users), n AS (SELECT *, row_number() OVER (PARTITION BY chat, name, day, month, kind ORDER BY id) AS k, count(*) OVER (PARTITION BY chat) AS c FROM r WHERE id % 4 <> 1)
  SELECT id, CASE WHEN c > 1500 THEN 'refused' WHEN EXISTS (SELECT 1 FROM r h WHERE h.id % 4 = 0 AND (h.chat, h.name, h.day, h.month, h.kind) = (n.chat, n.name, n.day, n.month, n.kind)) THEN 'held' WHEN k > 1 THEN 'repeated' ELSE 'added' END AS outcome FROM n""",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
