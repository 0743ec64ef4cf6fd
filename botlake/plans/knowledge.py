"""Queries and oracles of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import knowledge as kb
from ..operators import search_index as ix
from ..sources.shared import new_folder
from .inputs import view, with_views


def _digest(df: DataFrame, *texts: str) -> DataFrame:
    """Long texts as length and SHA-256, which both engines spell alike."""
    return df.withColumns({f"{t}_sha": F.sha2(F.coalesce(t, F.lit("")), 256) for t in texts} | {f"{t}_len": F.length(F.coalesce(t, F.lit(""))) for t in texts}).drop(*texts)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "knowledge")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of every document as its chunks, where it has more than one."""
    lines = F.split("content", "\n")
    return _docs(s, d).where(F.size(lines) > 1).select(F.col("id").alias("parent_id"), F.posexplode(lines).alias("chunk_index", "content"))


_INDEXES: dict[tuple[str, str], str] = {}


def index_of(s: SparkSession, d: str) -> str:
    """The folder of the tables' stored index, built by the application's first query that needs it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = new_folder(s, "index")
        ix.build_index(_docs(s, d), path)
        _INDEXES[key] = path
    return _INDEXES[key]


def q_search_simple(s: SparkSession, d: str) -> DataFrame:
    return kb.search(_docs(s, d).select(F.col("id").alias("unit_id"), "agent_id", "title", "content"), view(s, d, "questions"), 6, english=False)


def q_rewrites(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).select("id", "content")
    slices = kb.slice_documents(docs.where("cast(id as long) % 2 = 0")).withColumn("content", F.when(F.col("id").cast("long") % 4 == 0, F.lit("short")).otherwise(F.lower("content")))
    return _digest(kb.apply_rewrites(docs, slices).select("id", "normalized", "content"), "content")


def q_contexts(s: SparkSession, d: str) -> DataFrame:
    """The prompt of every agent with the whole units that search finds for its questions, question by question."""
    questions, path = view(s, d, "questions"), index_of(s, d)
    found = ix.unit_texts(s, path, ix.search_index(s, path, questions)).join(questions.select("query_id", "agent_id"), "query_id")
    hits = found.select("agent_id", F.struct("query_id", "position").alias("position"), "title", "content")
    bots = view(s, d, "bots").select("id", F.concat(F.lit("You are "), "name").alias("base_prompt"), F.lit("").alias("notice"))
    return kb.build_contexts(bots, hits, "2024-01-15 21:30:00")


def _phones(s: SparkSession, d: str) -> DataFrame:
    """Phones as people write them: with a hyphen, with 00, without the zero, and other digits after a zero."""
    forms = F.array(F.concat(F.lit("050-"), F.lpad("id", 7, "1")), F.concat(F.lit("00972 5"), F.lpad("id", 8, "2")), F.concat(F.lit("5"), F.lpad("id", 8, "3")), F.concat(F.lit("0"), F.col("id")))
    return view(s, d, "users").select("id", F.element_at(forms, F.col("id").cast("int") % 4 + 1).alias("phone"))


def q_recipients(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int") % 5
    to = F.when(n == 4, F.concat(F.lit(" g-"), "id", F.lit("@g.us"))).when(n == 3, F.concat("phone", F.lit("@s.whatsapp.net"))).otherwise(F.col("phone"))
    return _phones(s, d).select("id", tx.recipient_of(to).alias("recipient"))


WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
QUERIES = {
    "tx10_chunk_documents": lambda s, d: _digest(kb.chunk_documents(_docs(s, d)), "content"),
    "tx11_slice_documents": lambda s, d: _digest(kb.slice_documents(_docs(s, d)), "content"),
    "tx12_apply_rewrites": q_rewrites,
    "tx13_lexemes_simple": lambda s, d: kb.lexeme_counts(_docs(s, d), "id", F.col("content"), english=False),
    "tx13_lexemes_english": lambda s, d: kb.lexeme_counts(_docs(s, d), "id", F.col("content")),
    "jn04_searchable_units": lambda s, d: _digest(kb.searchable_units(_docs(s, d), _lines(s, d)), "content"),
    "pf03_scope_docs": lambda s, d: kb.scope_docs(_docs(s, d), "3", ["1"]).select("id", "agent_id", "skill_id", "title"),
    "tk01_search_simple": q_search_simple,
    "tk01_posting_lists": lambda s, d: ix.posting_lists(s, index_of(s, d)),
    "tk01_search": lambda s, d: ix.search_index(s, index_of(s, d), view(s, d, "questions")),
    "ag08_document_list": lambda s, d: kb.document_list(_docs(s, d), kb.chunk_documents(_docs(s, d))),
    "ag13_backfill_report": lambda s, d: kb.backfill_report(_docs(s, d).withColumn("source_type", F.when(F.col("source_url").endswith("3"), "crawl").otherwise("upload"))),
    "tx14_mask_pii": lambda s, d: _digest(_docs(s, d).select("id", tx.mask_pii(F.col("content"), F.col("agent_id").cast("int") % 2 == 0, F.lit(True)).alias("content")), "content"),
    "tx15_mask_secrets": lambda s, d: _digest(_docs(s, d).select("id", tx.mask_secrets(F.to_json(F.struct("content")), F.array(F.substring("content", 3, 6), F.lit("the"), F.lit("ing "))).alias("content")), "content"),
    "tx16_clip_json": lambda s, d: view(s, d, "llm_usage").select("id", tx.clip_json(F.to_json(F.struct("id", "source", "model")), 45).alias("value")),
    "tx20_build_contexts": q_contexts,
    "tx22_read_answer": lambda s, d: view(s, d, "messages").select("id", tx.read_answer(F.element_at(F.array(F.lit(" Yes! "), F.lit("no."), F.lit("כן"), F.lit("maybe"), F.col("text")), (F.col("id") % 5 + 1).cast("int"))).alias("answer"), tx.is_hebrew(F.element_at(F.array(F.lit("שלום"), F.col("text")), (F.col("id") % 2 + 1).cast("int"))).alias("hebrew")),
    "tx23_parse_json_reply": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", tx.parse_json_reply(F.element_at(F.array(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Sure: "), "props", F.lit(" done")), F.col("event_type")), (F.col("event_id") % 3 + 1).cast("int"))).alias("reply")),
    "tx17_normalize_phone": lambda s, d: view(s, d, "users").select("id", tx.normalize_phone(F.element_at(F.array(F.concat(F.lit("050-"), F.lpad("id", 7, "1")), F.concat(F.lit("00972 5"), F.lpad("id", 8, "2")), F.concat(F.lit("5"), F.lpad("id", 8, "3")), F.col("id")), (F.col("id").cast("int") % 4 + 1))).alias("phone")),
    "tx17_control_phone": lambda s, d: _phones(s, d).select("id", tx.control_phone(F.col("phone")).alias("phone")),
    "tx17_recipient_of": q_recipients,
    "pf12_valid_session_id": lambda s, d: view(s, d, "messages").select("id", tx.valid_session_id(F.element_at(F.array(F.col("text"), F.concat(F.lit("wa_"), "wa_id"), F.concat_ws(":", "number_id", "wa_id"), F.repeat("wa_id", 60)), (F.col("id") % 4 + 1).cast("int"))).alias("valid")),
}

_SHA = "sha256(coalesce({0}, '')) AS {0}_sha, length(coalesce({0}, '')) AS {0}_len"
_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
ORACLES = {
    "tx13_lexemes_simple": f"SELECT id, lexeme, count(*) AS tf FROM (SELECT id, unnest({_W.format('content')}) AS lexeme FROM #knowledge) GROUP BY ALL",
    "jn04_searchable_units": f"""SELECT unit_id, document_id, agent_id, skill_id, title, {_SHA.format('content')} FROM (
  SELECT id || '#' || (generate_subscripts(x, 1) - 1) AS unit_id, id AS document_id, agent_id, skill_id, title, unnest(x) AS content FROM (SELECT *, string_split(content, chr(10)) AS x FROM #knowledge) WHERE len(x) > 1
  UNION ALL SELECT id, id, agent_id, skill_id, title, content FROM #knowledge WHERE NOT contains(content, chr(10)))""",
    "pf03_scope_docs": "SELECT id, agent_id, skill_id, title FROM #knowledge WHERE agent_id = '3' AND (skill_id IS NULL OR skill_id IN ('1'))",
    "tk01_search_simple": f"""WITH q AS (SELECT query_id, agent_id, list_distinct({_W.format('question')}) AS ws FROM #questions), a AS (SELECT query_id, agent_id, len(ws) AS n, unnest(ws) AS lexeme FROM q),
  i AS (SELECT id AS unit_id, agent_id, lexeme, count(*) AS tf FROM (SELECT id, agent_id, unnest({_W.format("title || ' ' || content")}) AS lexeme FROM #knowledge) GROUP BY ALL),
  h AS (SELECT query_id, unit_id, round(sum(0.1::double * list_sum(list_transform(range(1, least(tf, 256) + 1), lambda j: 1.0::double / (j * j))) / 1.64493406685::double) / max(n), 9) AS rank FROM i JOIN a USING (agent_id, lexeme) GROUP BY ALL)
  SELECT query_id, unit_id, rank, cast(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, unit_id) AS int) AS position FROM h QUALIFY position <= 6""",
    "tx14_mask_pii": f"SELECT id, {_SHA.format('content')} FROM (SELECT id, regexp_replace(CASE WHEN cast(agent_id AS int) % 2 = 0 THEN regexp_replace(content, '\\b\\d{{4}}[- ]?\\d{{4}}[- ]?\\d{{4}}[- ]?\\d{{4}}\\b', '[MASKED]', 'g') ELSE content END, '\\b\\d{{9}}\\b', '[MASKED]', 'g') AS content FROM #knowledge)",
    "tx23_parse_json_reply": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS reply FROM events",
    "tx15_mask_secrets": f"""SELECT id, {_SHA.format('content')} FROM (SELECT id, replace(replace(CASE WHEN length(m) >= 4 THEN replace(j, replace(replace(replace(m, chr(92), repeat(chr(92), 2)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), '••••') ELSE j END, 'ing ', '••••'), 'ing ', '••••') AS content
  FROM (SELECT id, substr(content, 3, 6) AS m, cast(to_json({{'content': content}}) AS string) AS j FROM #knowledge))""",
    "tx16_clip_json": """SELECT id, CASE WHEN length(j) > 45 THEN '{"__truncated":true,"bytes":' || length(j) || ',"preview":"' || replace(substr(j, 1, 2000), '"', '\\"') || '"}' ELSE j END AS value
  FROM (SELECT id, '{"id":' || id || ',"source":"' || source || '","model":"' || model || '"}' AS j FROM #llm_usage)""",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
