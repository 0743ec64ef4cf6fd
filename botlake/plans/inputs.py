"""The library's inputs as views of the driver tables, for Spark and for the SQL oracle alike.

Each view is one SELECT, written once; what the two dialects spell differently comes
from an Engine. view() gives the DataFrame, with_views() the oracle's WITH clause.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Engine:
    duck: bool

    @property
    def k(self) -> str:
        """The number in the events' props."""
        return "cast(json_extract_string(props, '$.k') as int)" if self.duck else "cast(get_json_object(props, '$.k') as int)"

    def plus(self, start: str, n: str, unit: str) -> str:
        """A timestamp without zone, n units (days, hours, minutes, seconds) after start."""
        if self.duck:
            return f"(timestamp '{start}' + to_{unit}(cast({n} as bigint)))" if start[0].isdigit() else f"({start} + to_{unit}(cast({n} as bigint)))"
        base = f"timestamp_ntz '{start}'" if start[0].isdigit() else start
        return f"timestampadd({unit.rstrip('s').upper()}, cast({n} as int), {base})"

    def turns(self, value: str, order: str) -> str:
        """An ordered array of value within a group."""
        if self.duck:
            return f"list({value} ORDER BY {order})"
        return f"transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v)"


def _usage(e: Engine) -> str:
    return f"""
SELECT event_id AS id, ts AS at, cast(c_nationkey AS string) AS org_id,
  CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE cast(user_id AS string) END AS user_id,
  CASE event_type WHEN 'click' THEN 'bots' WHEN 'view' THEN 'app' WHEN 'purchase' THEN 'automation' WHEN 'signup' THEN 'home' ELSE 'knowledge' END AS source,
  CASE event_type WHEN 'click' THEN 'agent' WHEN 'view' THEN 'app' WHEN 'purchase' THEN 'automation' END AS item_type,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN cast({e.k} % 10 AS string) END AS item_id,
  concat('model-', cast({e.k} % 4 AS string)) AS model, {e.k} * 10 AS input_tokens, {e.k} % 7 * 5 AS output_tokens,
  cast(value / 1000 AS decimal(18,6)) AS cost_usd
FROM @events JOIN @customer ON user_id = c_custkey"""


VIEWS = {
    "organizations": lambda e: "SELECT cast(n_nationkey AS string) AS id, n_name AS name FROM @nation",
    "users": lambda e: """
SELECT cast(c_custkey AS string) AS id, c_name AS username, c_custkey % 211 = 0 AS is_admin, cast(c_nationkey AS string) AS org_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'member' END AS org_role,
  CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'view' ELSE 'edit' END AS org_access FROM @customer""",
    "bots": lambda e: "SELECT cast(s_suppkey AS string) AS id, s_name AS name, cast(s_nationkey AS string) AS org_id, cast(s_suppkey * 3 AS string) AS user_id FROM @supplier",
    "grants": lambda e: """
SELECT cast(o_custkey AS string) AS user_id, 'agent' AS kind, cast(o_orderkey % 100 AS string) AS item_id,
  CASE max(o_orderkey) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'view' ELSE 'edit' END AS level FROM @orders GROUP BY o_custkey, o_orderkey % 100""",
    "llm_usage": _usage,
    "org_billing": lambda e: """
SELECT cast(n_nationkey AS string) AS org_id, CASE WHEN n_nationkey % 5 <> 0 THEN cast(n_nationkey * 3 - 6 AS decimal(18,6)) END AS balance_usd,
  cast(n_nationkey % 4 * 10 AS decimal(9,4)) AS markup_pct, CASE WHEN n_nationkey % 6 = 0 THEN cast(2 AS decimal(18,6)) END AS public_monthly_cap_usd,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('model-', cast(n_nationkey % 4 AS string)) ELSE '' END AS default_model FROM @nation""",
    "org_topups": lambda e: f"""
SELECT o_orderkey AS id, cast(c_nationkey AS string) AS org_id,
  cast(CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 1 END * (o_totalprice / 1000) AS decimal(18,6)) AS amount_usd,
  {e.plus('2024-01-01 00:00:00', 'o_orderkey % 30', 'days')} AS at, o_orderkey % 997 = 5 AS removal
FROM @orders JOIN @customer ON o_custkey = c_custkey""",
    "usage_limits": lambda e: """
SELECT cast(n_nationkey AS string) AS org_id, 'agent' AS kind, cast(n_nationkey % 10 AS string) AS target_id, cast(1 AS decimal(18,6)) AS monthly_usd FROM @nation
UNION ALL SELECT cast(c_nationkey AS string), 'member', cast(c_custkey AS string), cast(0.05 AS decimal(18,6)) FROM @customer WHERE c_custkey % 4 = 0""",
    "chat_sessions": lambda e: f"""
SELECT cast(conv_id AS string) AS id, cast(conv_id % 10 AS string) AS agent_id,
  CASE conv_id % 4 WHEN 0 THEN 'widget' WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'app' ELSE 'test' END AS source,
  {e.turns('role', 'turn')} AS roles, {e.turns('text', 'turn')} AS texts,
  {e.plus('2024-01-01 00:00:00', 'conv_id', 'hours')} AS started_at, {e.plus(e.plus('2024-01-01 00:00:00', 'conv_id', 'hours'), 'count(*)', 'minutes')} AS updated_at
FROM @conversations GROUP BY conv_id""",
    "messages": lambda e: f"""
SELECT cast(user_id % 3 AS string) AS number_id, cast(event_id AS string) AS wa_id, event_id AS id, cast(user_id % 5 AS string) AS chat, cast(user_id AS string) AS phone,
  event_type = 'purchase' AS from_me, CASE WHEN {e.k} % 9 = 0 THEN '' ELSE concat(event_type, ' ', props) END AS text, {e.k} % 50 = 0 AS ended, ts,
  {e.plus('ts', f'{e.k} * 8', 'seconds')} AS arrived_at, CASE WHEN {e.k} % 6 = 0 THEN cast(event_id - {e.k} % 40 AS string) END AS quoted_wa_id
FROM @events""",
    "group_events": lambda e: f"""
SELECT event_id AS id, cast(user_id % 3 AS string) AS number_id, cast(user_id % 5 AS string) AS jid, ts AS at,
  CASE event_type WHEN 'error' THEN 'silent' WHEN 'click' THEN 'reply' WHEN 'view' THEN 'react' WHEN 'signup' THEN 'poll' ELSE 'join' END AS action, {e.k} % 2 = 0 AS unsolicited FROM @events""",
    "knowledge": lambda e: """
SELECT cast(doc_id AS string) AS id, cast(doc_id % 7 AS string) AS agent_id, CASE WHEN doc_id % 3 <> 0 THEN cast(doc_id % 3 AS string) END AS skill_id,
  concat('doc ', cast(doc_id AS string)) AS title, text AS content, source AS source_url, lang FROM @documents""",
    "questions": lambda e: "SELECT item_id AS query_id, cast(item_id % 7 AS string) AS agent_id, text AS question FROM @benchmark",
    "web_pages": lambda e: "SELECT page_id, url, html, 200 AS status, 'text/html' AS content_type FROM @pages",
    "table_rows": lambda e: "SELECT p_partkey AS id, cast(p_size % 5 AS string) AS table_id, p_name, p_brand, p_type, p_size, p_retailprice FROM @part",
    "runs": lambda e: """
SELECT o_orderkey AS id, cast(o_custkey % 40 AS string) AS automation_id, cast(c_nationkey AS string) AS org_id,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderdate AS resume_at, o_orderdate AS heartbeat_at, o_orderkey % 5 AS reclaims,
  CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'live' END AS mode FROM @orders JOIN @customer ON o_custkey = c_custkey""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name](Engine(False))
    tables = sorted(set(re.findall(r"@(\w+)", text)))
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(text: str) -> str:
    """The oracle's SQL with a WITH clause of the views that it names as `#view`."""
    names = [n for n in VIEWS if re.search(rf"#{n}\b", text)]
    views = ",\n".join(f"v_{n} AS ({VIEWS[n](Engine(True)).replace('@', '').strip()})" for n in names)
    named = re.sub(r"#(" + "|".join(VIEWS) + r")\b", r"v_\1", text).strip()
    body = re.sub(r"('(?:[^']|'')*')|\bat\b", lambda m: m[1] or '"at"', named)  # a reserved word there, but for quoted texts
    if not views:
        return body
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
