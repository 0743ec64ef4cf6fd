"""More queries and oracles: definitions, files of sites, catalogs, starters, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators import experiments, knowledge, money, schedule, tables
from .inputs import view, with_views

AS_OF = "2024-01-15 12:00:00"


def _sites(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "web_pages").select("page_id", "url", u.site_key(u.url_part(F.col("url"), "host")).alias("site"))


def q_robots(s: SparkSession, d: str) -> DataFrame:
    """A robots file for every site: a group for all, a group for our crawler."""
    body = F.concat(F.lit("User-agent: *\nDisallow: /\nUser-agent: OurBot\nDisallow: /private # no\nAllow: /"), "site", F.lit("\nSitemap: https://"), "site", F.lit("/map.xml\nCrawl-delay: 2\n"))
    return u.parse_robots(_sites(s, d).select("site").distinct().withColumn("body", body), "ourbot")


def q_sitemap(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    return u.parse_sitemap(_sites(s, d).groupBy("site").agg(body.alias("body")))


def q_columns(s: SparkSession, d: str) -> DataFrame:
    c = lambda key, name, kind: F.struct(F.lit(key).cast("string").alias("key"), name.alias("name"), F.lit(kind).alias("type"))
    defined = F.array(c(None, F.col("p_name"), "text"), c(None, F.upper("p_name"), "number"), c("k", F.col("p_brand"), "odd"), c("k", F.lit("Again"), "date"))
    return view(s, d, "table_rows").select("id", tables.normalize_columns(defined).alias("c")).select("id", F.array_join(F.transform("c", lambda x: F.concat_ws("/", x["key"], x["name"], x["type"])), ",").alias("columns"))


def q_find_tables(s: SparkSession, d: str) -> DataFrame:
    wanted = view(s, d, "users").select(F.col("id").alias("request_id"), "org_id", F.when(F.col("id").cast("int") % 2 == 0, F.col("org_id")).otherwise(F.concat(F.lit("nation-"), "org_id")).alias("ref"))
    return tables.find_tables(wanted, view(s, d, "organizations").select("id", F.col("id").alias("org_id"), "name"))


def q_catalog(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "table_rows").select("id", (F.col("p_retailprice") / 1e9).cast("string").alias("prompt_price"), (F.col("p_size") / 1e6).cast("string").alias("completion_price"), F.when(F.col("id") % 2 == 0, F.array(F.lit("tools"))).otherwise(F.array(F.lit("response_format"))).alias("parameters"), F.concat(F.lit("A [model]("), "p_brand", F.lit(")  of\n"), "p_type").alias("description"))
    return experiments.clean_catalog(p)


def q_summaries(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "messages")
    n = F.col("id")
    sch = m.where("id % 50 = 0").select("id", "number_id", F.col("chat").alias("jid"), F.when(n % 3 == 0, "daily").otherwise("weekly").alias("repeat"), F.when(n % 4 == 0, F.timestamp_add("DAY", -(n % 13).cast("int"), F.lit(AS_OF).cast("timestamp_ntz"))).alias("last_run_at"))
    return schedule.due_summaries(sch, m, AS_OF)


def q_drift(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "knowledge").select("agent_id", "id", "title", "content")
    now = experiments.snapshot_bots(view(s, d, "bots"), docs)
    then = experiments.snapshot_bots(view(s, d, "bots"), docs.withColumn("title", F.when(F.col("agent_id") == "3", F.upper("title")).otherwise(F.col("title"))))
    return experiments.starter_drift(then, now)


def q_restore(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "knowledge").select("id", F.lit("rewritten").alias("content"), F.when(F.col("id").cast("long") % 2 == 0, F.col("content")).alias("raw_content"), F.lit(True).alias("normalized"))
    return knowledge.restore_originals(docs).select("id", F.sha2("content", 256).alias("content"), "normalized")


def q_stop(s: SparkSession, d: str) -> DataFrame:
    se = view(s, d, "chat_sessions").select("id", "updated_at", F.lit("b1").alias("branch_id"))
    return experiments.stop_experiments(view(s, d, "bots").select("id", F.lit(3).alias("traffic_weight")), se, "2024-01-03 00:00:00")[1].select("id", "branch_id")


def q_sabbath(s: SparkSession, d: str) -> DataFrame:
    days = s.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day")).distinct()
    return schedule.sabbath_times(days)


QUERIES = {
    "tx07_parse_robots": q_robots,
    "tx08_parse_sitemap": q_sitemap,
    "js02_normalize_columns": q_columns,
    "jn05_find_tables": q_find_tables,
    "mn04_clean_catalog": q_catalog,
    "dt04_due_summaries": q_summaries,
    "dt05_sabbath_times": q_sabbath,
    "ag11_starter_drift": q_drift,
    "tx12_restore_originals": q_restore,
    "ex02_stop_experiments": q_stop,
    "tx15_redact_definitions": lambda s, d: view(s, d, "users").select("id", experiments.redact_definitions(F.to_json(F.struct("username", F.col("org_role").alias("token"), F.struct(F.col("id").alias("apiKey"), "org_id").alias("inner")))).alias("definition")),
    "jn12_unused_items": lambda s, d: money.org_report(money.charge_usage(view(s, d, "llm_usage"), view(s, d, "org_billing")), money.chargeable_items(("agent", view(s, d, "bots"))), view(s, d, "usage_limits")).where("calls = 0").select("org_id", "kind", "id", "name", "limit_usd"),
}

_SITE = "regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '')"
ORACLES = {
    "tx07_parse_robots": f"""WITH s AS (SELECT DISTINCT {_SITE} AS site FROM #web_pages)
  SELECT site, 0 AS position, false AS allow, '/private' AS path, 2000 AS delay_ms FROM s UNION ALL SELECT site, 1, true, '/' || site, 2000 FROM s UNION ALL SELECT site, 0, NULL, 'https://' || site || '/map.xml', 2000 FROM s""",
    "tx08_parse_sitemap": f"SELECT {_SITE} AS site, false AS is_index, url AS loc FROM #web_pages",
    "js02_normalize_columns": "SELECT id, k || '/' || p_name || '/text,' || k || '_2/' || upper(p_name) || '/number,k/' || p_brand || '/text,again/Again/date' AS columns FROM (SELECT *, replace(p_name, ' ', '_') AS k FROM #table_rows)",
    "mn04_clean_catalog": "SELECT id, round(p_retailprice / 1e9 * 1e6, 4) AS input_per_m, round(p_size / 1e6 * 1e6, 4) AS output_per_m, id % 2 = 0 AS tools, id % 2 <> 0 AS json, 'A model of ' || p_type AS description FROM #table_rows",
    "dt04_due_summaries": """WITH s AS (SELECT id, number_id, chat, greatest(coalesce(CASE WHEN id % 4 = 0 THEN timestamp '2024-01-15 12:00:00' - to_days(cast(id % 13 AS int)) END, timestamp '2024-01-15 12:00:00' - to_days(CASE WHEN id % 3 = 0 THEN 1 ELSE 7 END)), timestamp '2024-01-08 12:00:00') AS since FROM #messages WHERE id % 50 = 0)
  SELECT s.id, since, count(*) AS messages FROM s JOIN #messages m ON m.number_id = s.number_id AND m.chat = s.chat AND NOT m.from_me AND m.ts > since AND m.ts <= timestamp '2024-01-15 12:00:00' GROUP BY 1, 2 HAVING count(*) >= 5""",
    "tx12_restore_originals": "SELECT id, sha256(CASE WHEN cast(id AS bigint) % 2 = 0 THEN content ELSE 'rewritten' END) AS content, false AS normalized FROM #knowledge",
    "ex02_stop_experiments": "SELECT id, CASE WHEN date_diff('second', updated_at, timestamp '2024-01-03 00:00:00') < 31 * 60 THEN 'b1' END AS branch_id FROM #chat_sessions",
    "tx15_redact_definitions": "SELECT id, '{\"username\":\"' || username || '\",\"token\":\"\",\"inner\":{\"apiKey\":\"\",\"org_id\":\"' || org_id || '\"}}' AS definition FROM #users",
    "jn12_unused_items": "SELECT a.org_id, 'agent' AS kind, a.id, a.name, cast(l.monthly_usd AS double) AS limit_usd FROM #bots a LEFT JOIN #usage_limits l ON l.org_id = a.org_id AND l.kind = 'agent' AND l.target_id = a.id WHERE NOT EXISTS (SELECT 1 FROM #llm_usage u WHERE u.org_id = a.org_id AND u.item_type = 'agent' AND u.item_id = a.id)",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
