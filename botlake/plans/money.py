"""Queries and oracles of usage, charges and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, money
from .inputs import view, with_views


def _charged(spark: SparkSession, d: str) -> DataFrame:
    return money.charge_usage(view(spark, d, "llm_usage"), view(spark, d, "org_billing"))


def _double(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def _items(spark: SparkSession, d: str) -> DataFrame:
    bots = view(spark, d, "bots")
    apps = view(spark, d, "organizations").select(F.col("id").alias("org_id"), F.col("id"), F.lit("").alias("name"))
    return money.chargeable_items(("agent", bots), ("app", apps))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return access.access_levels(view(spark, d, "users"), _items(spark, d), view(spark, d, "grants"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """A price list from the suppliers' numbers: model-0 to model-2 (model-3 has none)."""
    u = view(spark, d, "llm_usage").select("model").distinct().where("model <> 'model-3'")
    n = F.substring("model", 7, 1).cast("double")
    return u.select("model", (n + 1).alias("input_per_m"), (n * 4 + 2).alias("output_per_m"))


CHARGED = """charged AS (SELECT u.*, cost_usd * (100 + coalesce(markup_pct, 0)) * 0.01 AS charged_usd FROM #llm_usage u LEFT JOIN #org_billing b ON u.org_id = b.org_id)"""
SCOPES = f"""{CHARGED}, scopes AS (
  SELECT 'platform' AS scope, '' AS key, at, id, cast(cost_usd AS decimal(38,12)) AS amount FROM charged
  UNION ALL SELECT 'org-public', org_id, at, id, cast(cost_usd AS decimal(38,12)) FROM charged WHERE user_id IS NULL AND source IN ('bots', 'app')
  UNION ALL SELECT 'item', org_id || ':' || item_type || ':' || item_id, at, id, cast(charged_usd AS decimal(38,12)) FROM charged WHERE item_id IS NOT NULL
  UNION ALL SELECT 'member', org_id || ':' || user_id, at, id, cast(charged_usd AS decimal(38,12)) FROM charged WHERE user_id IS NOT NULL)"""
ITEMS = "items AS (SELECT 'agent' AS kind, org_id, id, name FROM #bots UNION ALL SELECT 'app', id, id, '' FROM #organizations)"
LEVEL = f"""{ITEMS}, levels AS (
  SELECT u.id AS user_id, i.kind, i.id AS item_id, CASE WHEN org_role = 'admin' THEN 'edit' ELSE coalesce(g.level, org_access) END AS level
  FROM #users u JOIN items i ON u.org_id = i.org_id LEFT JOIN #grants g ON g.user_id = u.id AND g.kind = i.kind AND g.item_id = i.id WHERE NOT is_admin)"""


def q_pending(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "llm_usage").select("id", "org_id", "user_id", "item_type", "item_id")
    return money.gate_calls(u, money.month_spend(_charged(spark, d)), view(spark, d, "org_billing"), view(spark, d, "usage_limits"), "2024-01-01", 1e9)


QUERIES = {
    "mn01_usage_costs": lambda s, d: money.usage_costs(view(s, d, "llm_usage").select("id", "model", "input_tokens", "output_tokens", F.when(F.col("id") % 3 == 0, F.col("cost_usd").cast("double")).alias("cost")), _catalog(s, d)).drop("cost"),
    "mn02_charge_usage": lambda s, d: _double(_charged(s, d).select("id", "org_id", "cost_usd", "charged_usd"), "cost_usd", "charged_usd"),
    "mn03_estimate_costs": lambda s, d: money.estimate_costs(
        view(s, d, "chat_sessions").select("id", F.concat(F.lit("model-"), (F.col("id").cast("int") % 4).cast("string")).alias("model"), "texts", (F.col("id").cast("int") % 3).alias("pictures"), (F.col("id").cast("int") % 5 * 1000).alias("max_tokens")), _catalog(s, d)
    ).select("id", "estimate_usd"),
    "mn05_balance_health": lambda s, d: money.balance_health(view(s, d, "org_billing"), view(s, d, "org_topups").where("not removal")),
    "ag01_month_spend": lambda s, d: _double(money.month_spend(_charged(s, d)), "spent_usd", places=6),
    "ag02_platform_report": lambda s, d: money.platform_report(_charged(s, d), view(s, d, "organizations")),
    "ag03_org_report": lambda s, d: money.org_report(_charged(s, d), _items(s, d), view(s, d, "usage_limits")),
    "ag04_member_report": lambda s, d: money.member_report(_charged(s, d), view(s, d, "users"), view(s, d, "usage_limits")),
    "ag15_ceiling_outlook": lambda s, d: money.ceiling_outlook(money.balance_health(view(s, d, "org_billing"), view(s, d, "org_topups").where("not removal")), view(s, d, "llm_usage").agg(F.sum("cost_usd").alias("spent_usd"))),
    "wn09_balance_ledger": lambda s, d: _double(money.balance_ledger(view(s, d, "org_topups"), _charged(s, d)), "amount", "balance", places=6),
    "wn10_limit_audit": lambda s, d: money.limit_audit(_charged(s, d), money.spend_scopes(_charged(s, d)).select("scope", "key").distinct().withColumn("cap_usd", F.when(F.col("scope") == "platform", 20.0).otherwise(0.5))).withColumn("spent_before", F.round("spent_before", 6)),
    "st07_gate_calls": q_pending,
    "jn16_orphan_limits": lambda s, d: _double(money.orphan_limits(view(s, d, "usage_limits"), _items(s, d), view(s, d, "users").where("cast(id as int) % 8 <> 0")), "monthly_usd"),
    "jn10_latest_topup": lambda s, d: _double(money.last_topups(view(s, d, "org_topups")), "last_topup"),
    "jn13_org_price_list": lambda s, d: money.org_price_list(_catalog(s, d), view(s, d, "org_billing")),
    "jn13_effective_models": lambda s, d: money.effective_models(
        view(s, d, "users").select("id", "org_id", F.concat(F.lit("model-"), (F.col("id").cast("int") % 4).cast("string")).alias("own_model")),
        view(s, d, "org_billing").select("org_id", "default_model", F.array(F.lit("model-1"), F.lit("model-2")).alias("allowed_models")), "model-0"),
    "so01_chargeable_items": _items,
    "jn02_access_levels": _levels,
    "jn03_visible_sessions": lambda s, d: access.visible(
        view(s, d, "messages").select("id", (F.col("id") % 10).cast("string").alias("agent_id"), F.col("phone").alias("user_id")), _levels(s, d), view(s, d, "users"), _items(s, d), "agent", "agent_id", "user_id"
    ),
    "ag06_org_summary": lambda s, d: access.org_summary(view(s, d, "organizations"), view(s, d, "users"), _items(s, d)),
    "ag06_child_counts": lambda s, d: access.child_counts(view(s, d, "users").select("id", "username"), view(s, d, "bots").select("user_id"), "id", "user_id", "bots"),
    "ag16_duplicate_claims": lambda s, d: access.duplicate_claims(view(s, d, "messages").select((F.col("phone").cast("long") % 50).cast("string").alias("phone"), F.col("number_id").alias("agent_id"))),
}

CATALOG = "catalog AS (SELECT DISTINCT model, cast(substr(model, 7, 1) AS double) + 1 AS i, cast(substr(model, 7, 1) AS double) * 4 + 2 AS o FROM #llm_usage WHERE model <> 'model-3')"
HEALTH = """health AS (
  SELECT b.org_id, round(cast(balance_usd AS double), 4) AS balance, cast(last_topup AS double) AS last_topup,
    coalesce(balance_usd > 0 AND balance_usd < last_topup * 0.2, false) AS low, coalesce(balance_usd <= 0, false) AS stopped,
    CASE WHEN balance_usd IS NOT NULL THEN round(greatest(cast(balance_usd AS double), 0) / (1 + cast(markup_pct AS double) / 100), 4) END AS can_still_cost_usd,
    coalesce(cast(public_monthly_cap_usd AS double), 25.0) AS public_cap_usd
  FROM #org_billing b LEFT JOIN (SELECT org_id, arg_max(amount_usd, (at, id)) AS last_topup FROM #org_topups WHERE amount_usd > 0 AND NOT removal GROUP BY org_id) t ON b.org_id = t.org_id)"""

ORACLES = {
    "mn01_usage_costs": f"""WITH {CATALOG} SELECT id, u.model, cast(input_tokens AS bigint) AS input_tokens, cast(output_tokens AS bigint) AS output_tokens,
  coalesce(CASE WHEN id % 3 = 0 THEN cast(cost_usd AS double) END, CASE WHEN input_tokens > 0 OR output_tokens > 0 THEN round((input_tokens * coalesce(i, 10.0) + output_tokens * coalesce(o, 40.0)) / 1e6, 6) END) AS cost_usd
  FROM #llm_usage u LEFT JOIN catalog c ON u.model = c.model""",
    "mn02_charge_usage": f"WITH {CHARGED} SELECT id, org_id, round(cast(cost_usd AS double), 9) AS cost_usd, round(cast(charged_usd AS double), 9) AS charged_usd FROM charged",
    "mn03_estimate_costs": f"""WITH {CATALOG}, r AS (SELECT cast(id AS int) AS n, id, coalesce(list_sum(list_transform(texts, lambda x: length(x))), 0) + cast(id AS int) % 3 * 4500 AS chars FROM #chat_sessions)
  SELECT id, round(((ceil(chars / 3.0) + 50) * coalesce(i, 10.0) + CASE WHEN n % 5 > 0 THEN n % 5 * 1000 ELSE 4096 END * coalesce(o, 40.0)) / 1e6, 6) AS estimate_usd FROM r LEFT JOIN catalog ON model = 'model-' || (n % 4)""",
    "mn05_balance_health": f"WITH {HEALTH} SELECT * FROM health",
    "ag01_month_spend": f"WITH {SCOPES} SELECT scope, key, cast(date_trunc('month', at) AS date) AS month, round(cast(sum(amount) AS double), 6) AS spent_usd FROM scopes GROUP BY ALL",
    "ag02_platform_report": f"""WITH {CHARGED} SELECT o.id, o.name, count(c.id) AS calls, cast(coalesce(sum(input_tokens), 0) AS bigint) AS input, cast(coalesce(sum(output_tokens), 0) AS bigint) AS output,
  cast(coalesce(round(sum(cost_usd), 4), 0) AS double) AS usd, cast(coalesce(round(sum(charged_usd), 4), 0) AS double) AS charged, cast(round(coalesce(sum(charged_usd) - sum(cost_usd), 0), 4) AS double) AS profit,
  cast(coalesce(round(sum(cost_usd), 4), 0) AS double) / 50 AS share FROM #organizations o LEFT JOIN charged c ON c.org_id = o.id GROUP BY o.id, o.name""",
    "ag03_org_report": f"""WITH {CHARGED}, {ITEMS}, used AS (SELECT org_id, CASE WHEN item_id IS NULL THEN 'platform' ELSE item_type END AS kind, coalesce(item_id, source) AS id, count(*) AS calls, sum(charged_usd) AS charged FROM charged GROUP BY ALL)
  SELECT coalesce(i.org_id, u.org_id) AS org_id, coalesce(i.kind, u.kind) AS kind, coalesce(i.id, u.id) AS id,
    CASE WHEN i.id IS NOT NULL THEN CASE WHEN i.name = '' THEN '(unnamed)' ELSE i.name END WHEN u.kind = 'platform' THEN u.id ELSE '(deleted)' END AS name,
    coalesce(calls, 0) AS calls, cast(coalesce(round(charged, 4), 0) AS double) AS charged, cast(monthly_usd AS double) AS limit_usd
  FROM items i FULL JOIN used u ON i.org_id = u.org_id AND i.kind = u.kind AND i.id = u.id
  LEFT JOIN #usage_limits l ON l.org_id = coalesce(i.org_id, u.org_id) AND l.kind = coalesce(i.kind, u.kind) AND l.target_id = coalesce(i.id, u.id)""",
    "ag04_member_report": f"""WITH {CHARGED} SELECT u.org_id, u.id AS user_id, username, count(c.id) AS calls, cast(coalesce(round(sum(charged_usd), 4), 0) AS double) AS charged, cast(any_value(monthly_usd) AS double) AS limit_usd
  FROM #users u LEFT JOIN charged c ON c.user_id = u.id AND c.org_id = u.org_id LEFT JOIN #usage_limits l ON l.org_id = u.org_id AND l.kind = 'member' AND l.target_id = u.id GROUP BY u.org_id, u.id, username""",
    "ag15_ceiling_outlook": f"""WITH {HEALTH}, p AS (SELECT round(sum(can_still_cost_usd), 4) AS promised_usd FROM health), s AS (SELECT round(greatest(50 - cast(round(sum(cost_usd), 4) AS double), 0), 4) AS left_usd FROM #llm_usage)
  SELECT promised_usd, left_usd, promised_usd > left_usd AS over FROM p, s""",
    "wn09_balance_ledger": f"""WITH {CHARGED}, r AS (
    SELECT org_id, at, 0 AS step, id, CASE WHEN NOT removal THEN cast(amount_usd AS decimal(38,12)) END AS amount, removal FROM #org_topups
    UNION ALL SELECT org_id, at, 1, id, -cast(charged_usd AS decimal(38,12)), false FROM charged),
  e AS (SELECT *, count(*) FILTER (removal) OVER (PARTITION BY org_id ORDER BY at, step, id ROWS UNBOUNDED PRECEDING) AS era FROM r),
  f AS (SELECT *, count(*) FILTER (step = 0 AND NOT removal) OVER (PARTITION BY org_id, era ORDER BY at, step, id ROWS UNBOUNDED PRECEDING) > 0 AND NOT removal AS live FROM e)
  SELECT org_id, at, CASE step WHEN 0 THEN 'topup' ELSE 'charge' END AS kind, id, round(cast(amount AS double), 6) AS amount,
    CASE WHEN live THEN round(cast(sum(amount) FILTER (live) OVER (PARTITION BY org_id, era ORDER BY at, step, id ROWS UNBOUNDED PRECEDING) AS double), 6) END AS balance FROM f""",
    "wn10_limit_audit": f"""WITH {SCOPES}, r AS (SELECT *, CASE scope WHEN 'platform' THEN 20.0 ELSE 0.5 END AS cap, coalesce(sum(cast(amount AS decimal(38,12))) OVER (PARTITION BY scope, key, date_trunc('month', at) ORDER BY at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM scopes)
  SELECT scope, key, id, at, round(cast(b AS double), 6) AS spent_before, b < cap AND b + cast(amount AS decimal(38,12)) >= cap AS crossed FROM r""",
    "st07_gate_calls": f"""WITH {SCOPES}, m AS (SELECT scope, key, sum(cast(amount AS decimal(38,12))) AS s FROM scopes WHERE date_trunc('month', at) = date '2024-01-01' GROUP BY ALL)
  SELECT c.id, c.org_id, c.user_id, c.item_type, c.item_id, CASE WHEN balance_usd <= 0 THEN 'ORG_BALANCE' WHEN coalesce(i.s, 0) >= il.monthly_usd THEN 'ITEM_LIMIT' WHEN coalesce(m2.s, 0) >= ml.monthly_usd THEN 'MEMBER_LIMIT' END AS refusal
  FROM charged c LEFT JOIN #org_billing b ON b.org_id = c.org_id
  LEFT JOIN m i ON i.scope = 'item' AND i.key = c.org_id || ':' || c.item_type || ':' || c.item_id LEFT JOIN m m2 ON m2.scope = 'member' AND m2.key = c.org_id || ':' || c.user_id
  LEFT JOIN #usage_limits il ON il.org_id = c.org_id AND il.kind = c.item_type AND il.target_id = c.item_id LEFT JOIN #usage_limits ml ON ml.org_id = c.org_id AND ml.kind = 'member' AND ml.target_id = c.user_id""",
    "jn16_orphan_limits": f"""WITH {ITEMS} SELECT org_id, kind, target_id, cast(monthly_usd AS double) AS monthly_usd FROM #usage_limits l
  WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.org_id = l.org_id AND i.kind = l.kind AND i.id = l.target_id) AND NOT EXISTS (SELECT 1 FROM #users u WHERE cast(u.id AS int) % 8 <> 0 AND l.kind = 'member' AND u.org_id = l.org_id AND u.id = l.target_id)""",
    "jn10_latest_topup": "SELECT org_id, cast(arg_max(amount_usd, (at, id)) AS double) AS last_topup FROM #org_topups WHERE amount_usd > 0 GROUP BY org_id",
    "jn13_org_price_list": f"WITH {CATALOG} SELECT org_id, model, round(i * (1 + cast(markup_pct AS double) / 100), 4) AS input_per_m, round(o * (1 + cast(markup_pct AS double) / 100), 4) AS output_per_m FROM #org_billing, catalog",
    "jn13_effective_models": """WITH p AS (SELECT id, u.org_id, 'model-' || (cast(id AS int) % 4) AS own_model, coalesce(nullif(default_model, ''), 'model-0') AS d FROM #users u LEFT JOIN #org_billing b ON b.org_id = u.org_id)
  SELECT id, org_id, own_model, CASE WHEN own_model IN ('model-1', 'model-2') OR own_model = d THEN own_model ELSE d END AS model FROM p""",
    "so01_chargeable_items": f"WITH {ITEMS} SELECT * FROM items",
    "jn02_access_levels": f"""WITH {LEVEL} SELECT DISTINCT u.id AS user_id, i.kind, cast(NULL AS string) AS item_id, CASE WHEN org_role = 'admin' THEN 'edit' ELSE org_access END AS level
    FROM #users u JOIN items i ON u.org_id = i.org_id WHERE NOT is_admin
  UNION ALL SELECT l.user_id, l.kind, l.item_id, l.level FROM levels l JOIN #users u ON u.id = l.user_id WHERE l.level <> CASE WHEN org_role = 'admin' THEN 'edit' ELSE org_access END""",
    "jn03_visible_sessions": f"""WITH {LEVEL}, s AS (SELECT id, cast(id % 10 AS string) AS agent_id, phone AS user_id FROM #messages)
  SELECT agent_id, user_id, id FROM s WHERE EXISTS (SELECT 1 FROM levels l WHERE l.kind = 'agent' AND l.level <> 'none' AND l.item_id = agent_id AND l.user_id = s.user_id)
    OR EXISTS (SELECT 1 FROM #users u, #bots b WHERE u.id = s.user_id AND u.is_admin AND b.id = s.agent_id)""",
    "ag06_org_summary": f"""WITH {ITEMS} SELECT o.id, o.name, (SELECT count(*) FROM #users u WHERE u.org_id = o.id) AS members, (SELECT count(*) FROM #users u WHERE u.org_id = o.id AND org_role = 'admin') AS admins,
  (SELECT count(*) FROM items i WHERE i.org_id = o.id AND kind = 'agent') AS bots, cast(0 AS bigint) AS tables, (SELECT count(*) FROM items i WHERE i.org_id = o.id AND kind = 'app') AS apps FROM #organizations o""",
    "ag06_child_counts": "SELECT u.id, username, count(a.id) AS bots FROM #users u LEFT JOIN #bots a ON a.user_id = u.id GROUP BY u.id, username",
    "ag16_duplicate_claims": "SELECT cast(cast(phone AS bigint) % 50 AS string) AS phone, count(DISTINCT number_id) AS claims, list_sort(list(DISTINCT number_id)) AS bots FROM #messages GROUP BY 1 HAVING count(DISTINCT number_id) > 1",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
