"""Queries and oracles of crawling, tables, rules, schedules, experiments and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare as cmp
from ..functions import text as tx
from ..functions import urls as u
from ..operators import crawl, experiments, schedule, tables, triggers
from ..sources import tables as src
from ..streaming import stateful, streams
from .inputs import view, with_views

AS_OF = "2024-01-15 12:00:00"


def _rows(s: SparkSession, d: str) -> DataFrame:
    """part as rows of user-shaped tables: some fields misspelt, some values refused."""
    data = F.create_map(
        F.lit("P Name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.when(F.col("p_size") % 7 == 0, F.lit("many")).otherwise(F.col("p_size").cast("string")),
        F.lit("retail-price"), F.format_string("%.2f", "p_retailprice"), F.lit("colour"), F.lit("?"),
    )
    return view(s, d, "table_rows").select("id", "table_id", data.alias("data"))


def _definitions(s: SparkSession, d: str) -> DataFrame:
    c = lambda k, n, t: F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(t).alias("type"))
    columns = F.array(c("p_name", "Name", "text"), c("brand", "Brand", "text"), c("size", "Size", "number"), c("retail_price", "Retail price", "number"))
    return view(s, d, "table_rows").select(F.col("table_id").alias("id")).distinct().withColumn("columns", columns)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "web_pages").withColumn("site", u.site_key(u.url_part(F.col("url"), "host")))


def _robots(s: SparkSession, d: str) -> DataFrame:
    """Rules of every site: /fr/ forbidden, /fr/8 allowed again, what ends in / forbidden."""
    rule = lambda i, a, p: F.struct(F.lit(i).alias("position"), F.lit(a).alias("allow"), F.lit(p).alias("path"))
    return _pages(s, d).select("site").distinct().select("site", F.explode(F.array(rule(0, False, "/fr/"), rule(1, True, "/fr/8"), rule(2, False, "/*/$"), rule(3, False, ""))).alias("r")).select("site", "r.*")


def q_frontier(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).select("site", F.regexp_replace("url", "#.*$", "").alias("url"), F.col("page_id").cast("int").alias("position"))
    return crawl.next_frontier(p.where("position % 2 = 0"), p.where("position % 2 = 1"), p.where("position % 10 = 0").select("site", "url").distinct(), _robots(s, d), 10)


def _crawled(s: SparkSession, d: str, least: int = crawl.LEAST_CHARS) -> DataFrame:
    return crawl.crawl_documents(view(s, d, "web_pages").withColumnRenamed("url", "final_url"), least)


def q_crawl_report(s: SparkSession, d: str) -> DataFrame:
    paths = _pages(s, d).select("site", u.url_part(F.col("url"), "path").alias("path"))
    return crawl.crawl_report(_crawled(s, d, 0), _pages(s, d).select("site", "url").distinct(), crawl.robots_allowed(paths, _robots(s, d)))


def q_shape(s: SparkSession, d: str) -> DataFrame:
    out = tables.shape_rows(_rows(s, d), _definitions(s, d))
    return out.select("id", F.col("data")["p_name"].alias("name"), F.col("data")["brand"].alias("brand"), F.col("data")["size"].alias("size"), F.col("data")["retail_price"].try_cast("double").alias("price"), F.array_join("unknown", ",").alias("unknown"), F.array_join(F.transform("refused", lambda r: F.concat_ws(":", r["column"], r["value"])), ",").alias("refused"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def q_compare(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    left, right = F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("k").cast("string")), F.element_at(F.array(F.lit("7.0"), F.lit("5"), F.lit("abc"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    return e.select("id", *[cmp.compare(left, op, right).alias(op) for op in cmp.OPERATORS])


def q_route(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).withColumn("t", F.col("k").cast("string"))
    a = tables.route_if(e, [(F.col("t"), "gt", F.lit("50")), (F.col("event_type"), "starts", F.lit("p"))], "any").withColumnRenamed("port", "branch")
    return tables.route_switch(a, F.col("event_type"), [("a", F.lit("click")), ("b", F.lit("view")), ("c", F.lit("click"))]).select("id", "branch", "port")


def q_days(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    y, m, dd = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")
    forms = F.array(F.concat_ws("-", y, m, dd), F.concat_ws(".", dd, m, y), F.concat_ws("/", dd, m, F.substring(y, 3, 2)), F.concat_ws("/", F.lit("13"), F.lit("31"), y))
    return o.select("o_orderkey", cmp.parse_day(F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("day"))


def q_replies(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "messages").where("not from_me").select("id", "number_id", "phone", "ts", F.when(F.col("id") % 4 == 0, "yes").alias("answer"))
    w = view(s, d, "messages").where("from_me and id % 3 = 0").select(F.col("id").alias("run_id"), "number_id", "phone", F.when(F.col("id") % 2 == 0, "approval").otherwise("reply").alias("kind"), F.col("ts").alias("started_at"), F.timestamp_add("HOUR", F.lit(48), F.col("ts")).alias("until"))
    return tables.match_replies(m, w)


def _automations(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int")
    return view(s, d, "bots").select(F.concat(F.lit("a"), "id").alias("id"), "org_id", (n % 4 > 0).alias("enabled"), (n % 5).cast("string").alias("table_id"), F.concat(F.lit("Line "), n % 3).alias("connection"), "user_id", F.col("user_id").alias("publisher"))


def q_listening(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int")
    c = view(s, d, "users").select(F.concat(F.lit("c"), "id").alias("id"), "org_id", F.concat(F.lit("LINE "), n % 3).alias("name"), (n % 2 == 0).alias("shared"), F.col("id").alias("created_by"))
    return tables.listening(_automations(s, d), c, view(s, d, "users"))


def q_row_triggers(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "table_rows").select("id", "table_id", (F.col("id") % 25).cast("string").alias("org_id"), F.concat(F.lit("automation:a"), F.col("id") % 100).alias("written_by"))
    return tables.row_triggers(r, _automations(s, d))


def q_triggers(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "messages").select("id", "number_id", "phone", "text")
    n = F.col("id").cast("int")
    t = view(s, d, "organizations").select(F.col("id").alias("trigger_id"), (n % 3).cast("string").alias("number_id"), F.when(n % 4 == 0, F.array((n * 5).cast("string"), (n + 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("senders"), F.element_at(F.array(F.lit("any"), F.lit("contains"), F.lit("starts")), n % 3 + 1).alias("match"), F.element_at(F.array(F.lit("CLICK"), F.lit("view {"), F.lit("")), n % 2 + 1).alias("words"))
    return triggers.match_messages(m, t)


def q_upsert(s: SparkSession, d: str, conflicts: bool) -> DataFrame:
    docs = view(s, d, "knowledge").select("id", "agent_id", "title")
    n = F.col("id").cast("long")
    new = docs.where("cast(id as long) % 3 = 0").select("id", F.when(n % 2 == 0, F.col("agent_id")).otherwise("x").alias("agent_id"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("new "), "id")).alias("title")).unionByName(docs.limit(0)).unionByName(docs.select(F.concat(F.lit("n"), "id").alias("id"), "agent_id", "title").where("id < 'n2'"))
    return src.guarded_upsert(docs, new, "id", ["agent_id"], keep_nonempty=["title"])[1 if conflicts else 0]


def q_replace(s: SparkSession, d: str) -> DataFrame:
    chunks = view(s, d, "knowledge").select(F.col("agent_id").alias("parent_id"), "id")
    new = chunks.where("parent_id in ('1', '2') and cast(id as long) % 2 = 0").withColumn("id", F.concat(F.lit("new"), "id"))
    return src.replace_by_key(chunks, new, "parent_id", chunks.select("parent_id").distinct().where("parent_id = '3'"))


def q_schedules(s: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    o = s.read.parquet(f"{d}/orders.parquet").select(
        n.alias("id"), F.element_at(F.array(F.lit("interval"), F.lit("daily"), F.lit("cron")), (n % 3 + 1).cast("int")).alias("mode"), (n % 9 + 1).cast("int").alias("every"), F.element_at(F.array(F.lit("minutes"), F.lit("hours"), F.lit("days")), (n % 2 + 1).cast("int")).alias("unit"),
        F.format_string("%02d:%02d", n % 24, n % 60).alias("time"), F.array((n % 7).cast("int")).alias("days"), F.concat_ws(" ", n % 60, n % 24, F.lit("* * *")).alias("cron"), F.lit("UTC").alias("zone"), F.timestamp_add("HOUR", -(n % 100).cast("int"), F.lit(AS_OF).cast("timestamp_ntz")).alias("due_at"),
    )
    return schedule.next_firings(o, AS_OF).select("id", "next_at")


def q_group_runs(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int")
    g = view(s, d, "users").select("id", F.element_at(F.array(F.lit("once"), F.lit("daily"), F.lit("weekly"), F.lit("monthly")), n % 4 + 1).alias("repeat"), F.date_format(F.date_add(F.lit("2024-01-10").cast("date"), n % 20), "yyyy-MM-dd").alias("on_date"), F.format_string("%02d:%02d", n % 24, n % 60).alias("at_time"), F.array(n % 7, (n + 2) % 7).alias("weekdays"), (n % 31 + 1).alias("month_day"), F.lit("UTC").alias("timezone"))
    return schedule.next_group_runs(g, AS_OF).select("id", "next_run_at")


def q_due_work(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    sch = view(s, d, "messages").select("id", "number_id", F.col("chat").alias("jid"), F.col("ts").alias("next_run_at"), (n % 5 > 0).alias("enabled"), (n % 13 == 0).alias("run_now"))
    return schedule.due_work(sch, sch.select("number_id", "jid").distinct().withColumn("mode", F.when(F.col("jid") == "4", "off").otherwise("smart")), AS_OF).select("id", "step")


def q_branches(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int")
    b = view(s, d, "bots").select(F.concat(F.lit("b"), "id").alias("id"), (n % 10).cast("string").alias("agent_id"), F.when(n % 5 == 0, "draft").otherwise("branch").alias("kind"), (n % 4).alias("traffic_weight"), F.lit(None).cast("timestamp_ntz").alias("merged_at"))
    se = view(s, d, "chat_sessions").select("id", "agent_id", (F.col("id").cast("int") % 3 == 0).alias("decided"), F.lit("old").alias("branch_id"))
    return experiments.assign_branches(se, b, 7)


def q_traffic(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int")
    return experiments.traffic(view(s, d, "bots").select((n % 10).cast("string").alias("agent_id"), F.when(n % 5 == 0, "draft").otherwise("branch").alias("kind"), (n % 27).alias("traffic_weight"), F.lit(None).cast("timestamp_ntz").alias("merged_at")))


def q_feed(s: SparkSession, d: str) -> DataFrame:
    items = view(s, d, "messages").select(F.col("chat").alias("feed"), "id", F.col("ts").alias("at"), (F.col("id") % 3 == 0).alias("matches"))
    cursors = items.select("feed").distinct().withColumn("cursor", F.lit("2024-01-05").cast("timestamp_ntz"))
    taken, after = experiments.poll_feed(items, cursors, 25)
    return taken.unionByName(after.select("feed", F.lit(-1).cast("long").alias("id"), F.col("cursor").alias("at")))


def q_limit(s: SparkSession, d: str) -> DataFrame:
    tries = view(s, d, "messages").select(F.col("phone").alias("bucket"), "id", "ts", (F.col("id") % 5 == 0).alias("success"), (F.col("id") % 41 == 0).alias("cleared"))
    return stateful.rate_limit(tries, 3, 86_400, 86_400)


def q_admit(s: SparkSession, d: str) -> DataFrame:
    """Calls settle after 30 seconds, every seventh is released after 20. All spend the platform's cap, nine tenths of what settles; anonymous ones the
    public cap, a person's the member cap, an item's the item cap, all the balance.
    """
    e = view(s, d, "llm_usage").where("org_id is not null")
    person, item = F.concat_ws(":", "org_id", "user_id"), F.concat_ws(":", "org_id", "item_type", "item_id")
    of = lambda when, scope, key: F.when(when, F.struct(F.lit(scope).alias("scope"), key.alias("key")))
    own = [of(F.lit(True), "platform", F.lit("")), of(F.col("item_id").isNotNull(), "item", item)]
    own += [of(F.col("user_id").isNull(), "org-public", F.col("org_id")), of(F.col("user_id").isNotNull(), "member", person)]
    e = e.withColumn("scopes", F.array_compact(F.array(*own)))
    zero, cost, freed = F.lit(0.0), F.col("cost_usd").cast("double"), F.col("id") % 7 == 0
    after = lambda seconds: F.timestamp_add("SECOND", F.lit(seconds), F.col("at"))
    row = lambda df, n, ts, kind, estimate, actual: df.select(n.alias("id"), ts.alias("ts"), F.lit(kind).alias("kind"), F.col("id").alias("call"), "org_id", "scopes", estimate.alias("estimate"), actual.alias("actual"))
    asks = row(e, F.col("id"), F.col("at"), "ask", cost * 2, zero)
    ends = row(e.where(~freed), -F.col("id") - 1, after(30), "settle", zero, cost).unionByName(row(e.where(freed), -F.col("id") - 1, after(20), "release", zero, zero))
    items = e.where("item_id is not null").select(F.lit("item").alias("scope"), item.alias("key"), "org_id").distinct().withColumn("cap_usd", F.lit(0.3))
    public = view(s, d, "org_billing").where("public_monthly_cap_usd is not null")
    public = public.select(F.lit("org-public").alias("scope"), F.col("org_id").alias("key"), "org_id", F.col("public_monthly_cap_usd").cast("double").alias("cap_usd"))
    members = view(s, d, "usage_limits").where("kind = 'member'")
    members = members.select(F.lit("member").alias("scope"), F.concat_ws(":", "org_id", "target_id").alias("key"), "org_id", F.col("monthly_usd").cast("double").alias("cap_usd"))
    cap = e.where(~freed).agg(F.floor(F.sum("cost_usd").cast("double") * 0.9)).first()[0] or 0
    return stateful.admit_calls(asks.unionByName(ends), items.unionByName(public).unionByName(members), view(s, d, "org_billing"), float(cap))


def q_bursts(s: SparkSession, d: str) -> DataFrame:
    m = streams.event_time(view(s, d, "messages").withColumn("addressed", F.col("id") % 3 == 0))
    out = streams.stream_bursts(m, gap="10 minutes")
    return out.select("number_id", "chat", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), "messages", "addressed", F.sha2("text", 256).alias("text"))


def q_rates(s: SparkSession, d: str) -> DataFrame:
    return streams.stream_rates(streams.event_time(view(s, d, "messages")), "chat", "1 hour").select("chat", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def q_stream_triggers(s: SparkSession, d: str) -> DataFrame:
    """The batch twin of the fan-out of added rows: the stream's plan over stored rows."""
    rows = view(s, d, "table_rows").select("id", "table_id", F.concat_ws("", F.col("id") % 25).alias("org_id"), F.concat(F.lit("automation:a"), F.col("id") % 50).alias("written_by"))
    return streams.stream_triggers(rows, _automations(s, d))


def q_anniversaries(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("int")
    dates = view(s, d, "users").select("id", (n % 29 + 1).alias("day"), (n % 12 + 1).alias("month"), F.when(n % 5 > 0, 1950 + n % 60).alias("year"), (n % 3 == 0).alias("hebrew"), F.when(n % 17 == 0, "2024-02-28").alias("greeted_on"))
    return schedule.anniversaries(dates, "2024-02-28").select("id", "years")


def _sha(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.sha2(F.coalesce(n, F.lit("")), 256) for n in names})


QUERIES = {
    "tx01_html_to_text": lambda s, d: _sha(view(s, d, "web_pages").select("page_id", tx.html_text(F.col("html")).alias("text")), "text"),
    "tx02_html_title": lambda s, d: view(s, d, "web_pages").select("page_id", tx.html_title(F.col("html"), u.url_part(F.col("url"), "path")).alias("title")),
    "tx03_decode_body": lambda s, d: _sha(view(s, d, "web_pages").select("page_id", crawl.decode_body(F.encode("html", "UTF-8"), F.lit("text/html")).alias("text")), "text"),
    "tx04_normalize_url": lambda s, d: view(s, d, "web_pages").select("page_id", u.normalize_url(F.col("url"), F.lit(None).cast("string")).alias("url")),
    "tx05_site_crawl_keys": lambda s, d: view(s, d, "web_pages").select("page_id", u.site_key(u.url_part(F.col("url"), "host")).alias("site"), u.crawl_key(F.col("url")).alias("key")),
    "tx06_internal_links": lambda s, d: crawl.internal_links(view(s, d, "web_pages")),
    "tx09_crawl_documents": lambda s, d: _sha(_crawled(s, d), "content"),
    "pf04_crawlable": lambda s, d: _pages(s, d).select("page_id", u.crawlable(F.col("url"), F.col("site")).alias("crawlable")),
    "pf05_robots_allowed": lambda s, d: crawl.robots_allowed(_pages(s, d).select("page_id", "site", u.url_part(F.col("url"), "path").alias("path")), _robots(s, d)).select("page_id", "allowed"),
    "tk04_next_frontier": q_frontier,
    "ag09_crawl_report": q_crawl_report,
    "ag10_recrawl_plan": lambda s, d: crawl.recrawl_plan(view(s, d, "bots").select("id", F.array(F.concat(F.lit("https://s"), F.col("id").cast("int") % 9, F.lit(".example/?a")), F.lit("ftp://x"), F.concat(F.lit("https://s"), F.col("id").cast("int") % 4, F.lit(".example/"))).alias("urls"), (F.col("id").cast("int") % 3 * 400).alias("max_pages"), F.when(F.col("id").cast("int") % 3 > 0, F.col("id")).alias("last_crawled_at"))).select("key", "max_pages", "url", F.array_join("bots", ",").alias("bots")),
    "jn14_copy_crawl": lambda s, d: crawl.copy_crawl(view(s, d, "knowledge").select("id", F.lit(None).cast("string").alias("parent_id"), "source_url", "agent_id"), view(s, d, "bots").select(F.concat(F.lit("src"), F.col("id").cast("int") % 20).alias("source_url"), F.col("id").alias("agent_id"))),
    "pf06_compare": q_compare,
    "pf07_route": q_route,
    "dt01_parse_day": q_days,
    "tx21_fill_templates": lambda s, d: tables.fill_templates(_events(s, d).withColumn("row", F.struct("event_type", "k")), {"greeting": "Hi {{ row.event_type }} #{{id}}", "number": "{{ row.k }}"}).select("id", "greeting", "number"),
    "ar03_loop_rows": lambda s, d: tables.loop_rows(view(s, d, "chat_sessions").select("id", F.when(F.col("id").cast("int") % 7 == 0, "nothing").otherwise(F.to_json("roles")).alias("items")), "items", lambda x, i: F.concat(i.cast("string"), F.lit(":"), x)).withColumn("results", F.array_join("results", ",")),
    "js03_shape_rows": q_shape,
    "js04_materialize_table": lambda s, d: tables.materialize_table(tables.shape_rows(_rows(s, d), _definitions(s, d)), [("size", "number"), ("retail_price", "number"), ("brand", "text")]),
    "pf02_search_rows": lambda s, d: tables.search_rows(_rows(s, d), "brand#2%many", 40, 3).select("id"),
    "ss05_patch_rows": lambda s, d: tables.patch_rows(_rows(s, d).withColumn("written_by", F.lit("user")), _rows(s, d).where("id % 5 = 0").select("id", F.create_map(F.lit("brand"), F.lit("new")).alias("data"), F.lit("bot").alias("written_by"))).select("id", F.col("data")["brand"].alias("brand"), F.col("data")["size"].alias("size"), "written_by"),
    "jn05_tables_for_bots": lambda s, d: tables.tables_for_bots(view(s, d, "bots").select("id", "org_id", F.array((F.col("id").cast("int") % 5).cast("string"), (F.col("id").cast("int") % 3).cast("string")).alias("tables")), view(s, d, "organizations").select((F.col("id").cast("int") % 5).cast("string").alias("id"), F.col("id").alias("org_id"))),
    "pf08_match_messages": q_triggers,
    "jn07_listening": q_listening,
    "jn08_row_triggers": q_row_triggers,
    "jn09_match_replies": q_replies,
    "pf11_run_health": lambda s, d: tables.run_health(view(s, d, "runs"), "1998-06-01 00:05:00").select("id", "health"),
    "pf11_invite_state": lambda s, d: tables.invite_state(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("revoked_at"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("used_at"), F.col("o_orderdate").alias("expires_at")), "1998-06-01 00:00:00").select("id", "state"),
    "ss03_guarded_upsert": lambda s, d: q_upsert(s, d, False),
    "ss03_upsert_conflicts": lambda s, d: q_upsert(s, d, True),
    "ss04_replace_by_key": q_replace,
    "wn01_due_runs": lambda s, d: schedule.due_runs(view(s, d, "runs"), "1998-06-01 00:05:00").select("id", "org_id", "turn"),
    "wn11_number_versions": lambda s, d: src.number_versions(view(s, d, "runs").where("status = 'queued'").select("automation_id", "id"), view(s, d, "runs").where("status = 'done'").groupBy("automation_id").agg(F.count("*").alias("version")), "automation_id", ["id"]),
    "dt02_next_firings": q_schedules,
    "dt03_next_group_runs": q_group_runs,
    "dt04_due_work": q_due_work,
    "dt05_calendar": lambda s, d: _events(s, d).select(F.to_date("ts").alias("day")).groupBy("day").agg(F.count("*").alias("n")).transform(schedule.calendar_of).select("day", "n", "weekday", "hday", "hmonth", "hyear"),
    "dt06_anniversaries": q_anniversaries,
    "ag11_snapshot_bots": lambda s, d: _sha(experiments.snapshot_bots(view(s, d, "bots"), view(s, d, "knowledge").select("agent_id", "id", "title", "content")), "documents"),
    "ag14_run_log": lambda s, d: experiments.run_log(view(s, d, "runs").select("id", "status"), s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_returnflag").alias("step_type"), F.col("l_linestatus").alias("status"))).select("id", F.size("steps").alias("steps"), F.array_join(F.transform("steps", lambda x: F.concat_ws("/", x["id"], x["step_type"], x["status"])), ",").alias("log")),
    "jn15_seed_starters": lambda s, d: experiments.seed_starters(view(s, d, "bots").select("id", F.when(F.col("id").cast("int") % 40 > 0, F.col("org_id")).alias("org_id"), F.to_json(F.array(F.struct(F.col("name").alias("title"), F.lit("text").alias("content")))).alias("documents")), view(s, d, "users")),
    "tx24_clean_hooks": lambda s, d: experiments.clean_hooks(_events(s, d).select("id", F.create_map(F.lit("Cookie"), F.lit("x"), F.lit("X-Kind"), F.col("event_type")).alias("headers"), F.concat(F.col("event_type"), F.lit("\x00")).alias("body"))).select("id", F.array_join(F.map_keys("headers"), ",").alias("names"), F.col("headers")["X-Kind"].alias("kind"), "body", "refused"),
    "tx25_content_version": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", experiments.content_version("props").alias("version")),
    "ex01_assign_branches": q_branches,
    "ex02_traffic": q_traffic,
    "st04_rate_limit": q_limit,
    "st05_detect_loops": lambda s, d: stateful.detect_loops(view(s, d, "messages").select("chat", "id", "ts", "from_me"), 600.0, 2, 1800),
    "st06_admit_calls": q_admit,
    "st02_stream_bursts": q_bursts,
    "st03_stream_rates": q_rates,
    "st10_stream_triggers": q_stream_triggers,
    "st08_poll_feed": q_feed,
    "st09_claim_status": lambda s, d: experiments.claim_status(_events(s, d).select((F.col("id") % 3000).alias("message_id"), F.col("ts").alias("at"), (F.col("k") % 2 == 0).alias("done")), "2024-01-30 20:00:00", 86_400),
    "ud01_apply_user_fn": lambda s, d: tables.apply_user_fn(_events(s, d).select("id", "value", "k"), lambda v, k: v * 2 + k, ["value", "k"], "double").select("id", F.round("result", 6).alias("result")),
}

_SITE = "regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_ALLOW = "CASE WHEN path LIKE '/fr/8%' THEN true WHEN path LIKE '/fr/%' THEN false WHEN path LIKE '/%/' THEN false ELSE true END"
_E = "e AS (SELECT event_id AS id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') AS int) AS k FROM events)"
_AUTO = "a AS (SELECT 'a' || id AS id, org_id, cast(id AS int) % 4 > 0 AS enabled, cast(cast(id AS int) % 5 AS string) AS table_id, 'line ' || (cast(id AS int) % 3) AS connection, user_id AS publisher FROM #bots)"
_SHAPE = "p AS (SELECT id, table_id, p_name AS name, p_brand AS brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE cast(p_size AS string) END AS size, cast(printf('%.2f', p_retailprice) AS double) AS price, p_size FROM #table_rows)"
_NUM = "(CASE WHEN id % 11 <> 0 AND id % 4 < 2 THEN true ELSE false END)"


def _compare_sql() -> str:
    out = []
    for name, op in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
        out.append(f"CASE WHEN {_NUM} THEN k {op} r::double ELSE l {op} r END AS {name}")
    out += ["contains(l, r) AS contains", "NOT contains(l, r) AS not_contains", "starts_with(l, r) AS starts", "ends_with(l, r) AS ends", "l = '' AS empty", "l <> '' AS not_empty"]
    return f"WITH {_E}, c AS (SELECT id, k, CASE WHEN id % 11 = 0 THEN '' ELSE cast(k AS string) END AS l, CASE id % 4 WHEN 0 THEN '7.0' WHEN 1 THEN '5' WHEN 2 THEN 'abc' ELSE '' END AS r FROM e) SELECT id, {', '.join(x if 'r::double' not in x else x.replace('r::double', 'try_cast(r AS double)') for x in out)} FROM c"


ORACLES = {
    "tx02_html_title": "SELECT page_id, substr(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), '<[^>]+>', '', 'g')), 1, 200) AS title FROM #web_pages",
    "tx03_decode_body": "SELECT page_id, sha256(html) AS text FROM #web_pages",
    "tx05_site_crawl_keys": f"SELECT page_id, {_SITE} AS site, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '') AS key FROM #web_pages",
    "pf04_crawlable": f"SELECT page_id, NOT regexp_matches({_PATH}, '(?i)\\.(pdf|docx?|jpe?g|png|css|js|xml)$') AS crawlable FROM #web_pages",
    "pf05_robots_allowed": f"SELECT page_id, {_ALLOW} AS allowed FROM (SELECT page_id, {_PATH} AS path FROM #web_pages)",
    "jn14_copy_crawl": "SELECT a.id || '-' || k.id AS id, cast(NULL AS string) AS parent_id, source_url, a.id AS agent_id FROM #knowledge k JOIN #bots a ON source_url = 'src' || (cast(a.id AS int) % 20)",
    "pf06_compare": _compare_sql(),
    "pf07_route": f"WITH {_E} SELECT id, CASE WHEN k > 50 OR starts_with(event_type, 'p') THEN 'yes' ELSE 'no' END AS branch, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'default' END AS port FROM e",
    "dt01_parse_day": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 2 THEN '20' || strftime(o_orderdate, '%y-%m-%d') END AS day FROM orders",
    "tx21_fill_templates": f"WITH {_E} SELECT id, 'Hi ' || event_type || ' #' || id AS greeting, k AS number FROM e",
    "ar03_loop_rows": "SELECT id, CASE WHEN cast(id AS int) % 7 > 0 THEN len(roles) END AS count, CASE WHEN cast(id AS int) % 7 > 0 THEN array_to_string(list_transform(roles, lambda x, i: (i - 1) || ':' || x), ',') END AS results, CASE WHEN cast(id AS int) % 7 = 0 THEN 'not a list' END AS error FROM #chat_sessions",
    "js03_shape_rows": f"WITH {_SHAPE} SELECT id, name, brand, size, price, 'colour' AS unknown, CASE WHEN size IS NULL THEN 'Size:many' ELSE '' END AS refused FROM p",
    "js04_materialize_table": f"WITH {_SHAPE} SELECT id, cast(size AS double) AS size, price AS retail_price, brand FROM p",
    "pf02_search_rows": "SELECT id FROM #table_rows WHERE p_brand LIKE 'Brand#2%' AND p_size % 7 = 0 ORDER BY id LIMIT 40 OFFSET 3",
    "ss05_patch_rows": f"WITH {_SHAPE} SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE brand END AS brand, coalesce(size, 'many') AS size, CASE WHEN id % 5 = 0 THEN 'bot' ELSE 'user' END AS written_by FROM p",
    "jn05_tables_for_bots": "SELECT DISTINCT a.id AS agent_id, t AS table_id FROM (SELECT id, org_id, unnest([cast(cast(id AS int) % 5 AS string), cast(cast(id AS int) % 3 AS string)]) AS t FROM #bots) a WHERE EXISTS (SELECT 1 FROM #organizations o WHERE cast(cast(o.id AS int) % 5 AS string) = t AND o.id = a.org_id)",
    "pf08_match_messages": """WITH t AS (SELECT id AS trigger_id, cast(id AS int) AS n, cast(cast(id AS int) % 3 AS string) AS number_id FROM #organizations), m AS (SELECT id AS message_id, number_id, phone, lower(text) AS t FROM #messages)
  SELECT message_id, trigger_id FROM m JOIN t USING (number_id) WHERE (n % 4 > 0 OR phone IN (cast(n * 5 AS string), cast(n + 1 AS string)))
  AND CASE n % 3 WHEN 0 THEN true WHEN 1 THEN contains(t, CASE n % 2 WHEN 0 THEN 'click' ELSE 'view {' END) ELSE starts_with(ltrim(t), CASE n % 2 WHEN 0 THEN 'click' ELSE 'view {' END) END""",
    "jn07_listening": f"""WITH {_AUTO} SELECT a.id AS automation_id, 'c' || c.id AS connection_id FROM a JOIN #users c ON c.org_id = a.org_id AND a.connection = 'line ' || (cast(c.id AS int) % 3) LEFT JOIN #users p ON p.id = a.publisher
  WHERE a.enabled AND (cast(c.id AS int) % 2 = 0 OR c.id = a.publisher OR coalesce(p.is_admin, false) OR (p.org_role = 'admin' AND p.org_id = a.org_id))""",
    "jn08_row_triggers": f"WITH {_AUTO} SELECT r.id AS row_id, a.id AS automation_id FROM #table_rows r JOIN a ON a.enabled AND a.table_id = r.table_id AND a.org_id = cast(r.id % 25 AS string) WHERE a.id <> 'a' || (r.id % 100)",
    "pf11_run_health": "SELECT id, CASE WHEN status = 'running' AND epoch(timestamp '1998-06-01 00:05:00' - heartbeat_at) > 600 THEN CASE WHEN reclaims > 3 THEN 'failed' ELSE 'stale' END ELSE status END AS health FROM #runs",
    "pf11_invite_state": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'revoked' WHEN o_orderkey % 5 = 0 THEN 'used' WHEN o_orderdate <= timestamp '1998-06-01' THEN 'expired' ELSE 'open' END AS state FROM orders",
    "ss03_guarded_upsert": """WITH k AS (SELECT id, cast(id AS bigint) AS n, agent_id, title FROM #knowledge) SELECT id, agent_id, CASE WHEN n % 3 = 0 AND n % 2 = 0 AND n % 4 <> 0 THEN 'new ' || id ELSE title END AS title FROM k
  UNION ALL SELECT 'n' || id, agent_id, title FROM k WHERE 'n' || id < 'n2'""",
    "ss03_upsert_conflicts": "SELECT id, 'x' AS agent_id, 'new ' || id AS title FROM #knowledge WHERE cast(id AS bigint) % 6 = 3",
    "ss04_replace_by_key": "SELECT agent_id AS parent_id, id FROM #knowledge WHERE agent_id NOT IN ('1', '2', '3') UNION ALL SELECT agent_id, 'new' || id FROM #knowledge WHERE agent_id IN ('1', '2') AND cast(id AS bigint) % 2 = 0",
    "wn01_due_runs": """WITH d AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY resume_at, id) AS turn FROM #runs WHERE status = 'queued' AND resume_at <= timestamp '1998-06-01 00:05:00' OR status = 'running' AND epoch(timestamp '1998-06-01 00:05:00' - heartbeat_at) > 600)
  SELECT id, org_id, turn FROM d WHERE turn <= 5 ORDER BY turn, resume_at, id LIMIT 20""",
    "wn11_number_versions": "SELECT automation_id, id, coalesce((SELECT count(*) FROM #runs c WHERE c.status = 'done' AND c.automation_id = r.automation_id), 0) + row_number() OVER (PARTITION BY automation_id ORDER BY id) AS version FROM #runs r WHERE status = 'queued'",
    "dt02_next_firings": """WITH o AS (SELECT o_orderkey AS n, timestamp '2024-01-15 12:00:00' AS t FROM orders),
  i AS (SELECT n, t, t - to_hours(cast(n % 100 AS int)) AS due, (n % 9 + 1) * CASE WHEN n % 2 = 0 THEN 1 ELSE 60 END AS p FROM o WHERE n % 3 = 0),
  d AS (SELECT n, date_trunc('day', t) + to_hours(cast(n % 24 AS int)) + to_minutes(cast(n % 60 AS int)) AS today, t FROM o WHERE n % 3 > 0)
  SELECT n AS id, due + to_minutes(cast(p * greatest(1, floor(date_diff('minute', due, t) / p) + 1) AS bigint)) AS next_at FROM i
  UNION ALL SELECT n, CASE WHEN n % 3 = 2 THEN CASE WHEN today > t THEN today ELSE today + interval 1 day END
    ELSE today + to_days(cast((n % 7 - 1 + 7) % 7 + CASE WHEN (n % 7 - 1 + 7) % 7 = 0 AND today <= t THEN 7 ELSE 0 END AS int)) END FROM d""",
    "dt03_next_group_runs": """WITH s AS (SELECT id, cast(id AS int) AS n, timestamp '2024-01-15 12:00:00' AS t, to_hours(cast(id AS int) % 24) + to_minutes(cast(id AS int) % 60) AS clock FROM #users),
  c AS (SELECT s.*, d + clock AS at, cast(d AS date) AS d FROM s, (SELECT unnest(range(timestamp '2024-01-10', timestamp '2025-02-10', interval 1 day)) AS d))
  SELECT s.id, min(c.at) AS next_run_at FROM s LEFT JOIN c ON c.id = s.id AND c.at > s.t AND CASE s.n % 4 WHEN 0 THEN c.d = date '2024-01-10' + s.n % 20 WHEN 1 THEN true WHEN 2 THEN dayofweek(c.d) IN (s.n % 7, (s.n + 2) % 7) ELSE day(c.d) = least(s.n % 31 + 1, day(last_day(c.d))) END GROUP BY s.id""",
    "dt04_due_work": """SELECT id, CASE WHEN id % 5 = 0 OR chat = '4' THEN 'wait' WHEN id % 13 = 0 THEN 'send' WHEN date_diff('second', ts, timestamp '2024-01-15 12:00:00') > 10800 AND epoch(timestamp '2024-01-15 12:00:00' - ts) >= 10801 THEN 'skip' WHEN ts <= timestamp '2024-01-15 12:00:00' OR epoch(ts - timestamp '2024-01-15 12:00:00') < 1 THEN 'send' ELSE 'wait' END AS step FROM #messages""",
    "ag10_recrawl_plan": """WITH b AS (SELECT id, cast(id AS int) AS n, CASE WHEN cast(id AS int) % 3 > 0 THEN id END AS crawled FROM #bots), due AS (SELECT * FROM b ORDER BY crawled NULLS FIRST, id LIMIT 200),
  r AS (SELECT id, crawled, greatest(least(n % 3 * 400, 500), 1) AS max_pages, p, 'https://s' || CASE p WHEN 0 THEN n % 9 ELSE n % 4 END || '.example' AS key, CASE p WHEN 0 THEN '/?a' ELSE '/' END AS rest FROM due, (SELECT unnest([0, 1]) AS p))
  SELECT key, cast(max_pages AS int) AS max_pages, first(key || rest ORDER BY crawled NULLS FIRST, id, p) AS url, string_agg(id, ',' ORDER BY crawled NULLS FIRST, id, p) AS bots FROM r GROUP BY key, max_pages""",
    "ag11_snapshot_bots": """SELECT b.id, sha256(coalesce(j, '[]')) AS documents FROM #bots b LEFT JOIN (
    SELECT agent_id, '[' || string_agg(cast(to_json({'title': title, 'content': content}) AS string), ',' ORDER BY id) || ']' AS j
    FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY id) AS place FROM #knowledge) WHERE place <= 200 GROUP BY agent_id) k ON k.agent_id = b.id""",
    "ag14_run_log": "SELECT o_orderkey AS id, count(l_linenumber) AS steps, coalesce(string_agg(l_linenumber || '/' || l_returnflag || '/' || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus), '') AS log FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "jn15_seed_starters": "SELECT u.id AS user_id, a.id AS agent_id, 0 AS position, a.name AS title, 'text' AS content FROM #bots a JOIN #users u ON cast(a.id AS int) % 40 = 0 OR u.org_id = a.org_id",
    "tx24_clean_hooks": f"WITH {_E} SELECT id, 'X-Kind' AS names, event_type AS kind, event_type AS body, false AS refused FROM e",
    "tx25_content_version": "SELECT event_id, substr(sha256(replace(props, ' ', '')), 1, 32) AS version FROM events",
    "ex02_traffic": "SELECT agent_id, sum(w) AS branches, greatest(100 - sum(w), 0) AS main, sum(w) > 100 AS rejected FROM (SELECT cast(cast(id AS int) % 10 AS string) AS agent_id, cast(id AS int) % 27 AS w FROM #bots WHERE cast(id AS int) % 5 > 0) GROUP BY 1",
    "st08_poll_feed": """WITH i AS (SELECT chat AS feed, id, ts, id % 3 = 0 AS m, count(*) FILTER (id % 3 = 0) OVER (PARTITION BY chat ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM #messages WHERE ts > timestamp '2024-01-05'), l AS (SELECT feed, min(ts) FILTER (m AND n > 25) AS x FROM i GROUP BY 1)
  SELECT feed, id, ts AS at FROM i WHERE m AND n <= 25 UNION ALL SELECT feed, -1, max(ts) FILTER (ts < coalesce(x, timestamp '2999-01-01')) FROM i JOIN l USING (feed) GROUP BY 1""",
    "st09_claim_status": f"WITH {_E}, c AS (SELECT id % 3000 AS message_id, arg_max(k % 2 = 0, (ts, k % 2 = 0)) AS done, max(ts) AS ts FROM e GROUP BY 1) SELECT message_id, CASE WHEN done THEN 'done' WHEN epoch_us(timestamp '2024-01-30 20:00:00') - epoch_us(ts) >= 86400000000 THEN 'takeable' ELSE 'busy' END AS outcome FROM c",
    "ud01_apply_user_fn": f"WITH {_E} SELECT id, round(value * 2 + k, 6) AS result FROM e",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
