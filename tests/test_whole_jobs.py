"""Registered queries do the whole job: no row or text of the inputs is left out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from botlake.functions import urls
from botlake.operators import groups, schedule, tables
from botlake.operators import knowledge as kb
from botlake.plans import registry
from botlake.plans.inputs import view
from botlake.sources.shared import dealt_join


def test_contexts_of_every_agent(spark, sf):
    prompts = {r["id"]: r["prompt"] for r in registry.queries()["tx20_build_contexts"](spark, sf).collect()}
    docs, questions = view(spark, sf, "knowledge"), view(spark, sf, "questions")
    units = {r["unit_id"]: r for r in kb.searchable_units(docs, kb.chunk_documents(docs)).collect()}
    asked = {r["query_id"]: r["agent_id"] for r in questions.collect()}
    wanted = {r["id"]: [] for r in view(spark, sf, "bots").collect()}
    assert set(prompts) == set(wanted)
    for r in sorted(kb.search(kb.searchable_units(docs, kb.chunk_documents(docs)), questions).collect(), key=lambda r: (r["query_id"], r["position"])):
        if asked[r["query_id"]] in wanted:
            wanted[asked[r["query_id"]]].append(units[r["unit_id"]])
    names = {r["id"]: r["name"] for r in view(spark, sf, "bots").collect()}
    assert any(len(u["content"]) > 40 for us in wanted.values() for u in us)
    for k, us in wanted.items():
        parts = ["You are " + names[k], *(f"[{u['title']}]\n{u['content']}" for u in us), "Today is Monday, 2024-01-15 23:30"]
        assert prompts[k] == "\n\n".join(parts)


def test_mentions_are_looked_up(spark):
    """a message meets the words after its @, not its chat's roster; the result is that of the plain statement."""
    people = [("c", "1:2@s", "Dan", "111"), ("c", "3@s", "Dan Levi", None), ("c", "4@s", "Noa", "444"), ("c", "5@s", "all", "5"), ("d", "6@s", " Ann@Bo ", ""), ("d", "7@s", "Ann", "70"), ("d", "", "Nobody", "9"), ("d", None, "None", "8"), ("d", "X@s", "X", "1_2")]
    texts = ["hi @Dan Levi and @dan!", "@Dana", "@444 ok, @NOA_ @Dan Levin @Dan  Levi", "x @all", "x@everyone @כולם", "@@all @everyone.", "@Ann@Bo @ann@bob @ann", "@x @1_2 @1 @9 @8 @nobody", "", None, "no one", "@", "@all@5 @dan@noa", "a@everyone", "@Everyone @3 @1:2"]
    rows = [(i * 2 + k, chat, t) for i, t in enumerate(texts) for k, chat in enumerate("cd")] + [(900, None, "@all @Dan"), (901, "none", "@all @Dan"), (7, "c", "@Noa again with the same id")]
    out = groups.resolve_mentions(spark.createDataFrame(rows, "id long, chat string, text string"), spark.createDataFrame(people, "chat string, jid string, name string, phone string"))
    of = lambda chat: sorted([p[1:] for p in people if p[0] == chat], key=lambda p: (p[0] is not None, p[0] or ""))
    want = sorted((i, *groups.mentions_in(t, of(chat))) for i, chat, t in rows)
    assert sorted((r["id"], r["text"], r["mentions"]) for r in out.collect()) == want
    assert "collect_list(named_struct(jid" not in out._jdf.queryExecution().optimizedPlan().toString()
    folded = groups.resolve_mentions(spark.createDataFrame([(1, "c", "@abc")], "id long, chat string, text string"), spark.createDataFrame([("c", "1@s", None, "ABC"), ("c", "2@s", "Bo", None)], "chat string, jid string, name string, phone string"))
    assert [r["mentions"] for r in folded.collect()] == [["1@s"]]  # was taken for a call to everyone


def test_sitemap_is_read_once(spark):
    """a sitemap's body does not travel with its entries, where it would be searched once an entry."""
    body = "<urlset>" + "".join(f"<url><loc> https://a/{i}?x&amp;y </loc></url>" for i in range(50)) + "<loc> </loc></urlset>"
    out = urls.parse_sitemap(spark.createDataFrame([("a", body), ("b", "<SitemapIndex><loc>m</loc>"), ("c", None)], "site string, body string"))
    assert sorted(map(tuple, out.collect())) == sorted([("a", False, f"https://a/{i}?x&y") for i in range(50)] + [("b", True, "m")])
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "body" not in above


def test_batches_are_small_and_texts_cut_once(spark, sf):
    """F12, F14, F16, F18, F22: a worker of a library job holds at most BATCH_ROWS texts, whatever the table's size; the corpus operators keep the session's batches."""
    import __spark_entry__ as driver
    from botlake import shipping

    before = spark.conf.get(shipping.BATCH)
    try:
        out = driver.queries()["tx10_chunk_documents"](spark, sf)
        assert int(spark.conf.get(shipping.BATCH)) == shipping.BATCH_ROWS == 1000
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        driver.queries()["op4_url_filters"](spark, sf)
        assert spark.conf.get(shipping.BATCH) == before
    finally:
        spark.conf.set(shipping.BATCH, before)
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "word " * 2000), ("d", "short")], "id string, content string")
    assert {r["parent_id"] for r in kb.chunk_documents(docs).collect()} == {"c"}


def test_batches_of_long_texts_are_bounded_in_bytes(spark, sf):
    """F8: a worker of a library job holds about 8 MB of texts, however long they are; the corpus operators keep the session's batches."""
    import __spark_entry__ as driver

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in names}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(0, 800, 1, 1).select(F.repeat(F.lit("word "), F.when(F.col("id") == 300, 2_500_000).otherwise(4000).cast("int")).alias("text"))
    try:
        driver.queries()["tx10_chunk_documents"](spark, sf)
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 800 and len(found) > 2 and sorted(r["size"] for r in found)[-2] < 9 << 20
        driver.queries()["op4_url_filters"](spark, sf)
        assert {k: spark.conf.get(k) for k in names} == before
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_keys_are_dealt(spark):
    """pairs of one hot key are made by many tasks; the pairs are those of a plain join."""
    rows = spark.createDataFrame([(i, "a" if i % 50 else None) for i in range(400)], "id long, k string")
    others = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z"), (None, "n")], "k string, v string")
    out = dealt_join(rows, others, ["k"], "id")
    assert out.columns == rows.join(others, "k").columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(others, "k").collect()))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in (held, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            made = dealt_join(rows, others, ["k"], "id").withColumn("t", F.spark_partition_id()).select("t").distinct().count()
            assert made >= 16
        # an automation meets its publisher before the connections: no pair is shuffled
        people = spark.createDataFrame([("p", True, "admin", "o")], "id string, is_admin boolean, org_role string, org_id string")
        autos = spark.createDataFrame([("a1", "o", True, "Line", "p"), ("a2", "o", True, "line", "q")], "id string, org_id string, enabled boolean, connection string, publisher string")
        lines = spark.createDataFrame([("c1", "o", "LINE", False, "z"), ("c2", "o", "line", True, "z"), ("c3", "o", "line", False, "q")], "id string, org_id string, name string, shared boolean, created_by string")
        out = tables.listening(autos, lines, people)
        assert sorted(map(tuple, out.collect())) == [("a1", "c1"), ("a1", "c2"), ("a1", "c3"), ("a2", "c2"), ("a2", "c3")]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftOuter") > plan.index("Join Inner")  # below the pairs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_summaries_meet_no_messages(spark):
    """messages since a start are a difference of running counts, not a join of schedules with their chat's messages."""
    message = [("1", "c" if i % 4 else None, i % 5 == 0, 3 * i) for i in range(400)]
    m = spark.createDataFrame(message, "number_id string, chat string, from_me boolean, h int").withColumn("ts", F.timestamp_add("HOUR", -F.col("h"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")))
    s = spark.createDataFrame([(1, "1", "c", "daily", None), (2, "1", "c", "weekly", None), (3, "1", "c", "weekly", 30), (4, "1", "c", "weekly", 900), (5, "1", None, "weekly", None), (6, "1", "c", "daily", 3), (2, "1", "c", "weekly", None)], "id int, number_id string, jid string, repeat string, h int")
    s = s.withColumn("last_run_at", F.timestamp_add("HOUR", -F.col("h"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))).drop("h")
    out = schedule.due_summaries(s, m, "2024-01-15 12:00:00")
    n = lambda hours: sum(1 for _, chat, me, h in message if chat and not me and h < hours)
    assert {r["id"]: r["messages"] for r in out.collect()} == {1: n(24), 2: 2 * n(168), 3: n(30), 4: n(168)}
    assert "Window" in out._jdf.queryExecution().optimizedPlan().toString()  # running counts
