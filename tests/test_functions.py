"""Rules of the helpers, by small hand-written cases and slow plain statements."""

from __future__ import annotations

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from botlake.functions import compare as cmp
from botlake.functions import text as tx
from botlake.functions import urls as u
from botlake.operators import chats, crawl, experiments, groups, knowledge, money, schedule, tables
from botlake.sources import docx
from botlake.sources.tables import guarded_upsert, read_table, replace_by_key
from botlake.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://EX.com/a/b/?utm_source=x&page=2#top", "https://ex.com/a/b?page=2"),
        ("http://u:p@ex.com:80//a//b/", "http://ex.com/a/b"),
        ("https://ex.com/?b=2&a=1&gclid=3", "https://ex.com/?a=1&b=2"),
        ("mailto:a@b.c", None),
        ("ftp://ex.com/a", None),
        (None, None),
    ],
)
def test_canonical(url, expected):
    assert u.canonical(url) == expected


def test_canonical_resolves():
    assert u.canonical("../c?x=1", "https://ex.com/a/b/") == "https://ex.com/a/c?x=1"


def test_internal_links(spark):
    html = """<a href="/a">1</a><a class=x href='/b?page=2'>2</a><a href=/c#t>3</a><a href="mailto:x@y.z">4</a><a href="https://other.com/">5</a><a href="/d.jpg">6</a><a href="#top">7</a>"""
    df = spark.createDataFrame([(1, "https://www.ex.com/", html), (2, None, None)], "page_id long, url string, html string")
    assert sorted(r["link"] for r in crawl.internal_links(df).collect()) == ["https://www.ex.com/a", "https://www.ex.com/b?page=2", "https://www.ex.com/c"]
    df = spark.createDataFrame([(1, "https://ex.com/x/", html)], "page_id long, url string, html string")
    assert sorted(r["link"] for r in crawl.internal_links(df).collect()) == ["https://ex.com/a", "https://ex.com/b?page=2", "https://ex.com/c"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: OtherBot\nUser-agent: OurBot/1\nDisallow: /private\nAllow: /private/public\nDisallow: /*.php$\nCrawl-delay: 99\nSitemap: https://ex.com/map.xml\n"
    rules = u.parse_robots(spark.createDataFrame([("ex.com", body)], "site string, body string"), "ourbot")
    paths = ["/private", "/private/public/x", "/a.php", "/a.php?x", "/", "/private/x.php"]
    got = {r["path"]: r["allowed"] for r in crawl.robots_allowed(spark.createDataFrame([("ex.com", p) for p in paths], "site string, path string"), rules).collect()}
    assert got == {"/private": False, "/private/public/x": True, "/a.php": False, "/a.php?x": True, "/": True, "/private/x.php": False}
    assert {r["delay_ms"] for r in rules.collect()} == {5000}


def test_sitemap(spark):
    df = u.parse_sitemap(spark.createDataFrame([("s", "<urlset><loc> https://a/?x=1&amp;y=2 </loc><LOC>b</LOC></urlset>"), ("i", "<sitemapindex><loc>c</loc></sitemapindex>"), ("n", None)], "site string, body string"))
    assert {(r["site"], r["is_index"], r["loc"]) for r in df.collect()} == {("s", False, "https://a/?x=1&y=2"), ("s", False, "b"), ("i", True, "c")}


def test_decode_body(spark):
    hebrew = "שלום"
    df = spark.createDataFrame([(bytearray(hebrew.encode("windows-1255")), "text/html; charset=windows-1255"), (bytearray(b"<meta charset=windows-1255>" + hebrew.encode("windows-1255")), "text/html"), (bytearray(hebrew.encode()), None), (None, None)], "b binary, c string")
    got = [r["t"] for r in df.select(crawl.decode_body("b", "c").alias("t")).collect()]
    assert got == [hebrew, "<meta charset=windows-1255>" + hebrew, hebrew, None]


def test_crawl_documents(spark):
    text = "<html><title>T</title><p>" + "word " * 30 + "</p>"
    rows = [(1, "https://ex.com/a", 200, "text/html", text), (2, "https://ex.com/a/#x", 200, "text/html", text), (3, "https://ex.com/b", 500, "text/html", text), (4, "https://ex.com/c", 200, "image/png", text), (5, "https://ex.com/d", 200, "", "<html>" + "<p>long text </p>" * 20_000), (6, "https://ex.com/e", 200, "text/html", "<p>short</p>")]
    out = {r["page_id"]: r for r in crawl.crawl_documents(spark.createDataFrame(rows, "page_id long, final_url string, status int, content_type string, html string")).collect()}
    assert set(out) == {1, 5} and out[5]["truncated"] and len(out[5]["content"]) <= 60_100 and out[1]["title"] == "T"


def test_html_to_text():
    page = "<nav>x</nav><h1>Top <b>x</b></h1><p>a&amp;b</p><ul><li>one<li><a></a></li></ul><table><tr><td>1</td><td>2</td></tr></table><script>bad</script>"
    assert tx.html_to_text(page) == "## Top  x\n\na&b\n\n- one\n\n1 2".replace("Top  x", "Top x")
    assert tx.html_to_text(None) == ""


@pytest.mark.parametrize("word, expected", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("sky", "sky"), ("dying", "die"), ("cats", "cat"), ("national", "nation"), ("happy", "happi"), ("by", "by"), ("controlling", "control")])
def test_stem(word, expected):
    assert tx.stem(word) == expected


def test_chunks_cover_the_text():
    rng = random.Random(4)
    words = ["alpha", "beta.", "gamma", "delta!", "eps"]
    for _ in range(30):
        text = "\n\n".join(" ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(rng.randrange(1, 400))) for _ in range(rng.randrange(1, 8)))
        chunks = tx.chunk_text(text)
        assert all(len(c) <= 900 * 1.6 + 150 + 200 for c in chunks)
        assert set(text.split()) <= {w for c in chunks for w in c.split()}
    assert tx.chunk_text("short") == ["short"] and tx.chunk_text(None) == [] and tx.chunk_text("  ") == []
    headed = "## Prices\n\n" + "\n\n".join("x" * 500 for _ in range(3))
    assert all("Prices" in c for c in tx.chunk_text(headed))


def test_slices():
    assert tx.slice_text("") == [""] and tx.slice_text(None) == [""]
    parts = tx.slice_text("\n\n".join("p" * 4000 for _ in range(5)))
    assert [len(p) for p in parts] == [8002, 8002, 4000]


def test_masks(spark):
    mask = lambda t: one(spark, tx.mask_pii(F.lit(t), F.lit(True), F.lit(True)))
    assert mask("id 123456789, card 1234-5678 9012 3456.") == "id [MASKED], card [MASKED]."
    assert mask("1234567890 x123456789") == "1234567890 x123456789"
    assert one(spark, tx.mask_secrets(F.lit('{"a":"my key is s3cr\\"et"}'), F.array(F.lit('s3cr"et'), F.lit("abc")))) == '{"a":"my key is ••••"}'


@pytest.mark.parametrize("text, expected", [("050-123 4567", "972501234567"), ("+972 54-555 0118", "972545550118"), ("501234567", "972501234567"), ("00441234567890", "441234567890"), ("123", None), (None, None)])
def test_phone(spark, text, expected):
    assert one(spark, tx.normalize_phone(F.lit(text).cast("string"))) == expected


def test_recipient(spark):
    assert one(spark, tx.recipient_of(F.lit("12-3@g.us"))) == "12-3@g.us"
    assert one(spark, tx.recipient_of(F.lit("972545550118@s.whatsapp.net"))) == "972545550118"


@pytest.mark.parametrize("text, expected", [("Yes!", "yes"), (" כן ", "yes"), ("no.", "no"), ("❌", "no"), ("yes please", None), ("", None), (None, None)])
def test_read_answer(spark, text, expected):
    assert one(spark, tx.read_answer(F.lit(text).cast("string"))) == expected


def test_json_reply(spark):
    for text, expected in (('```json\n{"a":1}\n```', '{"a":1}'), ('Here: [1,2] ok', "[1,2]"), ("none", None)):
        assert one(spark, tx.parse_json_reply(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("9.1.2025", "2025-01-09"), ("21/01/2025", "2025-01-21"), ("1/21/2025", "2025-01-21"), ("19/9/26", "2026-09-19"), ("32/1/2025", None), ("2025-02-31", "2025-02-31"), ("2025-3-4T10:00", "2025-03-04"), ("March 5, 2024", "2024-03-05"), ("words", None), ("", None)],
)
def test_parse_day(spark, text, expected):
    assert one(spark, cmp.parse_day(F.lit(text))) == expected


@pytest.mark.parametrize("value, kind, expected", [("1,250", "number", "1250"), ("1.5", "number", "1.5"), ("about fifty", "number", None), ("Yes", "boolean", "true"), ("כן", "boolean", "true"), ("לא", "boolean", "false"), ("perhaps", "boolean", None), ("", "number", ""), (None, "date", ""), ("x" * 5000, "text", "x" * 4000)])
def test_coerce(spark, value, kind, expected):
    assert one(spark, cmp.coerce(F.lit(value).cast("string"), F.lit(kind))) == expected


@pytest.mark.parametrize("left, op, right, expected", [("10", "gt", "9", True), ("10", "eq", "10.0", True), ("abc", "lt", "abd", True), (None, "empty", "", True), ("a b", "contains", "b", True), ("a", "not_contains", "b", True), ("1e3", "eq", "1000", True), ("1,000", "gt", "5", False)])
def test_compare(spark, left, op, right, expected):
    assert one(spark, cmp.compare(F.lit(left).cast("string"), op, F.lit(right))) is expected


def test_compare_lists(spark):
    xs = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, cmp.compare(xs, "contains", F.lit("b"), is_list=True)) and not one(spark, cmp.compare(xs, "contains", F.lit("ab"), is_list=True))
    assert one(spark, cmp.compare(F.array().cast("array<string>"), "empty", F.lit(""), is_list=True))
    with pytest.raises(ValueError):
        cmp.compare(F.lit("a"), "like", F.lit("b"))


def test_column_keys():
    c = lambda name, key=None, kind="text": {"key": key, "name": name, "type": kind}
    got = tables.column_keys([c("total"), c("Total"), c("  "), c("שם מלא", kind="odd"), c("x", key="total"), c(None)])
    assert [x["key"] for x in got] == ["total", "total_2", "column", "שם_מלא", "x"] and got[3]["type"] == "text"


def test_next_cron():
    at = lambda *a: dt.datetime(*a)
    assert schedule.next_cron("0 9 * * *", at(2024, 1, 1, 7, 0)) == at(2024, 1, 2, 7, 0)
    assert schedule.next_cron("0 9 * * *", at(2024, 7, 1, 0, 0)) == at(2024, 7, 1, 6, 0)
    assert schedule.next_cron("*/15 8-9 * * *", at(2024, 1, 1, 6, 10), "UTC") == at(2024, 1, 1, 8, 0)
    assert schedule.next_cron("0 0 13 * 5", at(2024, 1, 1), "UTC") == at(2024, 1, 5)  # the 13th or a Friday
    assert schedule.next_cron("0 0 * * 7", at(2024, 1, 1), "UTC") == at(2024, 1, 7)
    assert schedule.next_cron("30 1 27 10 *", at(2024, 10, 26, 22, 0)) == at(2024, 10, 26, 22, 30)  # first of the doubled hour
    assert schedule.next_cron("30 1 27 10 *", at(2024, 10, 26, 22, 30)) is None or schedule.next_cron("30 1 27 10 *", at(2024, 10, 26, 22, 30)) > at(2025, 1, 1)
    assert schedule.next_cron("30 2 29 3 *", at(2024, 3, 28)) != at(2024, 3, 29, 0, 30)  # skipped by the clock
    assert schedule.next_cron("61 * * * *", at(2024, 1, 1)) is None


@pytest.mark.parametrize("day, expected", [((2024, 10, 3), (1, "Tishri", 5785)), ((2024, 3, 24), (14, "Adar II", 5784)), ((1999, 12, 31), (22, "Tevet", 5760)), ((2025, 3, 14), (14, "Adar", 5785)), ((2023, 9, 16), (1, "Tishri", 5784)), ((1948, 5, 14), (5, "Iyar", 5708))])
def test_hebrew_date(day, expected):
    assert schedule.hebrew_date(dt.date(*day)) == expected


def test_anniversaries(spark):
    rows = [(1, 29, 2, 2000, False, None), (2, 28, 2, None, False, None), (3, 28, 2, 2001, False, "2023-02-28"), (4, 24, 3, 2005, True, None), (5, None, None, None, False, None)]
    got = {r["id"]: r["years"] for r in schedule.anniversaries(spark.createDataFrame(rows, "id int, day int, month int, year int, hebrew boolean, greeted_on string"), "2023-02-28").collect()}
    assert got == {1: 23, 2: None}
    due = schedule.anniversaries(spark.createDataFrame([(4, 25, 3, 2005, True, None)], "id int, day int, month int, year int, hebrew boolean, greeted_on string"), "2024-03-24").collect()
    assert [(r["id"], r["years"]) for r in due] == [(4, 19)]  # 14 Adar II 5765, 14 Adar II 5784


def test_mentions():
    roster = [("1:2@s", "Dan", "111"), ("3@s", "Dan Levi", None), ("4@s", "Noa", "444")]
    assert groups.mentions_in("hi @Dan Levi and @dan!", roster) == ("hi @3 and @1!", ["3@s", "1:2@s"])
    assert groups.mentions_in("@Dana", roster)[1] == []
    assert groups.mentions_in("@444 ok", roster)[1] == ["4@s"]
    assert set(groups.mentions_in("x @all", roster)[1]) == {"1:2@s", "3@s", "4@s"}
    assert groups.mentions_in(None, []) == ("", [])


def test_public_history(spark):
    m = lambda *ms: [{"role": r, "content": c} for r, c in ms]
    rows = [
        ("a", m(("system", "x"), ("assistant", "hello"), ("user", "hi"))), ("b", m(("user", "x" * 4001))), ("c", m(("user", "a"), ("assistant", "b"))), ("d", []), ("e", None), ("f", m(("user", "a"), ("assistant", "y" * 9000), ("user", "z"))),
        ("g", m(*[("user", "q")] * 41)), ("h", m(("user", None))),
    ]
    df = spark.createDataFrame(rows, "id string, messages array<struct<role:string,content:string>>")
    got = {r["id"]: r for r in chats.public_history(df).collect()}
    assert [x["content"] for x in got["a"]["recent"]] == ["hi"]
    assert got["b"]["error"].startswith("A message can be") and got["c"]["error"].startswith("The last") and got["d"]["error"] == got["e"]["error"] == "messages array required"
    assert len(got["f"]["recent"][1]["content"]) == 8000 and len(got["g"]["recent"]) == 20 and got["h"]["error"] == "Message content must be text"


def test_alternate_turns(spark):
    rows = [(1, 0, "assistant", "x"), (1, 1, "user", "hi"), (1, 2, "user", "there"), (1, 3, "assistant", " "), (1, 4, "assistant", "reply")]
    got = chats.alternate_turns(spark.createDataFrame(rows, "k int, pos int, role string, content string"), "k").orderBy("turn").collect()
    assert [(r["role"], r["content"]) for r in got] == [("user", "hi\nthere"), ("assistant", "reply")]


def test_rank_formula(spark):
    units = spark.createDataFrame([("u1", "a", "t", "Hours hours open"), ("u2", "a", "x", "closed"), ("u3", "b", "x", "hours")], "unit_id string, agent_id string, title string, content string")
    queries = spark.createDataFrame([(1, "a", "hours open?")], "query_id int, agent_id string, question string")
    got = {r["unit_id"]: r["rank"] for r in knowledge.search(units, queries, 6, english=False).collect()}
    assert got == {"u1": pytest.approx((0.1 * 1.25 / 1.64493406685 + 0.1 / 1.64493406685) / 2, abs=1e-8)}
    both = {r["unit_id"] for r in knowledge.search(units, queries, 6).collect()}
    assert both == {"u1"}


def test_usage_costs(spark):
    calls = spark.createDataFrame([(1, "m", 1200.0, 80.0, 0.00213), (2, "m", 1000.0, 1000.0, None), (3, "none", 1e6, -5.0, None), (4, "m", None, 0.0, None)], "id int, model string, input_tokens double, output_tokens double, cost double")
    catalog = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_m double, output_per_m double")
    got = {r["id"]: (r["input_tokens"], r["output_tokens"], r["cost_usd"]) for r in money.usage_costs(calls, catalog).collect()}
    assert got == {1: (1200, 80, 0.00213), 2: (1000, 1000, 0.003), 3: (1_000_000, 0, 10.0), 4: (0, 0, None)}


def test_limiter():
    state, refused = (0, None, None), []
    for i in range(12):
        state, r = stateful.limiter_step(state, i * 1_000_000, False, 9, 900, 900)
        refused.append(r)
    assert refused == [False] * 9 + [True] * 3
    state, r = stateful.limiter_step(state, 2000 * 1_000_000, False, 9, 900, 900)
    assert not r and state[0] == 1


def test_loop_detector():
    state, paused = (None, False, 0, None), []
    for i in range(5):
        state, _ = stateful.loop_step(state, i * 60_000_000, True, 5, 4, 1800)
        state, p = stateful.loop_step(state, i * 60_000_000 + 2_000_000, False, 5, 4, 1800)
        paused.append(p)
    assert paused == [False, False, False, True, True]
    state, slow = (None, False, 0, None), []
    for i in range(9):
        state, _ = stateful.loop_step(state, i * 60_000_000, True, 5, 4, 1800)
        state, p = stateful.loop_step(state, i * 60_000_000 + 8_000_000, False, 5, 4, 1800)
        slow.append(p)
    assert not any(slow)


def test_admission(spark):
    p, i = {"scope": "platform", "key": ""}, {"scope": "item", "key": "o:agent:1"}
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    rows = [
        (1, t(0), "ask", 1, "o", [p, i], 0.6, 0.0), (2, t(1), "ask", 2, "o", [p, i], 0.6, 0.0), (3, t(2), "settle", 1, "o", [p, i], 0.0, 0.1), (4, t(3), "ask", 3, "o", [p, i], 0.6, 0.0),
        (5, t(4), "ask", 4, "o", [p], 9.0, 0.0), (6, t(800), "ask", 5, "o", [p, i], 0.6, 0.0),
    ]
    events = spark.createDataFrame(rows, "id long, ts timestamp_ntz, kind string, call long, org_id string, scopes array<struct<scope:string,key:string>>, estimate double, actual double")
    caps = spark.createDataFrame([("item", "o:agent:1", "o", 1.0)], "scope string, key string, org_id string, cap_usd double")
    billing = spark.createDataFrame([("o", 5.0)], "org_id string, balance_usd double")
    got = {r["id"]: r["refusal"] for r in stateful.admit_calls(events, caps, billing).collect()}
    assert got == {1: None, 2: "item", 4: None, 5: "balance", 6: None}
    got = {r["id"]: r["refusal"] for r in stateful.admit_calls(events, caps, billing, platform_cap=0.5).collect()}
    assert set(got.values()) == {"platform"}


def test_replies_are_one_to_one(spark):
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    m = spark.createDataFrame([(1, "n", "p", t(5), "yes"), (2, "n", "p", t(6), None), (3, "n", "p", t(7), None), (4, "n", "q", t(7), None)], "id long, number_id string, phone string, ts timestamp_ntz, answer string")
    w = spark.createDataFrame([(10, "n", "p", "reply", t(0), t(60)), (11, "n", "p", "approval", t(1), t(60)), (12, "n", "p", "reply", t(8), t(60))], "run_id long, number_id string, phone string, kind string, started_at timestamp_ntz, until timestamp_ntz")
    assert {(r["message_id"], r["run_id"]) for r in tables.match_replies(m, w).collect()} == {(1, 11), (2, 10)}


def test_upsert_and_replace(spark):
    cur = spark.createDataFrame([("1", "a", "old"), ("2", "a", "two")], "id string, agent_id string, title string")
    new = spark.createDataFrame([("1", "a", ""), ("2", "b", "stolen"), ("3", "b", "three")], "id string, agent_id string, title string")
    after, conflicts = guarded_upsert(cur, new, "id", ["agent_id"], ["title"])
    assert sorted(map(tuple, after.collect())) == [("1", "a", "old"), ("2", "a", "two"), ("3", "b", "three")]
    assert [r["id"] for r in conflicts.collect()] == ["2"]
    kept = replace_by_key(cur, cur.limit(0), "agent_id")
    assert kept.count() == 2


def test_docx(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    df = spark.createDataFrame([("/x/My file.docx", bytearray(buf.getvalue())), ("/x/b.pdf", bytearray(b"%PDF")), ("/x/c.docx", bytearray(b"junk"))], "path string, content binary")
    got = {r["title"]: (r["text"], bool(r["error"])) for r in docx.docx_text(df).collect()}
    assert got == {"My file": ("Hello\na\tb\na\nb", False), "b": (None, True), "c": (None, True)}


def test_branches_never_move(spark):
    s = spark.createDataFrame([(str(i), "a", i % 2 == 0, "kept" if i % 4 == 0 else None) for i in range(2000)], "id string, agent_id string, decided boolean, branch_id string")
    b = spark.createDataFrame([("b1", "a", "branch", 30, None), ("b2", "a", "draft", 50, None)], "id string, agent_id string, kind string, traffic_weight int, merged_at timestamp_ntz")
    got = experiments.assign_branches(s, b, 3).collect()
    assert all(r["branch_id"] == ("kept" if int(r["id"]) % 4 == 0 else None) for r in got if int(r["id"]) % 2 == 0)
    share = sum(r["branch_id"] == "b1" for r in got if int(r["id"]) % 2) / 1000
    assert 0.25 < share < 0.35
    t = experiments.traffic(b).first()
    assert (t["branches"], t["main"], t["rejected"]) == (30, 70, False)


def test_read_table_types_json(spark, tmp_path):
    spark.createDataFrame([("1", "a", "widget", None, '[{"role":"user","content":"hi"}]', None, None)], "id string, agent_id string, source string, branch_id string, messages string, started_at timestamp, updated_at timestamp").write.parquet(str(tmp_path / "s"))
    row = read_table(spark, "chat_sessions", str(tmp_path / "s")).first()
    assert row["messages"][0]["content"] == "hi"


def test_sabbath_times(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),), (dt.date(2024, 6, 21),)], "day date")
    got = {(r["day"].month, r["city"]): (r["candles"], r["ends"]) for r in schedule.sabbath_times(days).collect()}
    assert len(got) == 10

    def close(text, expected):
        h, m = map(int, text.split(":"))
        return abs(h * 60 + m - expected) <= 4

    assert close(got[1, "jerusalem"][0], 16 * 60 + 8) and close(got[1, "tel-aviv"][0], 16 * 60 + 31) and close(got[6, "jerusalem"][0], 19 * 60 + 8)


def test_independence_day_moves(spark):
    named = lambda day: schedule.calendar_dim(spark, day, day).first()["holidays"]
    assert any("Independence" in x for x in named("2024-05-14")) and not any("Independence" in x for x in named("2024-05-13"))
    assert any("Independence" in x for x in named("2023-04-26"))
    assert named("2024-04-22") == ["Passover begins tonight"]
