"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from botlake.llm import cdc, ctph, langid, minhash, packing, pagediff, quality, sentencepieces, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, k string, quality_score double, ids string"
LONG = "the quick brown fox and other words " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "the house is on the hill and the river runs by it", "en", "s", 50), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "   \n\t ", "en", "s", 6), (5, "12 34 !!", "en", "s", 8),
        (6, "das Haus steht auf dem Hügel und der Fluss fließt vorbei", "de", "s", 55), (6, "das Haus steht auf dem Hügel und der Fluss fließt vorbei", "de", "s", 55), (None, "the lost row of the table is here", "en", "s", 30),
        (7, LONG, "en", "s", len(LONG)), (8, "日本語の文章です。▁ 😀 <|endoftext|> It's", None, "s", 20), (9, "one", "en", "s", 3),
    ]
    return spark.createDataFrame([(*r, 9.0, "x", "y", 7.0, "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_language(spark, odd, none):
    refs = langid.fit(odd)
    assert set(refs) == {"de", "en"}
    out = langid.predict(odd, refs)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[2] == got[3] == got[4] == got[5] == [("und", 0.0)]
    assert got[1][0][0] == got[7][0][0] == got[None][0][0] == "en" and len(got[6]) == 2 and got[6][0][0] == "de"
    assert all(0 <= s <= 1 for v in got.values() for _, s in v)
    assert langid.predict(none, refs).count() == 0 and langid.fit(none) == {}
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


def test_fingerprints(spark, odd, none):
    rows = ctph.compare_with_next(odd, 3).collect()
    assert len(rows) == 11 and ctph.compare_with_next(none, 3).count() == 0
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == "1::" and got[2]["n_chars"] == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 6}) == 1
    single = ctph.compare_with_next(odd.where("doc_id = 1"), 4).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.NET/en/x?y", "h"), (2, None, None), (3, "no scheme", "z"), (4, "http://net/", ""), (5, "http://xnet/", ""), (6, "http://example.net", ""), (7, "http://example.com/de/../#", ""), (8, "http://u@B.org/fr/?", ""), (1, "HTTP://A.Example.NET/en/x?y", "h"), (9, "http://" + "a." * 3000 + "net/" + "p" * 9000, "")],
        "page_id long, url string, host string",
    )
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    got = [(r["page_id"], r["host"][:20], r["path"][:10], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).orderBy("page_id").collect()]
    assert got[:2] == [(1, "a.example.net", "/en/x", "example.net/en/", "allow")] * 2
    assert got[2] == (2, "", "", None, "allow") and got[3] == (3, "", "", None, "allow") and got[4][3:] == ("net/", "block") and got[5][3:] == (None, "allow") and got[6][3:] == (None, "allow")
    assert got[7][3:] == ("example.com/de/", "block") and got[8][3:] == ("org/fr/", "allow") and got[9][3:] == ("net/", "block")
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_sentencepieces(spark, odd, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    enc = sentencepieces.encode(odd, model)
    back = sentencepieces.decode(enc.withColumn("was", F.col("text")), model)
    assert all(r["text"] == r["was"] for r in back.collect()) and back.count() == 11
    assert sentencepieces.encode(none, model).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b/x/1", "<p>menu</p><p>own one</p>"), (2, "http://a.b/x/2", "<p>menu</p><p>own two</p>"), (3, None, None), (4, "http://c.d/", ""), (5, "http://c.d/e", "<main>kept</main>rest"), (5, "http://c.d/e", "<main>kept</main>rest")], "page_id long, url string, html string"
    )
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pagediff.extract(pages.withColumn("text", F.lit(1))).orderBy("page_id").collect()]
    assert got == [(1, "own one", 7), (2, "own two", 7), (3, "", 0), (4, "", 0), (5, "kept", 4), (5, "kept", 4)]
    assert pagediff.extract(pages.limit(0)).count() == 0


def test_substrings(spark, odd, none):
    passage = " ".join(f"word{i}" for i in range(60))
    more = spark.createDataFrame([(20, "start here. " + passage + " and an end."), (21, passage + " another end"), (22, "lead in " + passage)], "doc_id long, text string")
    both = odd.unionByName(more, allowMissingColumns=True)
    out = cdc.dedup_substrings(both)
    assert out.columns == [c for c in odd.columns if c != "removed"] + ["removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[2][0]["text"] is None and got[3][0]["text"] == "" and not got[20][0]["removed"] and not got[7][0]["removed"]
    assert len(got[6]) == 2 and not any(r["removed"] for r in got[6]) and not got[None][0]["removed"]
    assert len(got[21][0]["text"]) < 0.5 * len(passage) and len(got[22][0]["text"]) < 0.5 * len(passage)
    assert cdc.dedup_substrings(none).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 1), (5, 0), (4, 0), (9, 0), (7, 1), (None, 0), (1, None), (3, 2)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = quality.score(odd, model)
    assert out.columns == [c for c in odd.columns if c != "quality_score"] + ["quality_score"]
    rows = out.collect()
    assert len(rows) == 11 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.fit(none, labels) is None and quality.fit(odd, labels.limit(0)) is None and quality.fit(odd, labels.where("quality = 1")) is None
    assert {r["quality_score"] for r in quality.score(odd, None).collect()} == {None}
    assert quality.score(none, model).count() == 0


def test_minhash(spark, odd, none):
    rows = minhash.near_duplicates(odd, size=4).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[9] == [(1, 9, True)] and len(got[6]) == 2
    assert got[None][0][1:] == (None, True)
    assert minhash.near_duplicates(none).count() == 0


def test_packing(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1} and len([r for r in rows if r["doc_id"] == 6]) >= 2
    assert packing.pack_documents(none, path).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, nan], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 1.0], 1), (13, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.range_join(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False) and got[None] == (0, None, True)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 10, 11, 12, 13))
    assert vectors.range_join(df.limit(0)).count() == 0
