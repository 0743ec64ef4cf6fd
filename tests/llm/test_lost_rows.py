"""Rows that earlier versions lost: long labelled texts, texts that share an id, extreme vectors, articles in wrappers."""

from __future__ import annotations

import random

import pytest

from botlake.llm import langid, minhash, pagediff, vectors


def test_long_texts_teach(spark):
    rows = [(0, "ok", "a")] + [(i, f"langer text {i} " * 400, "a") for i in range(1, 200)] + [(i, "kurz und gut", "b") for i in range(200, 230)]
    found = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(found["a"]) == langid.REFERENCE_BYTES and found["a"].startswith(b"ok") and found["b"].startswith(b"kurz")


def test_many_labels_are_no_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, f"words of {lang}", lang) for i, lang in enumerate("aaaabbbbcccdde")]
    assert set(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == set("abc")


def test_texts_that_share_an_id(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    t, u, v = (" ".join(word() for _ in range(60)) for _ in range(3))
    rows = [(5, t), (5, u), (5, t), (7, u + " more"), (9, v), (9, t), (3, None), (3, "  "), (None, t), (20, v + " tail"), (30, "alone in the world of words")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 5, True), (7, 5, False), (9, 5, False), (20, 5, False), (3, 3, True), (None, None, True), (30, 30, True)}


@pytest.mark.parametrize("others", [0, 3])
def test_shared_ids_without_near_copies(spark, others):
    rows = [(1, "one text of its own here"), (1, "another text that differs a lot"), *[(10 + i, f"single text number {i} of the table") for i in range(others)]]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == {(1, 1), *((10 + i, 10 + i) for i in range(others))}


def test_extreme_vectors_link(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.0001e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 5e-324], 1), (5, [1.0, -1.0], 1), (6, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.range_join(df).collect()}
    assert got == {**{i: (4, 1) for i in (1, 2, 3, 4, 6)}, 5: (0, 5)}


def near_pair(rng, n, changed):
    """Two sets of 4-word shingles whose similarity is n - overlap: the second differs in the last words."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    return " ".join(words), " ".join(words[: n - changed] + [f"w{rng.randrange(10**9)}" for _ in range(changed)])


@pytest.mark.parametrize("nodes", [300, minhash.BLOCK + 200])
def test_links_at_the_threshold_in_mixed_nodes(spark, nodes):
    """Pairs of similarity 0.80 to 0.84, among documents that share a long common passage."""
    rng = random.Random(nodes)
    common = " ".join(f"c{i}" for i in range(30))
    rows, want = [], 0
    for i in range(60):
        a, b = near_pair(rng, 170, 19)
        rows += [(2 * i, f"{common} {a}"), (2 * i + 1, f"{common} {b}")]
        sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for _, t in rows[-2:]]
        share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert 0.8 <= share <= 0.84
        want += 1
    rows += [(1000 + i, f"{common} " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(12))) for i in range(nodes)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(60))
    assert found == want


STORY = "<article><p>The story</p></article>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<form id=f><p>field</p>{STORY}</form>", "The story"),
        ('<div class="layout has-sidebar"><main><p>The story</p></main></div>', "The story"),
        ('<body class="menu-open no-ads"><div class="page-with-sidebar">' + STORY + "</div></body>", "The story"),
        ('<div class="sidebar"><main><p>The story</p></main></div>', "The story"),
        (f'{STORY}<section class="comments"><article><p>me first</p></article></section>', "The story"),
        (f"{STORY}<aside><article><p>a teaser</p></article></aside>", "The story"),
        (f'{STORY}<div class="related-posts">{STORY.replace("The story", "Another one")}</div>', "The story"),
        (f'{STORY}<div class="sidebar"><article><p>a teaser</p></article></div>', "The story"),
        (f"<dialog><main><p>accept</p></main></dialog>{STORY}", "The story"),
    ],
)
def test_articles_in_wrappers(spark, page, text):
    assert [t for z, t in pagediff.lines_of(page) if z == "m"] == [text]
    df = spark.createDataFrame([(1, "http://a.b/c", page), (2, "http://a.b/d", "<p>something else</p>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in pagediff.extract(df).collect()}[1] == text


def test_differencing_decides_without_marks(spark):
    """Pages that declare nothing: only what the neighbour shares goes, so this fails without differencing."""
    rng = random.Random(3)
    frame = ["Home of news", "About us", "All rights reserved"]
    own = {i: [" ".join(f"w{rng.randrange(999)}" for _ in range(8)) for _ in range(4)] for i in range(12)}
    rows = [(i, f"http://site.net/news/{i}", "".join(f"<div>{x}</div>" for x in [frame[0], frame[1], *own[i], frame[2]])) for i in own]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("\n\n".join(lines), 3) for i, lines in own.items()}


def test_many_copies_of_a_page(spark):
    copies = [(i, f"http://a.b/x/{i}", f"<p>menu</p>{STORY}") for i in range(5000)]
    got = pagediff.extract(spark.createDataFrame([*copies, (9999, "http://a.b/y", "<p>menu</p><p>own</p>")], "page_id long, url string, html string")).collect()
    assert len(got) == 5001 and {r["text"] for r in got if r["page_id"] < 5000} == {"The story"}
