"""Page differencing decides outside the main element, aligns exactly at every size and sees past copies."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pandas as pd

from botlake.llm import pagediff

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pagediff.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_differencing_decides_outside_the_main_element(spark):
    page = "<p>Site name</p><h1>Headline {0}</h1><p>Lead {0}</p><article><p>Shared story</p><p>Story {0}</p></article><p>All rights</p>"
    got = texts(spark, [(i, f"http://a.b/x/{i}", page.format(i)) for i in (1, 2)])
    assert got == {i: f"Headline {i}\n\nLead {i}\n\nShared story\n\nStory {i}" for i in (1, 2)}


def test_long_lists_align_exactly():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b):
                diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(5)
    for kinds in (2, 3, 40):
        a, b = ([f"line {rng.randrange(kinds)}" for _ in range(n)] for n in (1700, 1500))
        got = sorted(pagediff.aligned(a, b))
        rest = iter(b)
        assert len(got) == length(a, b) and all(a[i] in rest for i in got)


def test_copies_meet_the_next_other_page(spark):
    copy = "<p>menu</p><p>own one</p>"
    got = texts(spark, [(1, "http://a.b/x/1", copy), (2, "http://a.b/x/2", copy), (3, "http://a.b/x/3", copy), (4, "http://a.b/x/4", "<p>menu</p><p>own two</p>"), (5, "http://c.d/1", copy), (6, "http://c.d/2", copy)])
    assert got == {1: "own one", 2: "own one", 3: "own one", 4: "own two", 5: "menu\n\nown one", 6: "menu\n\nown one"}


def random_site(seed, n=60, same_urls=False):
    """Pages of a few hosts: common lines around own ones, with copies, repeated rows, empty pages and pages without a URL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = rng.choice(["a.b", "a.b", "a.b", "c.d", "e.f"])
        frame = "<p>menu %s</p><p>terms</p>" % host
        own = "".join(f"<p>line {rng.randrange(6)}</p>" for _ in range(rng.randrange(4)))
        body = rng.choice([frame + own + "<div>foot</div>", frame + "<article>" + own + "</article>", "", frame + "<nav>x</nav>", frame + "<p>copy</p>"])
        path = rng.randrange(4) if same_urls else i
        rows.append((i, None if rng.random() < 0.05 else f"http://{host}/s{rng.randrange(3)}/{path}", body))
        if rng.random() < 0.3:
            rows += [rows[-1]] * rng.randrange(1, 4)
    return rows


def brute_texts(rows):
    """The rule over one sorted list: neighbours by a plain search in both directions."""
    pages = []
    for key, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = rest.split("/", 1)[0].lower(), "/" + rest.split("/", 1)[1] if "/" in rest else ""
        lines = pagediff.lines_of(html)
        pages.append(((host, path, url or "", key, pagediff.digest_of(lines)), host, path, url, key, lines, [t for z, t in lines if z != "f"]))
    pages.sort(key=lambda p: p[0])
    pages = [p for p in pages if p[6]] + [p for p in pages if not p[6]]
    full = [p for p in pages if p[6]]
    out = []
    for at, p in enumerate(full):
        before = next((q for q in reversed(full[:at]) if (q[1], q[6]) != (p[1], p[6])), None)
        after = next((q for q in full[at + 1 :] if (q[1], q[6]) != (p[1], p[6])), None)
        copies = [full[j] for j in (at - 1, at + 1) if 0 <= j < len(full) and (full[j][1], full[j][6]) == (p[1], p[6])]
        near = [q for q in (before, after) if q and q[1] == p[1] and (q[3] is None or q[3] != p[3])]
        other = max(near, key=lambda q: pagediff.kinship(q[2], p[2])) if near else None
        if not near and copies and any(z == "m" for z, _ in p[5]):
            other = p
        out.append((p[4], p[3], pagediff.main_text(p[5], other[5] if other else None)[0]))
    return sorted(out + [(p[4], p[3], "") for p in pages if not p[6]], key=str)


def test_every_number_of_ranges_gives_the_rule(spark):
    for seed, same_urls in ((1, False), (2, False), (3, True), (4, True)):
        rows = random_site(seed, same_urls=same_urls)
        want = brute_texts(rows)
        for partitions in (1, 3, 40):
            found = pagediff.extract(spark.createDataFrame(rows, SCHEMA), partitions=partitions).collect()
            assert sorted(((r["page_id"], r["url"], r["text"]) for r in found), key=str) == want, (seed, partitions)


class Blocks(HTMLParser):
    """The blocks of the article element by the standard library's parser."""

    BREAKS = {"article", "p", "h1", "h2", "div", "ul", "li"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_whole_pages_table(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    want = {}
    for key, html in zip(pages["page_id"], pages["html"]):
        parser = Blocks()
        parser.feed(html)
        parser.close()
        want[key] = "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.split())
    got = {r["page_id"]: r for r in pagediff.op6_html_extraction(spark, sf).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_long_pages_and_versions_of_one_url(spark):
    lines = "".join(f"<p>row {i % 700}</p>" for i in range(3000))
    long = "<p>menu</p>" + lines
    got = texts(spark, [(1, "http://a.b/1", long), (2, "http://a.b/2", "<p>menu</p><p>own</p>"), (3, "http://c.d/x", "<p>m</p><p>old</p>"), (4, "http://c.d/x", "<p>m</p><p>new</p>"), (5, "no url", None)])
    assert got[1] == "\n\n".join(f"row {i % 700}" for i in range(3000)) and got[2] == "own"
    assert got[3] == "m\n\nold" and got[4] == "m\n\nnew"  # a version of the same page is no neighbour
    assert got[5] == ""
