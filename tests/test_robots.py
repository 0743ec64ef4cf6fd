"""Robots rules by one walk of a site's trie against the join with every rule."""

from __future__ import annotations

import random
import time

import pytest

from botlake.functions.robots import SiteRules
from botlake.operators import crawl

RULES = "site string, position int, allow boolean, path string"


@pytest.mark.parametrize("seed", [1, 2])
def test_the_trie_decides_as_the_join(spark, monkeypatch, seed):
    rng = random.Random(seed)
    bit = lambda: "".join(rng.choices("/ab.?+(*$", [4, 3, 3, 1, 1, 1, 1, 2, 0.5], k=rng.randrange(1, 6)))
    site = lambda: "hot" if rng.random() < 0.34 else f"s{rng.randrange(4)}"
    rules = [(site(), i, rng.choice([True, False]), rng.choice(["/", ""]) + bit()) for i in range(60)] + [("hot", 99, None, "http://x/map.xml"), (None, 1, False, "/")]
    urls = [(i, site() if i else None, "/" + bit().replace("*", "b") if i % 50 else None) for i in range(400)]
    urls, rules = spark.createDataFrame(urls, "id int, site string, path string"), spark.createDataFrame(rules, RULES)
    got = crawl.robots_allowed(urls, rules)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["allowed"] for r in got.collect()}
    monkeypatch.setattr(crawl, "MOST_RULES", 0)
    assert got == {r["id"]: r["allowed"] for r in crawl.robots_allowed(urls, rules).collect()} and set(got.values()) == {True, False}


def test_ten_thousand_rules_on_one_site():
    site = SiteRules([(i, i % 2 == 0, f"/dir{i}/*/end{i % 7}$") for i in range(10_000)] + [(10_000, False, "/dir")])
    began = time.time()
    for i in range(0, 10_000, 10):
        assert site.allowed(f"/dir{i}/some/page/end{i % 7}") and not site.allowed(f"/dir{i}/some/page/end{i % 7}/more")
    assert site.allowed("/other") and time.time() - began < 5
