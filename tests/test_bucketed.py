"""Stored tables in buckets: the rows of a plain upsert, and only the touched files rewritten."""

from __future__ import annotations

import random
from pathlib import Path

from botlake.sources import bucketed, tables

SCHEMA = "id string, owner string, title string"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("bucket=*/*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "owner", "title").collect()), key=str)


def test_upserts_rewrite_the_touched_buckets_only(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    stored = spark.createDataFrame([(f"k{i}", rng.choice("ab"), f"title {i}") for i in range(500)] + [(None, "a", "no key")], SCHEMA)
    bucketed.create(stored, path, "id", 40)
    assert rows(bucketed.read(spark, path)) == rows(stored)
    before = files(path)
    incoming = spark.createDataFrame([("k1", "a", ""), ("k2", "b", "new"), ("fresh", "c", "first")], SCHEMA)
    want, clash = tables.guarded_upsert(stored, incoming, "id", ["owner"], keep_nonempty=["title"])
    got = bucketed.upsert(path, incoming, ["owner"], keep_nonempty=["title"])
    assert rows(bucketed.read(spark, path)) == rows(want) and rows(got) == rows(clash)
    after = files(path)
    kept = {f for f in before if after.get(f) == before[f]}
    gone = {f.split("/")[1] for f in set(before) - kept}
    assert 1 <= len(gone) <= 3 and len(kept) >= 36
    assert bucketed.upsert(path, spark.createDataFrame([], SCHEMA), ["owner"]).count() == 0 and files(path) == after


def test_replacing_children_rewrites_their_parents_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    stored = spark.createDataFrame([(f"p{i % 50}", "a", f"child {i}") for i in range(400)], SCHEMA)
    bucketed.create(stored, path, "id", 30)
    before = files(path)
    new, empty = spark.createDataFrame([("p3", "a", "one"), ("p3", "a", "two"), ("p99", "a", "three")], SCHEMA), spark.createDataFrame([("p4",)], "id string")
    numbers = bucketed.replace(path, new, empty)
    assert rows(bucketed.read(spark, path)) == rows(tables.replace_by_key(stored, new, "id", empty))
    after = files(path)
    changed = {f.split("bucket=")[1].split("/")[0] for f in before if after.get(f) != before[f]}
    assert changed <= {str(n) for n in numbers} and len(numbers) <= 3


def test_an_emptied_bucket_loses_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.create(spark.createDataFrame([("a", "x", "1"), ("b", "x", "2")], SCHEMA), path, "id", 8)
    bucketed.replace(path, spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",)], "id string"))
    assert rows(bucketed.read(spark, path)) == [("b", "x", "2")] and len(files(path)) == 1
