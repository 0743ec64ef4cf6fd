"""The stored search index: equal to the plain search, exact under pruning, updated bucket by bucket."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from botlake.operators import knowledge as kb
from botlake.operators import search_index as ix

DOCS = "id string, agent_id string, skill_id string, title string, content string"
WORDS = [f"word{i}" for i in range(40)] + ["running", "runs", "the", "of", "שלום", "naïve", "x1"]


def table(spark, seed, n, agents=3, long=False):
    rng = random.Random(seed)

    def text():
        size = rng.choice([0, 3, 10, 60, 400 if long else 60])
        return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=size)) + ("\n\n" if rng.random() < 0.3 else "")

    rows = [(str(i), None if rng.random() < 0.02 else str(0 if rng.random() < 0.4 else rng.randrange(agents)), rng.choice([None, "1", "2"]), rng.choice([None, f"title {rng.choice(WORDS)}"]), None if rng.random() < 0.05 else text()) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def questions(spark, seed, n, agents=3):
    rng = random.Random(seed)
    rows = [(i, str(rng.randrange(agents + 1)), rng.choice([None, "", "the of", " ".join(rng.choices(WORDS, k=rng.randrange(1, 30)))])) for i in range(n)]
    return spark.createDataFrame(rows, "query_id int, agent_id string, question string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "position", "unit_id", "rank").collect())


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 20)])
def test_search_from_the_index_is_the_plain_search(spark, tmp_path, monkeypatch, seed, k):
    monkeypatch.setattr(ix, "BLOCK", 4)
    monkeypatch.setattr(ix, "SEEDS", 10)
    docs, asked = table(spark, seed, 300, long=True), questions(spark, seed + 10, 25)
    ix.build_index(docs, str(tmp_path / "ix"), buckets=5)
    want = rows_of(kb.search(kb.chunk_units(docs), asked, k))
    assert want and rows_of(ix.search_index(spark, str(tmp_path / "ix"), asked, k)) == want


def test_small_sets_are_not_needed_for_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "SMALL", 0)
    docs, asked = table(spark, 4, 100), questions(spark, 5, 10)
    ix.build_index(docs, str(tmp_path / "ix"), buckets=3)
    assert rows_of(ix.search_index(spark, str(tmp_path / "ix"), asked)) == rows_of(kb.search(kb.chunk_units(docs), asked))


def test_pruning_opens_few_blocks(spark, tmp_path, monkeypatch):
    """A frequent word's blocks stay closed when rarer words decide."""
    docs = spark.createDataFrame([(str(i), "a", None, "t", "common " + ("rare gem stone" if i % 100 == 0 else f"filler{i}")) for i in range(2000)], DOCS)
    ix.build_index(docs, str(tmp_path / "ix"), buckets=2)
    opened = []
    plain = ix.written
    monkeypatch.setattr(ix, "written", lambda df, label: opened.append((label, plain(df, label))) or opened[-1][1])
    asked = spark.createDataFrame([(1, "a", "common rare gem stone")], "query_id int, agent_id string, question string")
    got = rows_of(ix.search_index(spark, str(tmp_path / "ix"), asked, 5))
    assert [r[2] for r in got] == sorted(str(i) for i in range(0, 2000, 100))[:5]
    assert dict(opened)["found"].count() == 20 and dict(opened)["needed"].where("lexeme = 'common'").count() == 0


def test_scope(spark, tmp_path):
    docs, asked = table(spark, 6, 120), questions(spark, 7, 10)
    ix.build_index(docs, str(tmp_path / "ix"), buckets=3)
    scope = F.col("skill_id").isNull() | F.col("skill_id").isin("2")
    want = rows_of(kb.search(kb.chunk_units(docs).where(scope), asked))
    assert rows_of(ix.search_index(spark, str(tmp_path / "ix"), asked, scope=scope)) == want


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_changed_document_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "ix")
    docs = table(spark, 8, 200)
    ix.build_index(docs, path, buckets=20)
    before = files(path)
    changed = spark.createDataFrame([("7", "1", None, "new title", "entirely new words"), ("1000", "2", "1", None, "a new document")], DOCS)
    gone = spark.createDataFrame([("9",), ("nobody",)], "id string")
    touched = ix.update_index(path, changed, gone)
    after = files(path)
    assert 2 <= len(touched) <= 4
    other = lambda names: {k: v for k, v in names.items() if not any(f"bucket={b}/" in k for b in touched)}
    assert other(before) == other(after) and len(other(after)) > 20
    now = docs.where("id not in ('7', '9')").unionByName(changed)
    asked = questions(spark, 9, 20).unionByName(spark.createDataFrame([(100, "1", "entirely new words"), (101, "2", "document")], "query_id int, agent_id string, question string"))
    assert rows_of(ix.search_index(spark, path, asked)) == rows_of(kb.search(kb.chunk_units(now), asked))


def test_emptied_buckets_and_empty_tables(spark, tmp_path):
    path, none = str(tmp_path / "ix"), spark.createDataFrame([], DOCS)
    docs, asked = table(spark, 10, 12), questions(spark, 11, 6)
    ix.build_index(docs, path, buckets=10)
    ix.update_index(path, none, docs.where("id <> '3'").select("id"))
    assert rows_of(ix.search_index(spark, path, asked)) == rows_of(kb.search(kb.chunk_units(docs.where("id = '3'")), asked))
    assert ix.update_index(path, none, spark.createDataFrame([("nobody",)], "id string")) == []
    ix.build_index(none, str(tmp_path / "empty"))
    assert rows_of(ix.search_index(spark, str(tmp_path / "empty"), asked)) == []


def test_postings_are_sorted_a_bounded_number_at_a_time(monkeypatch):
    """Units come as rows, whole; lists are in impact order, cut into blocks, and together hold each posting once."""
    monkeypatch.setattr(ix, "RUN", 40, raising=False)
    monkeypatch.setattr(ix, "BLOCK", 4)
    rng, rows = random.Random(3), []
    for n in range(60):
        own = rng.sample(WORDS, rng.randrange(1, 12))
        rows.append((n // 30, f"a{n // 15}", f"u{n:03}", " ".join(own), [rng.choice([0.1, 0.2, 0.3]) for _ in own]))
    schema = pa.schema([("bucket", pa.int32()), ("agent_id", pa.string()), ("unit_id", pa.string()), ("text", pa.string()), ("scores", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2]), schema.types)], schema=schema) for i in range(0, 60, 2)]
    found = list(ix._blocks(iter(batches)))
    assert len(found) > 3 and all(sum(r["size"] for r in b.to_pylist()) < 40 + 2 * 12 for b in found)
    got = []
    for b in found:
        lists = {}
        for r in b.to_pylist():
            here = lists.setdefault((r["bucket"], r["agent_id"], r["lexeme"]), [])
            assert r["block"] * 4 == len(here) and r["size"] == len(r["units"]) <= 4 and r["top"] == r["units"][0]["score"]
            here += [(-u["score"], u["unit_id"]) for u in r["units"]]
        assert list(lists) == sorted(lists) and all(x == sorted(x) for x in lists.values())
        got += [(*k, u, -s) for k, x in lists.items() for s, u in x]
    assert sorted(got) == sorted((b, a, w, u, s) for b, a, u, text, scores in rows for w, s in zip(text.split(" "), scores))


def test_hits_are_found_once(spark, tmp_path):
    ix.build_index(spark.createDataFrame([("1", "a", None, "t", "some words")], DOCS), str(tmp_path / "ix"), buckets=1)
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    hits = spark.createDataFrame([("1",)], "unit_id string").mapInArrow(seen, "unit_id string")
    assert [r["content"] for r in ix.unit_texts(spark, str(tmp_path / "ix"), hits).collect()] == ["some words"]
    assert runs.value == 1


def test_stems_are_remembered_from_task_to_task():
    from botlake.functions import text as tx

    tx.KNOWN.clear()
    words = pa.array([["running", "the", "nationally"]], pa.list_(pa.string()))
    names = [tx.count_lexemes(words)[0].to_pylist() for _ in range(2)]
    assert names[0] == names[1] and tx.KNOWN == {"running": "run", "nationally": "nation"}


def test_long_words_are_not_remembered():
    """F8: what a worker remembers is bounded in characters, too; the lexemes are the same."""
    from botlake.functions import text as tx

    tx.KNOWN.clear()
    long = "x" * 500 + "ings"
    names, at, lexeme, tf = tx.count_lexemes(pa.array([[long, "running", long], [long]], pa.list_(pa.string())))
    assert {(int(r), names[int(i)].as_py(), int(n)) for r, i, n in zip(at, lexeme, tf)} == {(0, long, 2), (0, tx.stem(long), 2), (0, "running", 1), (0, "run", 1), (1, long, 1), (1, tx.stem(long), 1)}
    assert tx.KNOWN == {"running": "run"}


def test_a_posting_takes_few_bytes_while_it_is_sorted():
    """F8: numpy's peak while 200 000 postings are sorted; postings that a bucket of a task holds at a time are bounded by RUN."""
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(3000)]
    for n in range(1000):
        own = rng.sample(words, 200)
        rows.append((0, f"a{n // 500}", f"u{n:04}", " ".join(own), [rng.choice([0.06, 0.07, 0.08]) for _ in own]))
    schema = pa.schema([("bucket", pa.int32()), ("agent_id", pa.string()), ("unit_id", pa.string()), ("text", pa.string()), ("scores", pa.list_(pa.float64()))])
    units = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    tracemalloc.start()
    try:
        found = ix._run(units)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(found.column("size").to_pylist()) == 200_000
    assert most < 32 * 200_000
