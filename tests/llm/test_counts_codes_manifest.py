"""Token counts, vector codes and the Merkle manifest against plain statements."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from botlake.llm import codes, manifest, queries, tokencounts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "aaaa", "Zq", "0", "123", "'re", "'s", "'", "!!", " ", "  ", "   ", "\n", "\t", " ", "　", "é", "漢字", "🎉", "<|endoftext|>", "<|endof", "text|>", "the", " and", "\x1c", "\x85", "é"]


def odd_text(rng: random.Random, n: int) -> str:
    out = ""
    while len(out) < n:
        out += rng.choice(BITS) * rng.choice([1, 1, 1, 1, 2, 5, 40])
    return out


def plain_counts(texts):
    return [len(e.ids) for e in tokencounts.encoder(VOCABULARY).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_by_parts_are_the_librarys():
    rng = random.Random(1)
    texts = [odd_text(rng, rng.choice([0, 1, 3, 10, 50])) for _ in range(6000)]
    assert tokencounts.encoder(VOCABULARY).counts(texts) == plain_counts(texts)


def test_pairs_that_fit_make_whole_encodings():
    """The ground of the proof: what splices inside of a run is the run's own encoding."""
    rng, e = random.Random(2), tokencounts.encoder(VOCABULARY)
    for _ in range(400):
        run = "".join(rng.choice("abcdeghinorst") for _ in range(rng.randrange(40, 120)))
        at = rng.randrange(10, len(run) - 10)
        a, b = (e.tokenizer.encode(x).ids for x in (run[:at], run[at:]))
        assert e.fit(a[-1], b[0]) == (a + b == e.tokenizer.encode(run).ids)


@pytest.mark.parametrize("chunk, overlap", [(200, 100), (5000, 300)])
def test_huge_texts_are_spliced(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = [odd_text(rng, n) for n in (1, 150, 900, 3000, 20000)] + ["a" * 30000, "漢" * 3000, " " * 4000 + "x", "x" + "\n" * 3000, "", None, "same words " * 900, "same words " * 900, "".join(rng.choice("etaoin") for _ in range(9000))]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, body string, n_tokens int").repartition(3)
    got = tokencounts.count_tokens(df, VOCABULARY, "id", "body", limit=100, chunk=chunk, overlap=overlap).collect()
    want = {(i, len((t or "").encode()), n, n > 100) for (i, t, _), n in zip(rows, plain_counts(texts), strict=True)}
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_chunks_of_one_text_lie_in_many_tasks(spark):
    text = "one sentence after the other, " * 4000
    cut = spark.createDataFrame([(1, bytearray(text.encode()))], "row long, body binary").mapInArrow(tokencounts._cut(2000, 200), tokencounts.PIECES).repartition(4, "row", "k")
    assert len({r[0] for r in cut.rdd.mapPartitionsWithIndex(lambda i, rows: [(i,) for _ in rows]).collect()}) == 4


def test_token_counts_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d["doc_id"], len((d["text"] or "").encode()), n, n > 1024) for d, n in zip(docs, plain_counts([d["text"] for d in docs]), strict=True)}
    assert {tuple(r) for r in queries.op11_token_counts(spark, sf).collect()} == want
    assert tokencounts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) in row order and the codebooks, all distances evaluated, in Python integers."""
    kept = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1]) // parts
    book = [[x[p * n : p * n + n] for _, x, _ in kept[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x, _ in kept:
                part = x[p * n : p * n + n]
                groups.setdefault(near(p, part)[1], []).append(part)
            for k, g in groups.items():
                book[p][k] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for i, x, label in kept:
        found = [near(p, x[p * n : p * n + n]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for *_, e, label in out:
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


def test_codes_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60) if rng.random() < 0.9 else None, [rng.choice([-1.0, 0.0, 0.25, 1e-9, -0.003, 700.0]) for _ in range(32)], rng.choice([None, 1, 2])) for _ in range(300)]
    rows += [(1, rows[0][1], 1)] * 100  # a group of copies
    rows += [(2, None, 1), (3, [None] + [1.0] * 31, 2), (4, [float("nan")] * 32, 1), (5, [float("inf")] + [0.0] * 31, None)]
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = codes.compress(df, entries=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, entries=20)


def test_codes_of_few_short_and_extreme_vectors(spark):
    assert codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    df = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0], 1), (3, [], None), (4, [1e300] * 40, 2)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in codes.compress(df).collect()}
    assert set(got) == {1, 2, 3, 4} and all(len(r["code"]) == 32 and r["error"] == 0 for r in got.values())


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-200, 200, (64, 4))
    x = np.concatenate([rng.integers(-200, 200, (2000, 4)), entries, np.repeat(entries[:1], 50, 0)])
    pivots = codes.pivots_of(entries[None], 4)[0]
    code, best, evaluated = codes.nearest(x, codes.squares(x, pivots), pivots, entries)
    plain = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert (best == plain.min(1)).all() and (code == plain.argmin(1)).all() and evaluated < plain.size / 3


def test_codes_of_the_tables(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_vector_codes(spark, sf).collect()), key=str) == plain_codes(rows)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Levels of a tree from its leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, k):
    out = []
    for nodes in levels[:-1]:
        lo = k // 3 * 3
        out.append((nodes[lo:k], nodes[k + 1 : lo + 3]))
        k //= 3
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([d for _, d in groups[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for k, (r, d) in enumerate(groups[s]):
            steps = path(trees[s], k) + path(top, g)
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = (*r[:4], r[4].replace("\n", ""))
            acc = leaf(seen)
            for left, right in steps:
                acc = h(*left, acc, *right)
            out.append((r[0], d, trees[s][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


COLS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 1, 1, 1], [81], [82, 1, 2], [243, 244, 7], [800, 1, 90, 3, 3]])
def test_manifest_of_trees_of_all_sizes(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    sources = [None, "", "b", "é", "Z"]
    rows = [(rng.randrange(10**6), sources[g], rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "plain", "é\n\n漢"])) for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, 1, "x") for r in rows], f"{COLS}, leaf int, tree string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "a", None, None, f"t\n{i % 3}") for i in range(200)] + [(7, "a", "en", 1, "same\n")] * 150 + [(7, None, "en", 1, "other")] * 5 + [(2, "a", None, None, None)]
    spark.createDataFrame(rows, COLS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLS).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_manifest_of_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, sf).collect()), key=str) == plain_manifest(rows)
