"""Operators against slow plain statements of the same result."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from botlake.llm import cdc, ctph, langid, minhash, packing, pagediff, queries, sentencepieces, vectors
from botlake.llm.graph import components


class Sets:
    def __init__(self, items):
        self.up = {k: k for k in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def docs_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_cross_parsing_is_greedy_longest_match():
    rng = random.Random(2)
    refs = {x: "".join(rng.choice(x + "abc ") for _ in range(300)) for x in ("xy", "zw")}
    p = langid.CrossParser({k: v.encode().replace(b" ", b"\0") for k, v in refs.items()})
    for n in (1, 5, 200, 1000):
        text = "".join(rng.choice("xyzwabc q") for _ in range(n))
        symbols, ends = langid.normalise(pa.array([text]))
        got = p.phrases(symbols, ends)[0]
        t = symbols.tobytes().replace(b"\0", b" ").decode()
        for k, lang in enumerate(p.langs):
            ref, at, phrases = refs[lang], 0, 0
            while at < len(t):
                size = 1
                while at + size < len(t) and t[at : at + size + 1] in ref:
                    size += 1
                at, phrases = at + size, phrases + 1
            assert got[k] == phrases


def test_language_held_out(spark, sf):
    df = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = df.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_edited_and_next(spark, sf):
    docs = sorted(docs_of(spark, sf).items())
    got = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, sf).collect()}
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ctph.fingerprints(pa.array([t, edited]))
        assert (a, b) == (got[k]["fingerprint"], got[k]["edited_fingerprint"])


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert ctph.common(a, b) == best[len(a)][len(b)]
        lines = pagediff.aligned(list(a), list(b))
        assert len(lines) == best[len(a)][len(b)]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(lines))


def test_viterbi():
    p = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    score = {}

    def walk(node, text):
        for c, to in node.items():
            if c == "":
                score[text] = to[1]
            else:
                walk(to, text + c)

    walk(p.root, "")
    longest = max(map(len, score))
    words = sorted({"▁" + w for w in "the there thereby thereof thé 日本 x😀y ation nationality internationalisation".split()})
    for word, ids in zip(words, p.encode_sorted(words)):
        best = [0.0]
        for e in range(1, len(word) + 1):
            best.append(max([best[e - 1] + p.byte_score * len(word[e - 1].encode())] + [best[s] + score[word[s:e]] for s in range(max(0, e - longest), e) if word[s:e] in score]))
        assert sum(p.byte_score if i in p.bytes else score[p.text[i]] for i in ids) == pytest.approx(best[-1])


def test_round_trips(spark, sf):
    assert all(r["round_trip"] for r in queries.op5_sentencepiece(spark, sf).collect())


def test_chunks_rebuild_texts_and_resist_shifts():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdéfgh") for _ in range(rng.randrange(1, 9))) for _ in range(4000)).encode()

    def chunks(raw):
        data = np.frombuffer(raw, np.uint8)
        rows, a, b = cdc.cut(data, np.array([0, len(data)]))
        return [raw[x:y] for x, y in zip(a, b)]

    plain, moved = chunks(text), chunks(b"an insertion " + text)
    assert b"".join(plain) == text and all(c.decode() for c in plain) and max(map(len, plain)) <= cdc.MAX_CHUNK
    assert len(set(plain) & set(moved)) > 0.98 * len(plain)


def test_passages_go(spark, sf):
    docs = docs_of(spark, sf)
    out = {r["doc_id"]: r for r in cdc.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet")).collect()}

    def grams(texts, n):
        c = collections.Counter()
        for t in texts:
            w = t.split()
            c.update({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
        return c

    before, after = grams(docs.values(), 50), grams((r["text"] for r in out.values()), 50)
    assert sum(v > 1 for v in after.values()) <= 0.01 * sum(v > 1 for v in before.values())
    shared = grams(docs.values(), 12)
    for k, t in docs.items():
        w = t.split()
        if not any(shared[tuple(w[i : i + 12])] > 1 for i in range(len(w) - 11)):
            assert not out[k]["removed"] and out[k]["text"] == t


def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.25


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(docs, n):
    sets = {k: shingles(t, n) for k, t in docs.items()}
    groups = Sets(docs)
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                groups.join(a, b)
    return {k: (len(sets[k]), groups.find(k)) for k in docs}


def test_near_duplicates(spark, sf):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_minhash_near_dedup(spark, sf).collect()}
    assert got == brute_components(docs_of(spark, sf), 4)


def test_near_duplicates_in_hot_groups(spark):
    """A chain, a large group around a base, and many texts with one common passage."""
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(10**6)
    texts, base = [], [word() for _ in range(120)]
    for _ in range(150):
        t = list(base)
        t[rng.randrange(120)] = word()
        texts.append(t)
    passage = [word() for _ in range(40)]
    texts += [[word() for _ in range(60)] + passage for _ in range(150)]
    link = [word() for _ in range(100)]
    for _ in range(12):
        link = link[3:] + [word() for _ in range(3)]
        texts.append(list(link))
    rng.shuffle(texts)
    docs = {i: " ".join(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size=4).collect()}
    assert got == brute_components(docs, 4)


def test_range_join(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(60, 8)) for c in centres]).astype(np.float32)
    labels = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.range_join(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    groups = Sets(range(len(x)))
    for a, b in zip(*np.nonzero(np.triu(near))):
        groups.join(int(a), int(b))
    assert got == {i: (int(near[i].sum()), groups.find(i)) for i in range(len(x))}


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = docs_of(spark, sf)
    rows = queries.op10_packing(spark, sf).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for k, t in docs.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        assert at & (at - 1) == 0  # a power of two: no padding
        short += at < 2048
    assert short <= 11 * spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()


def test_fullest_window():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(8))]
        goal = rng.randrange(0, 30)
        best = max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= goal)
        got = packing.fullest(collections.Counter(sizes), goal)
        assert sum(k * v for k, v in got.items()) == best and all(v <= collections.Counter(sizes)[k] for k, v in got.items())


def test_word_encoder_equals_the_tokenizer():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ["It's 5, a!, b.", "ΑΣ, ΑΣ. x", "İstanbul, <|endoftext|>, A.b", "x_, y", "é, É.  a,\tb . , ,. ..  ,", "日本語、, 中. 12,3. ", "a,.\nb,", "don't. we'll, 'S, ", "", " ", "\n\n,\n", "é É, ", "<|STARTOFTEXT|> x"]:
        assert e([t])[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    groups = Sets({x for e in links for x in e})
    for a, b in links:
        groups.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for a, b in links if a != b for x in (a, b)}


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs_of(spark, sf)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out
        if name == "MinHash near-dedup":
            parts = brute_components(before, 5)
            assert {r["doc_id"] for r in docs.collect()} == {k for k, (_, c) in parts.items() if k == c}
        docs = pipeline.stored(docs, "test")
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert 0 < len(kept) == docs.count() and set(kept) <= set(before)
        before = kept
    assert pipeline.run(spark, sf).select("doc_id").distinct().count() == len(before)
    empty = pipeline.run.__globals__["stored"](spark.read.parquet(f"{sf}/documents.parquet").limit(0), "empty")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_oracle_of_url_filters(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    theirs = sorted(con.sql(queries.oracle_sql()["op4_url_filters"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in queries.op4_url_filters(spark, sf).collect()), key=str) == theirs
    assert F is not None
