"""Operators against independent statements of their rules, and on columns with the names that they use themselves."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from botlake.llm import cdc, ctph, langid, minhash, quality, queries, sentencepieces, vectors
from botlake.llm.columns import span_hashes

from test_brute import Sets, docs_of, shingles

NAMES = ["_k", "_h", "_t", "_i", "_spans", "_source", "_lang", "_size", "k", "h", "t", "row", "spans", "d1", "draw", "y", "n", "kind"]


def with_names(df):
    return df.withColumns({n: F.lit(n) for n in NAMES})


# ---- language ID


def greedy(text, ref):
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in ref:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_don_t_depend_on_blocks():
    rng = random.Random(3)
    refs = {x: bytes(rng.choice(x + b"abc\0") for _ in range(400)) for x in (b"xy", b"zw", b"q")}
    p = langid.CrossParser({k.decode(): v for k, v in refs.items()})
    texts = [bytes(rng.choice(b"abcxyzwq\0s") for _ in range(rng.randrange(300))) for _ in range(30)] + [b"", b"x"]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [[greedy(t, refs[k.encode()]) for k in p.langs] for t in texts]
    for block in (1, 2, 5, 64, 2048):
        assert p.phrases(np.frombuffer(b"".join(texts), np.uint8), ends, block).tolist() == want


def test_predictions_by_definition():
    """The fewest phrases x log2 of the reference's size over the text's size wins, ties by name; one minus best over second is the score."""
    rng = random.Random(4)
    refs = {k: bytes(rng.choice(v) for _ in range(500)) for k, v in (("one", b"abcd\0"), ("two", b"cdef\0"), ("six", b"abcd\0"))}
    refs["tie"] = refs["one"]
    p = langid.CrossParser(refs)
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (3, 40, 5000, 9000)] + [None, "", " 12 !", "ABC d", "日本", "a" * 7000]
    names, scores = p.predict(pa.array(texts))
    for t, name, score in zip(texts, names, scores):
        symbols = langid.normalise(pa.array([t or ""]))[0].tobytes()
        if not any(c.isalpha() for c in t or ""):
            assert (name, score) == ("und", 0.0)
            continue
        cost = sorted((greedy(symbols, refs[k]) * math.log2(len(refs[k])) / max(1, len(symbols)), k) for k in refs)
        assert name == cost[0][1] and score == pytest.approx(1 - cost[0][0] / cost[1][0])


def test_whole_rows_teach(spark):
    """The sample takes texts whole, short ones first, and a language that has only a long text is taught by that."""
    rows = [(i, f"alpha beta gamma {i} omega", "a") for i in range(300)] + [(1000, "zeta " * 9000, "b"), (1001, "eta " * 3000, "a")]
    refs = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert refs["a"].count(b"omega") == refs["a"].count(b"alpha") == langid.REFERENCE_ROWS and b"eta\0" not in refs["a"].replace(b"beta", b"")
    assert len(refs["b"]) <= langid.REFERENCE_BYTES and refs["b"].startswith(b"zeta\0zeta")
    # a noisy label column is no error: the most frequent labels are learned, of equally frequent ones those that sort first
    labels = sorted(map(str, range(langid.MOST_LANGUAGES + 1)))
    many = spark.createDataFrame([(i, "text", label) for i, label in enumerate([*labels, labels[-1]])], "doc_id long, text string, lang string")
    assert set(langid.fit(many)) == {*labels[: langid.MOST_LANGUAGES - 1], labels[-1]}


# ---- vectors


def brute_links(rows, cosine=0.98):
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([y for _, _, y in rows])
    near = (x @ x.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    groups = Sets(range(len(rows)))
    for a, b in zip(*np.nonzero(np.triu(near))):
        groups.join(int(a), int(b))
    least = collections.defaultdict(list)
    for i in range(len(rows)):
        least[groups.find(i)].append(rows[i][0])
    return collections.Counter((rows[i][0], int(near[i].sum()), min(least[groups.find(i)])) for i in range(len(rows)))


def test_levels_of_pivots(spark, monkeypatch):
    """Small cells force several levels, a dense heap stays whole, and repeated ids keep their own links."""
    monkeypatch.setattr(vectors, "CELL", 20)
    monkeypatch.setattr(vectors, "LARGE", 60)
    monkeypatch.setattr(vectors, "PIVOTS", 8)
    rng = np.random.default_rng(6)
    spread = rng.normal(size=(700, 5))
    close = np.repeat(rng.normal(size=(90, 5)), 5, axis=0) + rng.normal(scale=0.1, size=(450, 5))
    heap = np.array([5.0, 1, 0, 0, 0]) + rng.normal(scale=0.05, size=(250, 5))
    x = np.concatenate([spread, close, heap]).round(6)
    x[10] = x[11]
    labels = [int(i) for i in rng.integers(0, 2, len(x))]
    labels[10] = labels[11]
    rows = [(int(i % 1300), v.tolist(), y) for i, (v, y) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.range_join(df).collect())
    assert got == brute_links(rows)


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.range_join(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_long_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3000))
    x[30:] = x[:30] + rng.normal(scale=0.05, size=(30, 3000))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == brute_links(rows)


# ---- fingerprints: a plain byte-by-byte statement


def slow_fingerprint(text):
    raw = text.encode()
    k = 0
    while (1 << k) * 64 < len(raw):
        k += 1
    short = len(raw) <= ctph.SHORT
    least = 0 if short else 1
    k = max(k, least)
    level = []
    for i in range(len(raw)):
        h = 0
        for age in range(7):
            if i - age >= 0:
                h = (h + raw[i - age] * pow(0x9E3779B1, age + 1, 1 << 32)) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        level.append(32 if h == 0 else (h & -h).bit_length())  # one more than the zero bits at its end

    def letters(k):
        out, at, cuts = "", 0, 0
        for i in range(len(raw)):
            if (level[i] > k) and cuts < 63:
                out, at, cuts = out + letter(raw[at : i + 1]), i + 1, cuts + 1
        return out + (letter(raw[at:]) if at < len(raw) else "")

    while k > least and sum(x > k for x in level) < 31:
        k -= 1
    return f"{1 << k}:{letters(k)}:{letters(k + 1)}"


def letter(chunk):
    data = np.frombuffer(chunk, np.uint8)
    return chr(ctph.LETTERS[int(span_hashes(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(58))])


def slow_likeness(x, y):
    (p, a, b), (q, c, d) = (f.split(":") for f in (x, y))
    if x == y:
        return 1.0
    best = 0.0
    for size, s in ((int(p), a), (2 * int(p), b)):
        for other, t in ((int(q), c), (2 * int(q), d)):
            if size == other and s and t:
                if s == t:
                    return 1.0
                run = min(5, -(-min(len(s), len(t)) // 2))
                if {s[i : i + run] for i in range(len(s) - run + 1)} & {t[i : i + run] for i in range(len(t) - run + 1)}:
                    row = list(range(len(t) + 1))  # edit distance, a replacement being a removal and an insertion
                    for i, m in enumerate(s):
                        corner, row[0] = row[0], i + 1
                        for j, n in enumerate(t):
                            corner, row[j + 1] = row[j + 1], corner if m == n else min(row[j + 1], row[j]) + 1
                    best = max(best, 1 - row[-1] / (len(s) + len(t)))
    return best


def test_fingerprints_byte_by_byte(spark, sf):
    docs = sorted(docs_of(spark, sf).items())
    got = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, sf).collect()}
    prints = [slow_fingerprint(t[:20000]) if len(t) <= 20000 else got[k]["fingerprint"] for k, t in docs]
    for i, (k, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert got[k]["fingerprint"] == prints[i]
        if len(edited) <= 20000:
            assert got[k]["edited_fingerprint"] == slow_fingerprint(edited)
        assert got[k]["near_edited"] == pytest.approx(slow_likeness(prints[i], got[k]["edited_fingerprint"]))
        assert got[k]["near_next"] == pytest.approx(slow_likeness(prints[i], prints[(i + 1) % len(docs)]))


def test_likeness_across_the_short_size():
    """Texts on both sides of SHORT bytes have block sizes that are alike or one twice the other."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(ctph.SHORT + 1))
    prints = ctph.fingerprints(pa.array([text[:-1], text]))
    assert ctph.likeness(*prints) > 0.8


# ---- substring dedup: chunks byte by byte, owners in a dictionary


def slow_chunks(raw):
    table = np.random.default_rng(1711).integers(0, 2**32, 256, dtype=np.uint64).tolist()
    ends, h, last = [], 0, 0
    for i, b in enumerate(raw):
        h = (h << 1) + table[b] & 0xFFFFFFFF
        inside = i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80
        hit = not inside and ((b in b" \t\n\v\f\r" and h & 0x300 == 0) or h & 0xFF00 == 0)
        if hit or i + 1 == len(raw):
            while i + 1 - last > cdc.MAX_CHUNK:
                last += cdc.MAX_CHUNK
                while raw[last] & 0xC0 == 0x80:
                    last -= 1
                ends.append(last)
            if i + 1 - last >= cdc.MIN_CHUNK or (i + 1 == len(raw) and i + 1 > last):
                ends.append(i + 1)
                last = i + 1
    return list(zip([0, *ends], ends))


def slow_dedup(docs):
    owners = {}
    for k in sorted(docs):
        raw = docs[k].encode()
        for a, b in slow_chunks(raw):
            owners.setdefault(raw[a:b], k)
    out = {}
    for k, t in docs.items():
        raw = t.encode()
        gone = [(a, b) for a, b in slow_chunks(raw) if owners[raw[a:b]] < k]
        runs = []
        for a, b in gone:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        kept, at = b"", 0
        for a, b in runs:
            if b - a >= cdc.MIN_PASSAGE:
                kept, at = kept + raw[at:a], b
        out[k] = (kept + raw[at:]).decode()
    return out


def test_substring_dedup_byte_by_byte(spark, sf):
    docs = {k: t for k, t in docs_of(spark, sf).items() if len(t) < 30000}
    extra = {10**6 + i: ("x" * 700 + t + "日本" * 400) for i, t in enumerate(list(docs.values())[:20])}
    docs |= extra
    got = {r["doc_id"]: r["text"] for r in cdc.dedup_substrings(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == slow_dedup(docs)


def test_digest_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(2)
    one, two = (rng.integers(-(2**63), 2**63 - 1, 4000) for _ in range(2))
    table = cdc.digest_filter(spark.createDataFrame([(int(a), int(b), 1) for a, b in zip(one[:2000], two[:2000])], "d1 long, d2 long, first long"))
    passed = cdc.may_hold(table, one.view(np.uint64), two.view(np.uint64))
    assert passed[:2000].all() and passed[2000:].mean() < 0.05


# ---- quality: labels that the model never saw


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    model = quality.fit(docs, labels.where(~held))
    rows = quality.score(docs, model).join(labels.where(held), "doc_id").collect()
    good, bad = ([r["quality_score"] >= 0.5 for r in rows if r["quality"] == y] for y in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.3


def test_quality_ties_and_repeats(spark):
    """Equal rows score alike, whatever their order; contradicting labels count as the smaller one."""
    rows = [(i % 40, "good plain words of text " * 3 if i % 2 else "#### $$$$ %%%% ", "en", "s", 10) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (3, 1)], "doc_id long, quality int")
    got = collections.defaultdict(set)
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        got[r["text"]].add(round(r["quality_score"], 9))
    assert all(len(v) == 1 for v in got.values())


# ---- names


def test_any_column_names(spark, sf):
    docs = with_names(spark.read.parquet(f"{sf}/documents.parquet").limit(20))
    model = public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for out in (cdc.dedup_substrings(docs), sentencepieces.decode(sentencepieces.encode(docs, model).drop("text"), model), quality.score(docs, quality.fit(docs, labels)), langid.predict(docs, langid.fit(docs))):
        rows = out.collect()
        assert len(rows) == 20 and all(r[n] == n for r in rows for n in NAMES)


# ---- near-duplicates: recall by node size


def planted(rng, n, common, own, pairs):
    """n texts of a common passage and own words, some of them near copies of the one before."""
    word = lambda: "w%d" % rng.randrange(10**7)
    passage = [word() for _ in range(common)]
    texts = []
    for i in range(n):
        if i % 10 == 9 and pairs:
            t = list(texts[-1])
            t[common + 3] = word()
            texts.append(t)
        else:
            texts.append(passage + [word() for _ in range(own)])
    return texts


@pytest.mark.parametrize("n, common, own", [(20, 60, 40), (300, 60, 40), (1500, 90, 40)])
def test_recall_in_mixed_nodes(spark, n, common, own):
    """Nodes of small, medium and large size that hold many documents which don't link: no planted link is missed, none is made up."""
    rng = random.Random(n)
    texts = planted(rng, n, common, own, True)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, size=5).collect()}
    want = {}
    for i, t in enumerate(texts):
        twin = i % 10 == 9
        if twin:
            a, b = shingles(" ".join(t), 5), shingles(" ".join(texts[i - 1]), 5)
            assert 100 * len(a & b) >= 80 * len(a | b)
        want[i] = i - 1 if twin else i
    found = sum(got[i] == want[i] for i in want if want[i] != i) / max(1, sum(want[i] != i for i in want))
    assert found >= 0.99 and all(got[i] == i for i in want if want[i] == i)


# ---- the pipeline's stages on odd tables


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    long = "the quick brown fox and other words of the house " * 3000
    good = "the house stands on the hill and the river runs by it to the sea where ships lie"
    rows = [(1, good, "en", "s", 80), (1, good, "en", "s", 80), (1, "quite another text that has nothing in common with what was said before at all", "en", "s", 70), (2, None, "en", None, None), (3, "", None, "s", 0), (4, " \n ", "en", "s", 3), (None, good, "en", "s", 80), (5, long, "en", "s", len(long)), (6, good, None, "t", 80), (7, "das Haus steht auf dem Hügel und der Fluss fließt daran vorbei zum Meer", "de", "s", 70)]
    docs = with_names(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    names = pipeline.COLUMNS
    by_name = dict(pipeline.STAGES)
    one = by_name["language ID"](spark, docs, str(tmp_path))
    assert one.columns == names and not {2, 3, 4} & {r["doc_id"] for r in one.collect()}
    two = by_name["quality classifier"](spark, docs, str(tmp_path))
    assert two.columns == names and two.count() == len(rows)
    three = by_name["MinHash near-dedup"](spark, docs, str(tmp_path))
    kept = collections.Counter(r["doc_id"] for r in three.collect())
    assert three.columns == names and kept == {1: 2, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 7: 1}
    four = by_name["substring dedup"](spark, docs, str(tmp_path))
    assert four.columns == names and {r["doc_id"] for r in four.collect()} >= {1, 2, 3, 4, None, 5, 7}
    five = collections.Counter()
    for r in by_name["packing"](spark, docs, str(tmp_path)).collect():
        five[r["doc_id"]] += r["length"]
    assert five[2] == five[3] == 1 and five[5] > 2048 and sum(five.values()) > 0
