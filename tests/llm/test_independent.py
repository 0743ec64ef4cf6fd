"""SentencePiece paths and co-training restated without the operators' own code."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from botlake.llm import quality, sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def scores():
    """Score by piece and of one byte, straight from the model's file: the log of a Zipf law over the rank of the ordinary pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    total = sum(1 / r for r in range(1, len(plain) + 1))
    return m, {p: -math.log(r * total) for r, p in enumerate(plain, 1)}, -math.log(len(plain) * total) - 10.0


def best_score(word, score, byte, longest):
    best = [0.0]
    for e in range(1, len(word) + 1):
        found = best[e - 1] + byte * len(word[e - 1].encode())
        for s in range(max(0, e - longest), e):
            if word[s:e] in score:
                found = max(found, best[s] + score[word[s:e]])
        best.append(found)
    return best[-1]


def test_every_text_gets_its_best_path(spark):
    m, score, byte = scores()
    longest, rng = max(map(len, score)), random.Random(4)
    alphabet = ["e", "t", "a", "in", "ing", "the", "tion", "ß", "é", "日", "本", "😀", "-", "7", "\n", "\t"]
    texts = ["", "a", " ", "  two  blanks ", "x" * 5000, "".join(rng.choices(alphabet, k=5000)), "日本" * 2500]
    texts += [" ".join("".join(rng.choices(alphabet, k=rng.randrange(0, 14))) for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    got = sentencepieces.encode(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), MODEL).collect()
    assert len(got) == len(texts)
    for r in got:
        pieces = [m.id_to_piece(i) for i in r["ids"]]
        total = sum(byte if m.is_byte(i) else score[p] for i, p in zip(r["ids"], pieces))
        spelt = b"".join(bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.encode() for i, p in zip(r["ids"], pieces)).decode()
        assert spelt == "▁" + texts[r["n"]].replace(" ", "▁")
        words = ["▁" + w for w in texts[r["n"]].split(" ")]
        assert total == pytest.approx(sum(best_score(w, score, byte, longest) for w in words), rel=1e-9)


def table(n):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.5
        words = ["clean", "sentence", "about", "things", "and", "people"] if good else ["BUY", "!!!", "click", "$$$", "win", "x9"]
        rows.append((i if i % 50 else None, " ".join(rng.choices(words, k=rng.randrange(5, 40))), rng.choice(["web", "news"]) if good else rng.choice(["web", "spam"]), "en", rng.randrange(100)))
        if i % 3 == 0 and i % 50:
            labels.append((i, int(good)))
    return rows + rows[:5], labels


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def test_pseudo_labels_are_the_smallest_draws_of_what_a_view_is_sure_of(spark):
    rows, labels = table(400)
    views = spark.createDataFrame(rows, "k long, t string, source string, lang string, size long").repartition(4)
    docs = views.select(F.col("k").alias("doc_id"), F.col("t").alias("text"), "source", "lang", F.col("size").alias("n_chars"))
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    known, used, wanted = [i for i, _ in labels], {0}, {1: 7, 0: 11}
    got = quality.surest(views, model, wanted, known, used)
    batch = views.withColumn("draw", F.xxhash64("t", F.lit(13))).toArrow().combine_chunks().to_batches()[0]
    odds = model.odds(batch.column("t"), quality.meta_codes(batch))
    data = batch.to_pylist()
    for name, view in (("text", 0), ("meta", 1)):
        want = []
        for label in (0, 1):
            sure = {r["draw"] for r, o in zip(data, odds[view]) if r["k"] not in known and (sigmoid(o) if label else 1 - sigmoid(o)) >= quality.SURE}
            want += [(d, label) for d in sorted(sure)[: wanted[label]]]
        assert [(r["draw"], label) for r, label in got[name]] == want
    assert got["text"]


def test_the_model_is_calibrated_and_combined_as_stated(spark):
    """The regression is at its optimum, the calibration at that of its own log-loss, and the score is the odds of both views less the prior's."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(float)
    w, b = quality.logistic(x, y)
    std = x.std(axis=0) + 1e-6
    z = (x - x.mean(axis=0)) / std
    grad = z.T @ (sigmoid(x @ w + b) - y) / len(y) + 1e-3 * w * std
    assert np.abs(grad).max() < 1e-3 and abs((sigmoid(x @ w + b) - y).mean()) < 1e-3
    margin = x @ w + b
    a, c = quality.platt(margin, y)
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    loss = lambda s, o: -(target * np.log(sigmoid(s * margin + o)) + (1 - target) * np.log(1 - sigmoid(s * margin + o))).mean()
    best = min(loss(a * f, c + d) for f in (0.8, 0.9, 1.0, 1.1, 1.25) for d in (-0.3, -0.1, 0.0, 0.1, 0.3))
    assert loss(a, c) <= best + 1e-4
    rows, labels = table(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    truth = dict(labels)
    for r in quality.score(docs, model).collect():
        part = pa.RecordBatch.from_pylist([{"source": r["source"], "lang": r["lang"], "size": r["n_chars"]}], pa.schema([("source", pa.string()), ("lang", pa.string()), ("size", pa.int64())]))
        one, two = model.odds(pa.array([r["text"]]), quality.meta_codes(part))
        assert r["quality_score"] == pytest.approx(float(sigmoid(one + two - model.prior)[0]), abs=1e-9)
        assert r["doc_id"] not in truth or (r["quality_score"] >= 0.5) == bool(truth[r["doc_id"]])


def test_quality_stage_with_a_model_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows, labels = table(300)
    odd = [(None, None, None, None, None), (9001, "", None, "en", 0), (9002, "clean sentence about people " * 5000, "news", "en", 140000), (9003, None, "web", None, 3), (9002, "BUY !!! click", "spam", None, None)]
    docs = spark.createDataFrame([(i, t, lang, source, n) for i, t, source, lang, n in rows + odd], "doc_id long, text string, lang string, source string, n_chars long").withColumn("quality_score", F.lit("x"))
    spark.createDataFrame([(i, y, 0) for i, y in labels] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    kept = [tuple(r) for r in out.collect()]
    assert out.columns == corpus_pipeline.COLUMNS and 0 < len(kept) < len(rows + odd)
    assert any(r[0] == 9002 and len(r[1]) > 100000 for r in kept) and not any(r[1] == "BUY !!! click" for r in kept)
