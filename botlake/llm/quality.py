"""Quality of documents by co-training two views.

The text view is a linear model over hashed byte-trigram frequencies of the whole text,
the metadata view one over source, language, length and what is missing. Both
start from a bounded sample of labelled rows. In each round each classifier, calibrated, scores all unlabelled
documents in a pass over the table; of those that it is surest of, a hash-drawn choice (of a bounded size, equal texts once)
is handed to the other one with its labels.
At the end each view is calibrated (Platt) on labelled rows that neither was trained on, and a
document's score adds the calibrated log-odds of both views, less the prior's once.

The models are fitted on the driver from at most LABELLED + ROUNDS x 2 PER_ROUND feature rows; all
documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import row_slices, slices, utf8
from .graph import discard, stored

#: Most labelled rows that the models see (two of three train, one calibrates).
LABELLED = 3000
#: Rounds of pseudo-labels, how many a view hands over in one, and how sure of them it must be.
ROUNDS, PER_ROUND, SURE = 3, 250, 0.95
GRAMS, SOURCES, LANGS, SIZES, SHRINK = 1024, 64, 16, 24, 200
#: Text features; how much weaker the penalty on shares of byte kinds is than on single trigrams.
TEXT, DENSE = GRAMS + 6, 4.0
META = SOURCES + LANGS + SIZES + 2


def gram_codes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash (0 to GRAMS - 1) of the three bytes that end at each position; bytes before a text's start count as 0."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1)
    for back, factor in ((1, 0x85EBCA77), (2, 0xC2B2AE3D)):
        older = np.zeros(len(data), np.uint32)
        older[back:] = data[:-back]
        for k in range(back):
            older[starts[starts + k < len(data)] + k] = 0
        h += older * np.uint32(factor)
    return (h >> np.uint32(16)) & np.uint32(GRAMS - 1)


def byte_kinds() -> np.ndarray:
    """A kind of each byte: 0 other, 1 upper case, 2 digit, 3 sign but . and , 4 white space, 5 line feed."""
    kinds = np.zeros(256, np.uint8)
    kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = 1, 2
    kinds[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = 3
    kinds[[9, 11, 12, 13, 32]], kinds[10] = 4, 5
    return kinds


def text_features(column: pa.Array) -> np.ndarray:
    """Of every text: trigram frequencies (of few bytes: shrunk towards 0), how concentrated they are, and the shares of byte kinds."""
    data, ends = utf8(column)
    n, sizes = len(column), np.diff(ends)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * GRAMS + gram_codes(data, ends[:-1][sizes > 0]), minlength=n * GRAMS).reshape(n, GRAMS)
    out = np.empty((n, TEXT), np.float32)
    out[:, :GRAMS] = counts / (sizes + SHRINK)[:, None]
    pairs = (counts.astype(np.float64) * (counts - 1)).sum(axis=1) / np.maximum(1.0, sizes * (sizes - 1.0))
    out[:, GRAMS] = np.log(pairs * sizes / (sizes + SHRINK) + 1 / GRAMS)
    kinds = np.bincount(owner * 6 + byte_kinds()[data], minlength=n * 6).reshape(n, 6)[:, 1:]
    out[:, GRAMS + 1 :] = np.sqrt(kinds / (sizes + SHRINK / 10)[:, None])
    return out


def text_margin(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The text view's linear score of every text."""
    _, ends = utf8(column)
    out = np.full(len(column), bias)
    for lo, hi in slices(ends, 1_000_000):
        for at in range(lo, hi, 1000):
            to = min(hi, at + 1000)
            out[at:to] += text_features(column.slice(at, to - at)) @ weights
    return out


def meta_codes(batch: pa.RecordBatch) -> np.ndarray:
    """Three feature numbers a row from its metadata: source, language, size; nulls have their own."""
    import zlib

    def code(values: list, n: int) -> list[int]:
        return [n - 1 if v is None else zlib.crc32(str(v).encode()) % (n - 1) for v in values]

    source = np.array(code(batch.column("source").to_pylist(), SOURCES))
    lang = np.array(code(batch.column("lang").to_pylist(), LANGS)) + SOURCES
    size = np.array([0 if v is None else min(SIZES - 1, 1 + abs(int(v)).bit_length()) for v in batch.column("size").to_pylist()]) + SOURCES + LANGS
    return np.stack([source, lang, size], axis=1) if len(source) else np.zeros((0, 3), np.int64)


def one_hot(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), META), np.float32)
    np.put_along_axis(out, codes, 1, axis=1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a regularised logistic regression by accelerated gradient steps on standardised features; the dense text features count DENSE times."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    if x.shape[1] == TEXT:
        std[GRAMS:] /= DENSE
    z = ((x - mean) / std).astype(np.float64)
    w, b, v, u = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    rate = 4 / (float((z[: 500] ** 2).sum(axis=1).mean()) + 1) if len(z) else 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ (w + 0.9 * v) + b + 0.9 * u, -30, 30)))
        v = 0.9 * v - rate * (z.T @ (p - y) / len(y) + decay * w)
        u = 0.9 * u - rate * float((p - y).mean())
        w, b = w + v, b + u
    w = w / std
    return w, float(b - w @ mean)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that turn a margin into log-odds; smoothed targets keep it finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    centre, spread = margin.mean(), margin.std() + 1e-9
    w, b = logistic(((margin - centre) / spread)[:, None], target, decay=1e-4, steps=500)
    return float(w[0] / spread), float(b - w[0] * centre / spread)


@dataclass
class Model:
    text: np.ndarray
    text_bias: float
    meta: np.ndarray
    meta_bias: float
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def odds(self, texts: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views."""
        one = self.text_scale[0] * text_margin(texts, self.text, self.text_bias) + self.text_scale[1]
        return one, self.meta_scale[0] * (self.meta[codes].sum(axis=1) + self.meta_bias) + self.meta_scale[1]

    def score(self, texts: pa.Array, codes: np.ndarray) -> np.ndarray:
        one, two = self.odds(texts, codes)
        return 1 / (1 + np.exp(-np.clip(one + two - self.prior, -30, 30)))


class CoTraining:
    """Labelled features, the pseudo-labels that each view got from the other, and the models of both.

    y: 0 or 1. Every third labelled row is kept for calibration.
    """

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        held = np.arange(len(y)) % 3 == 2
        self.train = ~held if len(set(y[~held])) == 2 else np.ones(len(y), bool)
        self.held = held if len(set(y[held])) == 2 else self.train
        self.own, self.y = {"text": text, "meta": meta}, y
        self.given = {"text": (np.zeros((0, TEXT), np.float32), np.zeros(0)), "meta": (np.zeros((0, META), np.float32), np.zeros(0))}
        self.share = min(0.9, max(0.1, y[self.train].mean()))

    def give(self, to: str, features: np.ndarray, labels: np.ndarray) -> None:
        rows, known = self.given[to]
        self.given[to] = (np.concatenate([rows, features]), np.concatenate([known, labels]))

    def model(self) -> Model:
        fitted, scales = {}, {}
        for view, own in self.own.items():
            rows, labels = self.given[view]
            w, b = logistic(np.concatenate([own[self.train], rows]), np.concatenate([self.y[self.train], labels]))
            fitted[view], scales[view] = (w, b), platt(own[self.held] @ w + b, self.y[self.held])  # a view that can't tell is never sure
        share = self.y[self.held].mean()
        odds = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return Model(*fitted["text"], *fitted["meta"], scales["text"], scales["meta"], odds)


def _views(docs: DataFrame, key: str, text: str, source: str, lang: str, size: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(size).cast("long").alias("size"))


FEATURES = "k long, y int, draw long, grams binary, codes array<int>"


def _features(rows: DataFrame) -> DataFrame:
    """FEATURES of rows (k, t, source, lang, size, y, draw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 200):
            grams = pa.array([g.tobytes() for g in text_features(part.column("t"))], pa.binary())
            codes = pa.array(meta_codes(part).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), part.column("draw"), grams, codes], names=["k", "y", "draw", "grams", "codes"])

    return rows.select("k", "t", "source", "lang", "size", F.col("y").cast("int"), "draw").mapInArrow(run, FEATURES)


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([np.frombuffer(r["grams"], np.float32) for r in rows], np.float32).reshape(len(rows), TEXT)
    return text, one_hot(np.array([r["codes"] for r in rows], np.int64).reshape(len(rows), 3))


def surest(views: DataFrame, model: Model, wanted: dict[int, int], labelled: list[int], used: set[int]) -> dict[str, list]:
    """FEATURES (y: the pseudo-label) by view of hash-drawn rows among all that it is SURE of: wanted[label] of each label, equal texts once,
    none of the labelled ones and none whose text was used.

    Every task keeps that many of the smallest draws of each kind, then as many are taken of all, and their texts are looked up.
    """
    draw = F.xxhash64("t", F.lit(13))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(view, label): np.zeros(0, np.int64) for view in (0, 1) for label in (0, 1)}
        gone, known = np.array(sorted(used), np.int64), np.array(labelled, np.int64)
        for part in row_slices(batches):
            draws = part.column("draw").to_numpy()
            fresh = ~np.isin(draws, gone) & ~np.isin(part.column("k").fill_null(-1).to_numpy(), known)
            for view, odds in enumerate(model.odds(part.column("t"), meta_codes(part))):
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                for label, sure in ((1, p), (0, 1 - p)):
                    best[view, label] = np.unique(np.concatenate([best[view, label], draws[fresh & (sure >= SURE)]]))[: wanted[label]]
        for (view, label), found in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), 2 * view + label, np.int32)), pa.array(found)], names=["kind", "draw"])

    found = stored(views.withColumn("draw", draw).mapInArrow(run, "kind int, draw long").distinct(), "draws")
    chosen = {
        (view, label): [r["draw"] for r in found.where(F.col("kind") == 2 * view + label).orderBy("draw").limit(wanted[label]).collect()] for view in (0, 1) for label in (0, 1)
    }
    discard(found)
    draws = sorted({d for ds in chosen.values() for d in ds})
    texts = views.withColumn("draw", draw).where(F.col("draw").isin(draws)).groupBy("draw").agg(F.min(F.struct("k", "t", "source", "lang", "size")).alias("r"))
    rows = {r["draw"]: r for r in _features(texts.select("r.*", F.lit(0).alias("y"), "draw")).collect()} if draws else {}
    return {name: [(rows[d], label) for label in (0, 1) for d in sorted(chosen[view, label])] for view, name in enumerate(("text", "meta"))}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars", label: str = "quality") -> Model | None:
    """A model from a bounded sample of labelled rows and all unlabelled ones; None if the labelled rows aren't of two classes.

    The sample is drawn by a hash of the key against a threshold from counts. Labels other
    than 0 and 1 and null keys are left out; of contradicting labels the smaller counts, of rows that share a labelled key one.
    """
    draw = F.pmod(F.xxhash64(F.col("k"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    clean = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.min(label).cast("int").alias("y"))
    n = clean.count()
    if not n or docs.isEmpty():
        return None
    views = _views(docs, key, text, source, lang, size)
    some = clean.where(draw < LABELLED / n).limit(2 * LABELLED)
    one = Window.partitionBy("k").orderBy(F.xxhash64("t", "source", "lang", "size"))
    labelled = views.join(F.broadcast(some), "k").withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")

    known = sorted(_features(labelled.withColumn("draw", F.lit(0).cast("long"))).collect(), key=lambda r: r["k"])
    y = np.array([r["y"] for r in known], np.float64)
    if len(set(y)) < 2:
        return None
    order = np.random.default_rng(5).permutation(len(y))
    both = CoTraining(*_arrays([known[i] for i in order]), y[order])
    wanted = {1: int(PER_ROUND * both.share), 0: int(PER_ROUND * (1 - both.share)) + 1}
    used: set[int] = set()
    for _ in range(ROUNDS):
        found = surest(views, both.model(), wanted, [r["k"] for r in known], used)
        for view, other in (("text", "meta"), ("meta", "text")):
            rows = [(r, label) for r, label in found[view] if r["draw"] not in used]
            used |= {r["draw"] for r, _ in rows}
            texts, metas = _arrays([r for r, _ in rows])
            both.give(other, texts if other == "text" else metas, np.array([label for _, label in rows], np.float64))
        if not any(found.values()):
            break
    return both.model()


def score(docs: DataFrame, model: Model | None, text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars", to: str = "quality_score") -> DataFrame:
    """All columns of docs and `to`, 0 to 1 (null without a model). Columns of any name go through (`to` is replaced). Texts of any length are scored whole; equal rows get equal scores, and a tie of the views is 0.5."""
    names = [c for c in docs.columns if c != to]
    if model is None:
        return docs.select(*names, F.lit(None).cast("double").alias(to))
    full = docs.select(F.struct(*names).alias("row"), F.col(text).alias("t"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(size).cast("long").alias("size"))
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(to, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches):
            cols = pa.RecordBatch.from_struct_array(b.column("row")).columns
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(b.column("t"), meta_codes(b)))], names=[*names, to])

    return full.mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it is kept (0.5 or more).

    Null texts are scored as empty ones, null metadata has features of its own, repeated rows are
    scored one by one. Without labels of two classes scores are null and all is kept.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text", "source", "lang", "n_chars"), fit(docs, labels))
    return out.select("doc_id", "quality_score", F.coalesce(F.col("quality_score") >= 0.5, F.lit(True)).alias("kept"))
