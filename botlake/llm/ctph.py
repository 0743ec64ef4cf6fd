"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it is divisible by the
block size; each chunk's hash becomes one of 64 letters. A fingerprint is
`block size:letters:letters at twice the block size`. The block size is the smallest
MIN_BLOCK x 2^k at which SIGNATURE chunks would cover the text, halved while there are too few letters.
Two fingerprints are compared where their block sizes agree (equal, or one twice the
other) by the edit distance of the letters (a replacement is a removal and an insertion).

Rolling hashes, boundaries and chunk hashes of all texts of a batch are computed side
by side in numpy; the edit distance is bit-parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import U64, slices, span_hashes, utf8

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, MIN_BLOCK, SIGNATURE, RUN = 7, 1, 64, 5
#: Only texts of at most so many bytes are cut at every byte (block size 1).
SHORT = 256
#: Most ranges that the keys are cut into.
RANGES = 4096


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each position."""
    h, n = np.zeros(len(data), np.uint32), len(data)
    for k in range(min(WINDOW, n)):
        h[k:] += data[: n - k].astype(np.uint32) * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


class Batch:
    """Chunk boundaries and signatures of all texts of a byte buffer."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.ends, self.n = ends, len(ends) - 1
        joined = rolling(data)
        for k in range(WINDOW - 1):  # a text's first bytes don't see the text before
            at = ends[:-1] + k
            at = at[at < ends[1:]]
            h = np.zeros(len(at), np.uint32)
            for j in range(k + 1):
                h += data[at - j].astype(np.uint32) * np.uint32(pow(0x9E3779B1, j + 1, 1 << 32))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            joined[at] = h
        short = np.repeat(np.diff(ends) <= SHORT, np.diff(ends))
        hit = np.flatnonzero((joined & np.uint32(1) == 0) | short)
        found = joined[hit]
        low = found & (~found + np.uint32(1))
        self.level = np.full(len(hit), 32, np.int64)  # a position ends a chunk at block sizes up to 2^(level - 1)
        self.level[low > 0] = np.log2(low[low > 0]).astype(np.int64) + 1
        self.hit, self.data = hit, data

    def signatures(self) -> list[tuple[int, str, str]]:
        sizes = np.diff(self.ends)
        k = (sizes > SHORT).astype(np.int64)
        for i in range(40):
            k[sizes > (MIN_BLOCK << i) * SIGNATURE] = i + 1
        level, owner = self.level, np.searchsorted(self.ends, self.hit, side="right") - 1
        deepest = int(k.max(initial=0)) + 1
        counts = np.zeros((deepest + 1, self.n), np.int64)
        for i in range(deepest + 1):
            counts[i] = np.bincount(owner[level > i], minlength=self.n)
        rows = np.arange(self.n)
        for _ in range(deepest):
            few = (k > (sizes > SHORT)) & (counts[k, rows] < SIGNATURE // 2 - 1)
            k[few] -= 1
        one, two = self.letters(k, level, owner), self.letters(k + 1, level, owner)
        return [(MIN_BLOCK << int(a), x, y) for a, x, y in zip(k, one, two, strict=True)]

    def letters(self, k: np.ndarray, level: np.ndarray, owner: np.ndarray) -> list[str]:
        """Signatures at block size MIN_BLOCK x 2^k: a letter a chunk, the last for all that follows the 63rd boundary."""
        pick = level > k[owner]
        at, own = self.hit[pick], owner[pick]
        first = np.searchsorted(own, np.arange(self.n))
        rank = np.arange(len(own)) - first[own]
        keep = rank < SIGNATURE - 1
        at, own = at[keep] + 1, own[keep]
        count = np.bincount(own, minlength=self.n)
        last = self.ends[:-1].copy()
        if len(at):
            has = count > 0
            last[has] = at[np.cumsum(count)[has] - 1]
        tail = np.flatnonzero(last < self.ends[1:])  # bytes after the last boundary
        ends = np.concatenate([at, self.ends[1:][tail]])
        owners = np.concatenate([own, tail])
        order = np.lexsort((ends, owners))
        ends, owners = ends[order], owners[order]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        fresh = np.ones(len(owners), bool)
        fresh[1:] = owners[1:] != owners[:-1]
        starts = np.where(fresh, self.ends[:-1][owners], starts)
        codes = LETTERS[(span_hashes(self.data, starts, ends) >> U64(58)).astype(np.int64)].tobytes().decode()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=self.n))])
        return [codes[cuts[i] : cuts[i + 1]] for i in range(self.n)]


def fingerprints(texts: pa.Array) -> list[str]:
    """`block size:signature:signature at twice the size` of every text; a null is an empty text."""
    data, ends = utf8(texts)
    out: list[str] = []
    for lo, hi in slices(ends, 1_500_000):
        part = Batch(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        out += [f"{b}:{x}:{y}" for b, x, y in part.signatures()]
    return out


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 less the edit distance over both lengths; 0 if no run of RUN letters (or of half the shorter signature) is shared."""
    if a == b:
        return 1.0
    run = min(RUN, -(-min(len(a), len(b)) // 2))
    if not run:
        return 0.0
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1, of two fingerprints; 0 if their block sizes aren't compatible."""
    if x == y:
        return 1.0
    (p, a, b), (q, c, d) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    pairs = [(a, c), (b, d)] if p == q else [(b, c)] if 2 * p == q else [(a, d)] if p == 2 * q else []
    return max((signature_likeness(s, t) for s, t in pairs if s and t), default=0.0)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(keys: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Rows of a run of documents, each with the text that follows it."""
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    prints = fingerprints(pa.array(texts + following[-1:], pa.large_string()))
    changed = fingerprints(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(prints[:-1]),
            pa.array(changed),
            pa.array([likeness(a, b) for a, b in zip(prints, changed)]),
            pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])]),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def compare_with_next(docs: DataFrame, partitions: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited self and its successor in ascending key order.

    The key range is cut at its quantiles, into more ranges than partitions; each range gets, as a sentinel, the
    first document of the next range that has one (the last range: the very first), so that every task
    finds all successors among its own sorted rows. Texts are shuffled once; the ranges' first keys
    (at most RANGES) are all that reaches the driver.
    Null keys come first; rows with equal keys follow each other in text order.
    """
    docs = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ranges = min(RANGES, 4 * partitions)
    cuts = sorted(set(docs.select(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [])) if ranges > 1 else []
    number = _range_of(F.col("k"), cuts)
    known = F.struct(F.col("k").isNotNull().alias("known"), "k")
    firsts = docs.groupBy(number.alias("b")).agg(F.min(known).alias("m")).select("b", "m.k").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    order = sorted((r["b"], r["k"]) for r in firsts)
    before = docs.sparkSession.createDataFrame([(order[i - 1][0], order[i][1]) for i in range(len(order))], "b int, first long")  # the last range, for the first
    heads = docs.join(F.broadcast(before), F.col("k").eqNullSafe(F.col("first"))).groupBy("b", "k").agg(F.min("t").alias("t")).select("b", F.lit(True).alias("s"), "k", "t")
    rows = docs.select(number.alias("b"), F.lit(False).alias("s"), "k", "t").unionByName(heads)
    dealt = rows.repartition(partitions, "b").sortWithinPartitions("b", "s", F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, key, text) whose successor isn't known yet
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = ([held] if held else []) + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1]]  # a sentinel ends its range
                held = rows[-1] if rows and not rows[-1][1] else None
                pairs and (yield from _runs(pairs))

    def _runs(pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
        lo = 0
        for hi in range(1, len(pairs) + 1):
            if hi == len(pairs) or pairs[hi][0] is not pairs[hi - 1][1]:
                yield _compare([x[2] for x, _ in pairs[lo:hi]], [x[3] for x, _ in pairs[lo:hi]], [y[3] for _, y in pairs[lo:hi]])
                lo = hi

    return dealt.mapInArrow(run, SCHEMA)


def _range_of(k: Column, cuts: list[int], width: int = 64) -> Column:
    """How many cuts are not above k: the stretch of `width` cuts by counting its bounds, then the place in it."""
    if not cuts:
        return F.lit(0)
    stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    bounds = F.array(*[F.lit(s[0]).cast("long") for s in stretches])
    at = F.size(F.filter(bounds, lambda c: c <= k))
    inside = F.element_at(F.array(*[F.array(*[F.lit(c).cast("long") for c in s]) for s in stretches]), at)
    return F.when(k.isNull() | (at == 0), 0).otherwise((at - 1) * width + F.size(F.filter(inside, lambda c: c <= k)))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are.

    A null text is empty; empty texts have the fingerprint `1::`. A single document is its own successor.
    Texts of any length are fingerprinted whole; rows with equal ids follow each other in text order (a tie of equal texts changes nothing). Repeated
    rows are kept, other columns are not read; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_with_next(docs, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
