"""Substring deduplication by content-defined chunks of a gear rolling hash.

A gear hash ends a chunk where some of its bits are zero: after white space with a chance of
1 in 4, inside words of 1 in 256, at MIN_CHUNK to MAX_CHUNK bytes. The bits are those that the last 16 bytes
decide, so a passage has boundaries of its own from there on. As a boundary depends on the bytes before it alone, text inserted or removed elsewhere doesn't move it. Chunks
go by a 128-bit digest; a digest's first owner is the smallest key that has it. In every
other document, neighbouring chunks with an earlier owner form a passage; passages of at
least MIN_PASSAGE bytes are removed, shorter ones (common phrases) stay.

Digests meet in a partial aggregate (smallest and largest key) and in an equi-join whose
hot digests adaptive execution can split. Only chunks that a Bloom filter of the repeated digests (of a bounded size; it has no
false negatives) lets pass are shuffled to that join; whole texts are shuffled once, to meet their passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import U64, row_slices, slices, span_hashes, utf8
from .graph import stored

MIN_CHUNK, MAX_CHUNK, MIN_PASSAGE = 16, 512, 96
#: Bits of the filter for each repeated digest, probes, and 64-bit blocks at most (16 MB).
FILTER_BITS, PROBES, MOST_BLOCKS = 16, 5, 1 << 21


def gear(data: np.ndarray) -> np.ndarray:
    """Sum of the last 32 bytes' random values, each shifted by its age, modulo 2^32."""
    table = np.random.default_rng(1711).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
    h, span = table[data], 1
    while span < 32:
        older = h.copy()
        h[span:] += older[:-span] << np.uint32(span) if len(h) > span else 0
        span *= 2
    return h


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends (within data) of the chunks of all texts."""
    h = gear(data)
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    hit = (space[data] & (h & np.uint32(0x300) == 0)) | (h & np.uint32(0xFF00) == 0)
    if len(data):
        hit[:-1] &= data[1:] & 0xC0 != 0x80  # never inside a character
    marks = np.flatnonzero(hit) + 1
    at = np.searchsorted(marks, ends, side="right")
    rows, starts, stops = [], [], []
    for r in range(len(ends) - 1):
        last, stop = int(ends[r]), int(ends[r + 1])
        if last == stop:
            continue
        mine = [last]
        for m in [*marks[at[r] : at[r + 1]].tolist(), stop]:
            while m - last > MAX_CHUNK:
                last = forced(data, last + MAX_CHUNK)
                mine.append(last)
            if m - last >= MIN_CHUNK or m == stop:
                mine += [m] if m > last else []
                last = m
        rows += [r] * (len(mine) - 1)
        starts += mine[:-1]
        stops += mine[1:]
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)


def forced(data: np.ndarray, at: int) -> int:
    """at, or the start of the character that it falls into."""
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def digest_filter(repeated: DataFrame) -> np.ndarray:
    """A blocked Bloom filter of digests (d1, d2): one 64-bit block by d1, PROBES bits of it by d2."""
    blocks = 1024
    wanted = min(MOST_BLOCKS, repeated.count() * FILTER_BITS // 64)
    while blocks < wanted:
        blocks *= 2
    bits = F.lit(0).cast("long")
    for i in range(PROBES):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("d2", 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    found = repeated.groupBy(F.col("d1").bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(F.bit_or(bits).alias("bits")).toPandas()
    out = np.zeros(blocks, np.int64)
    out[found["block"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(U64)


def may_hold(blocks: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which digests the filter lets pass."""
    need = np.zeros(len(one), U64)
    for i in range(PROBES):
        need |= U64(1) << (two >> U64(6 * i) & U64(63))
    return blocks[(one & U64(len(blocks) - 1)).astype(np.int64)] & need == need


def chunks(docs: DataFrame, passing=None) -> DataFrame:
    """(d1, d2, k, h, lo, hi): digest, document and byte range of every chunk of (k, h, t), or of those that a broadcast filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches):
            data, ends = utf8(b.column(2))
            for lo, hi in slices(ends, 1_500_000):
                part, own = data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                rows, starts, stops = cut(part, own)
                one, two = span_hashes(part, starts, stops), span_hashes(part, starts, stops, salt=9)
                if passing is not None:
                    some = may_hold(passing.value, one, two)
                    one, two, rows, starts, stops = one[some], two[some], rows[some], starts[some], stops[some]
                pick = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), b.column(0).take(pick), b.column(1).take(pick), pa.array((starts - own[rows]).astype(np.int32)), pa.array((stops - own[rows]).astype(np.int32))],
                    names=["d1", "d2", "k", "h", "lo", "hi"],
                )

    return docs.mapInArrow(run, "d1 long, d2 long, k long, h long, lo int, hi int")


def passages(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Unions of touching spans that are at least so long."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out if hi - lo >= least]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_PASSAGE) -> DataFrame:
    """All rows and columns of docs with text rid of passages that a smaller key has too, and `removed`:
    the removed ranges as (start, length) in characters of the old text.

    Null texts stay null and a null key keeps its text (it owns nothing). Rows with
    one key don't lose text to each other; of equal keys each loses its own. Repeats inside one document stay. Texts of any length are cut whole. Columns of
    any name go through (`removed` is replaced). An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "removed"]
    docs = docs.select(*names)
    keyed = docs.select(F.struct(*names).alias("row"), F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"))
    slim = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    ends = chunks(slim).groupBy("d1", "d2").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    owners = stored(ends.where("first < last").select("d1", "d2", "first"), "owners")
    passing = docs.sparkSession.sparkContext.broadcast(digest_filter(owners))
    later = chunks(slim, passing).join(owners, ["d1", "d2"]).where(F.col("k") > F.col("first"))
    spans = later.groupBy("k", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    met = keyed.join(spans, ["k", "h"], "left").select("row", "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches):
            cols = pa.RecordBatch.from_struct_array(b.column(0)).columns
            texts, gone = cols[place].to_pylist(), []
            for i, s in enumerate(b.column(1).to_pylist()):
                cuts = passages([(x["lo"], x["hi"]) for x in s], least) if s else []
                mine = []
                if cuts:
                    raw, at, kept, chars = texts[i].encode(), 0, [], 0
                    for lo, hi in cuts:
                        kept.append(raw[at:lo].decode())
                        n = len(raw[lo:hi].decode())
                        chars += len(kept[-1])
                        mine.append({"start": chars, "length": n})
                        chars += n
                        at = hi
                    texts[i] = "".join(kept) + raw[at:].decode()
                gone.append(mine)
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=[*names, "removed"])

    return met.mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents with a smaller id: characters before and after, passages, and a digest of what stays.

    Nulls count as empty texts, a null doc_id loses nothing, repeated rows lose nothing to each other; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs.withColumn("n_chars", F.length("text").cast("long")))
    return out.select(
        "doc_id",
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")).alias("kept_chars"),
        F.size("removed").cast("long").alias("n_passages"),
        "removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
