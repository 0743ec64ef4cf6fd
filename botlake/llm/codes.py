"""Product codes of vectors: exact integer k-means of vector parts, its nearest entries found by LAESA.

A vector's integers are cut into PARTS equal parts. The distances of every part to fixed pivots of its position are computed once
and stored with the vectors. Each round computes the pivots' distances to the entries; the largest difference of the two,
over the pivots, is a lower bound of the distance of a part to an entry. Entries are evaluated exactly (in integers) by ascending
bound, and those whose bound is above the best distance so far are never evaluated. Tasks return sums by
(part, entry), at most PARTS x ENTRIES rows each, and the codebooks, of the same size, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PIVOTS = 4
#: What rounding may take off a bound: 64 parts in 2^52 of the distances it comes from are less.
SLACK = 1e-9


def largest(width: int) -> int:
    """The bound that integers are held within, so that a vector's summed squared distances fit into 64 bits: 2^27 at 64 components."""
    return 1 << (60 - (width - 1).bit_length()) // 2


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, x) of the usable vectors: floor(SCALE x component) within largest(), filled with zeros to the longest one's length (a multiple of parts)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(parts, -(-longest // parts) * parts)
    bound = F.lit(float(largest(width)))
    x = F.transform("v", lambda c: F.floor(F.greatest(-bound, F.least(bound, c * SCALE))).cast("long"))
    return rows.select("vec_id", "label", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def pivots_of(book: np.ndarray, count: int) -> np.ndarray:
    """(part, pivot, position): of each position's first entries, the first one and then always the one farthest from those chosen."""
    out = []
    for entries in book if count else []:
        chosen = [0]
        far = ((entries - entries[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(entries)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((entries - entries[chosen[-1]]) ** 2).sum(1))
        out.append(entries[chosen])
    return np.array(out)


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of points, exact."""
    out = np.zeros((len(x), len(points)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - points[None, :, d]) ** 2
    return out


def nearest(x: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row of x, the lower entry of equal ones, and how many distances were evaluated."""
    here = np.sqrt(to_pivots.astype(np.float64))
    there = np.sqrt(squares(pivots, entries).astype(np.float64))
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(here[:, p, None] - there[None, p]) - SLACK * (here[:, p, None] + there[None, p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best, code = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    live, evaluated = np.arange(len(x)), 0
    for rank in range(len(entries)):
        e = order[live, rank]
        near = bound[live, e] ** 2 <= best[live] * (1 + SLACK)  # the bounds that follow are no smaller
        live, e = live[near], e[near]
        if not len(live):
            break
        evaluated += len(live)
        d = ((x[live] - entries[e]) ** 2).sum(1)
        better = (d < best[live]) | ((d == best[live]) & (e < code[live]))
        best[live[better]], code[live[better]] = d[better], e[better]
    return code, best, evaluated


def assign(x: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, (row, part), of vectors as (row, part, position)."""
    found = [nearest(x[:, p], to_pivots[:, p], pivots[p], book[p])[:2] for p in range(len(book))]
    return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def floor_means(sums: np.ndarray, counts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each used entry's floor(sum / count), the others as they are."""
    return np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), book)


class Coder:
    """Codebooks of a table of integer vectors, and the distances to the pivots that are stored with it."""

    def __init__(self, rows: DataFrame, parts: int, entries: int, pivots: int):
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
        width = len(first[0]["x"]) // parts if first else 1
        x = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width)
        self.book = np.ascontiguousarray(x.transpose(1, 0, 2))
        self.pivots = pivots_of(self.book, pivots if first else 0)
        self.parts = parts

    def measure(self, rows: DataFrame) -> DataFrame:
        """rows with d: the squared distances of all parts to their pivots."""
        pivots, parts = self.pivots, self.parts
        width, count = parts * pivots.shape[2], pivots.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("x"), width).reshape(b.num_rows, parts, -1)
                d = np.stack([squares(x[:, p], pivots[p]) for p in range(parts)], 1)
                yield b.append_column("d", pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (parts * count)), pa.array(d.reshape(-1))))

        kind = rows.schema["label"].dataType.simpleString()
        return rows.mapInArrow(run, f"vec_id long, label {kind}, x array<long>, d array<long>")

    def _coded(self, b: pa.RecordBatch, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self.parts
        x = matrix(b.column("x"), parts * book.shape[2]).reshape(b.num_rows, parts, -1)
        d = matrix(b.column("d"), parts * self.pivots.shape[1]).reshape(b.num_rows, parts, -1)
        return x, *assign(x, d, self.pivots, book)

    def refine(self, measured: DataFrame) -> None:
        """One round: every part to its nearest entry, then every entry to the floor of its parts' mean."""
        coder, book, entries = self, self.book, self.book.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
            for b in batches:
                x, code, _ = coder._coded(b, book)
                for p in range(len(book)):
                    np.add.at(sums[p], code[:, p], x[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        summed = F.array(*[F.sum(F.col("sums")[i]) for i in range(book.shape[2])])
        found = measured.select("x", "d").mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), summed.alias("sums")).collect()
        sums, counts = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
        for r in found:
            sums[r["part"], r["entry"]], counts[r["part"], r["entry"]] = r["sums"], r["n"]
        self.book = floor_means(sums, counts, book)

    def encode(self, measured: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) by the codebooks as they are."""
        coder, book = self, self.book

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, code, best = coder._coded(b, book)
                text = code.astype(np.uint8).tobytes().hex()
                n = 2 * len(book)
                codes = [text[i : i + n] for i in range(0, len(text), n)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes), pa.array(best.sum(1))], names=["vec_id", "label", "code", "error"])

        kind = measured.schema["label"].dataType.simpleString()
        return measured.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.book.reshape(-1).tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[Coder, DataFrame] | None:
    """The codebooks after all rounds, and the stored table that they were fitted on (to encode it); None without a usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = integers(vectors, key, vector, label, parts)
    coder = Coder(rows, parts, entries, pivots)
    if not coder.book.size:
        return None
    measured = stored(coder.measure(rows), "measured")
    for _ in range(rounds):
        coder.refine(measured)
    return coder, measured


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    Null vectors and vectors with null, NaN or infinite components have no row. Vectors of other lengths, or of a length that isn't a multiple of
    `parts`, are filled with zeros at their end (an empty one is all zeros). Integers past largest() are held at it, label_error at the largest long. Rows that share a vec_id are coded
    one by one; the first entries go by vec_id, then by the integers, null ids last. Fewer vectors than entries make shorter codebooks, and of
    equal entries the lower one is taken. Null labels are one label. Other columns are not read; an empty table gives no rows.
    """
    found = fit(vectors, key, vector, label, parts, entries, rounds, pivots)
    if not found:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coder, measured = found
    coded = stored(coder.encode(measured), "codes")
    discard(measured)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long").alias("label_error")).withColumnRenamed("label", "l")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("l")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(coder.digest()).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings as 16 codes of 64 entries after two rounds, with their errors; null, NaN and infinite vectors have no row.

    For repeated ids, ties, other lengths, extreme components, empty tables and further columns see compress().
    """
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    near = """{out} AS MATERIALIZED (SELECT vec_id, part, x, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
        SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
        FROM parts p JOIN {book} b USING (part)) GROUP BY vec_id, part, x)"""
    mean = """{out} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
        SELECT part, entry, [floor(sum(x[1])::DECIMAL(38,0) / count(*))::BIGINT, floor(sum(x[2])::DECIMAL(38,0) / count(*))::BIGINT, floor(sum(x[3])::DECIMAL(38,0) / count(*))::BIGINT, floor(sum(x[4])::DECIMAL(38,0) / count(*))::BIGINT] AS x
        FROM {near} GROUP BY part, entry) m USING (part, entry))"""
    steps = [near.format(out="near1", book="book0"), mean.format(out="book1", book="book0", near="near1")]
    steps += [near.format(out="near2", book="book1"), mean.format(out="book2", book="book1", near="near2"), near.format(out="near3", book="book2")]
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, x[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) t(p)),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN ids USING (vec_id)),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, sum(n.dist)::BIGINT AS error
  FROM kept k JOIN near3 n USING (vec_id) GROUP BY k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


#: Vectors of 64 components, unique ids and integers within largest() are assumed, as in the given tables.
OP12_SQL = _sql()
