"""Embedding near-duplicates: an exact metric range join over pivots.

Vectors are scaled to length 1, where a cosine of at least c is a distance of at most
r = sqrt(2 - 2c). A label's pivots are a hash-drawn sample of its vectors; every
vector belongs to the cell of its nearest pivot. By the triangle inequality a vector within r of a
member of another cell has a distance to that cell's pivot of at most its own pivot
distance + 2r, and lies within r of the hyperplane between the two pivots (the sharper bound
in a Euclidean space); only then is it copied there. Each cell then finds all
neighbours of its own members without looking at other cells. Cells that are still large get pivots of
their own, by the same rule, to LEVELS levels. A cell is cut only where that doesn't raise what is sent: its vectors
are copied at most MOST_COPIES times on average, or less often than the whole cell's blocks are. Others (dense heaps) stay whole.

Equal vectors are one vector with a count before any of this. A cell with more members than a block holds is compared in
pairs of hash blocks, each pair once, tile by tile; a task never holds more than two blocks and one tile. A comparison
returns a neighbour count and one root for each member, never the pairs; the roots
go to connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, discard, stored

#: Vectors of a cell that are aimed at, pivots of one cell at most, members of a block, levels of cells, and
#: the size past which a cell of the first level is cut again.
CELL, PIVOTS, BLOCK, LEVELS, LARGE = 512, 64, 16_384, 3, 8192
#: Components of a block's vectors at most (8 MB; a block has 64 vectors at least), and vectors of a tile on either side.
BLOCK_VALUES, TILE = 1 << 20, (1024, 4096)
#: A cell is cut if its sampled vectors go to so many of its new cells on average at most.
MOST_COPIES = 2
#: Widens the radius in the pivot bounds, so that rounding never loses a pair; pairs are decided by cosine.
SLACK = 1e-6


def unit_rows(column: pa.ListArray, width: int) -> np.ndarray:
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    if len(x):  # squares of extreme components would be infinite or zero
        most = np.abs(x).max(axis=1, keepdims=True)
        x = np.where((most > 1e100) | (most < 1e-100), x / most, x)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def values_of(vectors: DataFrame, vector: str) -> Column:
    """The vector column: single precision stays as it is (half the bytes, the same numbers), all else is double."""
    return F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(l, v, key, c, k): distinct vectors of each label that can link, with the smallest key, the number of rows, and a number of their own."""
    values = values_of(vectors, vector)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(values, lambda x: x != 0)
    good = vectors.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.coalesce(finite & some, F.lit(False)))
    return good.groupBy(F.col(label).cast("string").alias("l"), values.alias("v")).agg(F.min(F.col(key).cast("long")).alias("key"), F.count("*").alias("c")).withColumn("k", F.monotonically_increasing_id())


CELLS = ["l", "d", "cell"]


def block_size(d: int) -> int:
    """Members of a block of vectors of d components."""
    return max(64, min(BLOCK, BLOCK_VALUES // max(d, 1)))


def reaches(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every vector, and which pivots' cells may hold vectors within the radius of it."""
    far = np.maximum(0, 2 - 2 * (x @ p.T))  # squared distances to the pivots
    home = far.argmin(axis=1)
    near = far[np.arange(len(x)), home]
    between = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home]
    goes = (far - near[:, None] <= 2 * between * radius + SLACK) & (np.sqrt(far) <= np.sqrt(near)[:, None] + 2 * radius + SLACK)
    goes[np.arange(len(x)), home] = True
    return home, goes


def choose_pivots(cells: DataFrame, large: DataFrame, radius: float, level: int) -> DataFrame:
    """(l, d, cell, n, v) of the pivots of the large cells that are worth cutting, from a bounded sample of each."""
    draw = F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    want = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL))
    sample = cells.join(large, CELLS).where(draw < 4.0 * want / F.col("n")).select(*CELLS, "n", want.cast("int").alias("want"), draw.alias("r"), "v")

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by([("r", "ascending")])
        n, want = t["n"][0].as_py(), t["want"][0].as_py()
        x = unit_rows(t["v"].combine_chunks(), t["d"][0].as_py())
        copies = reaches(x, x[:want], radius)[1].sum(axis=1).mean()
        blocks = n / block_size(t["d"][0].as_py())
        # in cells of n * copies / want members each, the copies of copies are copies ** 2 / want of the whole cell's blocks
        fewer = copies <= MOST_COPIES or (copies <= blocks / 2 and copies**2 <= want / 2)
        return t.slice(0, want if want > 1 and fewer else 0).select([*CELLS, "n", "v"])

    return sample.groupBy(*CELLS).applyInArrow(choose, f"l string, d int, cell string, n long, v {dict(cells.dtypes)['v']}")


def cut_cells(cells: DataFrame, pivots: DataFrame, radius: float) -> DataFrame:
    """cells (l, d, cell, own, k, c, v), the large ones cut at pivots of their own: each vector in the cell of its nearest pivot
    and, not its own there, in the cells that it may have neighbours in.

    Pivots and vectors meet in sorted partitions, the pivots first; a cell's vectors are dealt to several (pivots go to
    each), so that no task holds more than the pivots of one cell and a batch of vectors.
    """
    parts = F.ceil(F.col("n") / LARGE).cast("int")
    sizes = pivots.select(*CELLS, "n").distinct()
    whole = cells.join(sizes, CELLS, "left_anti")
    vectors = cells.join(sizes, CELLS).select(*CELLS, F.pmod(F.xxhash64("k"), parts).cast("int").alias("part"), F.lit(1).alias("s"), "own", "k", "c", "v")
    ahead = pivots.select(*CELLS, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("s"), F.lit(False).alias("own"), F.xxhash64("v").alias("k"), F.lit(0).cast("long").alias("c"), "v")
    met = vectors.unionByName(ahead).repartition(*CELLS, "part").sortWithinPartitions(*CELLS, "part", "s", "k")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            keys = list(zip(*(c.to_pylist() for c in b.columns[:5])))  # l, d, cell, part, s
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                part, (l, d, cell, number, s) = b.slice(lo, hi - lo), keys[lo]
                lo = hi
                if (l, d, cell, number) != at:
                    at, held = (l, d, cell, number), []
                x = unit_rows(part.column("v"), d)
                if s == 0:
                    held.append(x)
                    continue
                home, goes = reaches(x, np.concatenate(held), radius)
                to, new = np.nonzero(goes)
                sent = part.take(pa.array(to))
                own = sent.column("own").to_numpy(zero_copy_only=False) & (home[to] == new)
                yield pa.RecordBatch.from_arrays([sent.column("l"), sent.column("d"), pa.array([f"{cell}.{i}" for i in new]), pa.array(own, pa.bool_()), sent.column("k"), sent.column("c"), sent.column("v")], names=[*CELLS, "own", "k", "c", "v"])

    return whole.unionByName(met.mapInArrow(assign, f"l string, d int, cell string, own boolean, k long, c long, v {dict(cells.dtypes)['v']}"))


def cells_of(points: DataFrame, radius: float) -> DataFrame:
    """(l, d, cell, own, k, c, v), stored if cut: the vectors of every label and dimension in cells, cut until they are small or no use cutting."""
    cells = points.select("l", F.size("v").alias("d"), F.lit("").alias("cell"), F.lit(True).alias("own"), "k", "c", "v")
    before = None
    for level in range(LEVELS):
        large = cells.groupBy(*CELLS).agg(F.count("*").alias("n")).where(F.col("n") > (CELL if level == 0 else LARGE))
        if large.isEmpty():
            break
        pivots = stored(choose_pivots(cells, large, radius, level + 3), "pivots")
        if pivots.isEmpty():
            discard(pivots)
            break
        cells = stored(cut_cells(cells, pivots, radius), "cells")
        discard(before, pivots)
        before = cells
    return cells


def _roots(parent: np.ndarray) -> np.ndarray:
    """Every place's root, in a forest whose parents are never larger than their children."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return above
        parent = above


def _merge(parent: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The forest (as roots) after the links of a tile: near[x, y] links the places i[x] and j[y].

    Each round every row and column with a link to another tree takes one, so the trees that have such links are at most half as many after it.
    """
    while True:
        between = near & (parent[i][:, None] != parent[j][None, :])
        x, y = np.flatnonzero(between.any(axis=1)), np.flatnonzero(between.any(axis=0))
        if not len(x):
            return parent
        pairs = [*zip(i[x], j[between[x].argmax(axis=1)]), *zip(i[between[:, y].argmax(axis=0)], j[y])]
        parent = parent.copy()
        for a, b in pairs:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        parent = _roots(parent)


def compare(t: pa.Table, cosine: float) -> pa.Table:
    """Of one pair of blocks: for every vector that has a neighbour in it the rows within reach (an own member's; else 0) and the smallest key of its local component.

    Columns: d, k, c, v, own, b (its block), i and j (the pair). All rows of a block meet all of the other (of a block with itself: each other), a tile at a time.
    """
    if not t.num_rows:
        return pa.table({"k": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    t = t.sort_by([("k", "ascending")])  # the root of a tree is its first place, and so its smallest key
    x = unit_rows(t["v"].combine_chunks(), t["d"][0].as_py())
    key, count, block = t["k"].to_numpy(), t["c"].to_numpy(), t["b"].to_numpy()
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    parent, links, linked = np.arange(len(key)), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    for lo in range(0, len(left), TILE[0]):
        a = left[lo : lo + TILE[0]]
        for at in range(0, len(right), TILE[1]):
            b = right[at : at + TILE[1]]
            near = (x[a] @ x[b].T) >= cosine
            near &= a[:, None] != b[None, :]
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            near, a_, b_ = near[np.ix_(rows, columns)], a[rows], b[columns]
            linked[a_] = linked[b_] = True
            links[a_] += near @ count[b_]
            if i != j:
                links[b_] += count[a_] @ near
            parent = _merge(parent, near, a_, b_)
    links[~t["own"].to_numpy(zero_copy_only=False)] = 0
    return pa.table({"k": pa.array(key[linked]), "links": pa.array(links[linked]), "root": pa.array(key[parent][linked])})


def range_join(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null and the cosine (double precision) is at least
    `cosine`; vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Rows with equal vectors link with each
    other. Rows that share a key are judged one by one, by their own vectors. A null key links with nothing: its component is null and it is
    kept. Vectors of any dimension and ties at the threshold are compared in double precision. An empty table gives no rows.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    points = stored(usable(vectors, key, vector, label), "points")
    cells = cells_of(points, radius)
    # every vector lies in one of its cell's blocks, and goes to the pairs (i, j), i <= j, of that block with each
    size = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.col("d"))))
    sizes = cells.groupBy(*CELLS).agg(F.count("*").alias("n")).select(*CELLS, F.ceil(F.col("n") / size).cast("int").alias("nb"))
    rows = cells.join(sizes, CELLS).withColumn("b", F.pmod(F.xxhash64("k", F.lit(1)), F.col("nb")).cast("int"))
    rows = rows.select(*CELLS, "own", "k", "c", "v", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    pairs = rows.select(*CELLS, "own", "k", "c", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    met = pairs.groupBy(*CELLS, "i", "j").applyInArrow(lambda t: compare(t, cosine), "k long, links long, root long")
    found = stored(met, "found")
    discard(cells)
    near = found.groupBy("k").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    known = points.join(near, "k", "left").join(group.select(F.col("node").alias("k"), "component"), "k", "left")
    known = known.select("l", "v", "key", F.col("c").alias("_c"), F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("component", "k").alias("_g"))
    least = known.groupBy("_g").agg(F.min("key").alias("_component"))  # of a component: its smallest key
    classes = stored(known.join(least, "_g").select("l", "v", "_c", "_links", "_component"), "classes")
    discard(points, found, group)
    rows = vectors.select(F.col(key), F.col(label).cast("string").alias("l"), values_of(vectors, vector).alias("v"))
    back = rows.where(F.col(key).isNotNull()).join(classes, ["l", "v"], "left").select(key, "_c", "_links", "_component")
    none = rows.where(F.col(key).isNull()).select(key, F.lit(None).cast("long").alias("_c"), F.lit(None).cast("long").alias("_links"), F.lit(None).cast("long").alias("_component"))
    return back.unionByName(none).select(
        key,
        F.coalesce(F.col("_links") + F.col("_c") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("_component"), F.col(key).cast("long")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label, cosine 0.98 (see range_join)."""
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
