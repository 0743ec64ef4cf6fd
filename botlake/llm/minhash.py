"""Near-duplicate documents: a chosen-path similarity join over minwise tokens.

1. Every text becomes its set of word shingles (64-bit hashes), a digest of the set and
   WIDTH minwise values. Documents with equal sets are one class from here on.
2. Trees: a node draws each of the WIDTH coordinates with probability 1/(LAMBDA WIDTH) by
   a hash of the node, and a document descends, for each drawn coordinate, to the child
   named by its minwise value there. A pair of similarity LAMBDA is expected to share one
   child of every node that it shares. TREES independent roots raise the recall: a pair at
   0.8 meets in some first-level node with probability 1 - 0.2^(roots' draws), about 20 of them.
3. Contraction: a first-level node's head is the member whose nodes are largest (the base of a group of
   near copies is in nearly all of the group's nodes, a copy in fewer). Every document is linked to the head
   it shares most nodes with, if the full sets confirm it. A large group of near copies becomes
   one component by as many links as it has members, not by all its pairs.
4. Nodes whose members are all in one component are done. Small nodes are compared
   exhaustively; larger ones in blocks of bounded size, the members outside the node's largest
   component against all, if these are few; else they branch again, to MAX_DEPTH at most.
   Candidates need an estimate within four standard errors of the threshold, then the
   full sets decide.

What is reported is exact; what can be missed is a link at the threshold that shares no compared node, with these chances
at similarity 0.8 (less above it): nodes of up to SMALL members are compared in all TREES (about 20 draws, 0.2^20), nodes of SMALL to
BLOCK members in LARGE_TREES trees alone (8 draws, 0.2^8 = 3 in a million), larger ones at once where few members are
outside the largest component and else one level down (a node is shared on with a chance of about 0.6, so of some 16 shared
nodes all fail with 0.4^16), and the estimate turns down one in tens of thousands. A missed link matters only if no
other path joins its documents. tests/llm measures the recall in small, medium and large mixed nodes.

Nothing is collected but counts. Texts are read again only for documents with candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import ODD, U64, mix, row_slices, slices, utf8
from .graph import components, discard, stored
from .shingles import digests, sets, signatures

WIDTH, TREES, LAMBDA, SMALL, MAX_DEPTH, BLOCK = 64, 18, 0.8, 24, 3, 512
#: First-level nodes that a document shares with the one it is linked to for contraction, of about 20.
SHARED = 6
#: Trees whose nodes of SMALL to BLOCK members are compared: 8 draws, 1 - 0.2^8 of the pairs at 0.8.
LARGE_TREES = 10
#: Ids are broadcast to pick documents only up to so many (some 90 bytes each where they were measured, so 90 MB).
BROADCAST_IDS = 1_000_000


def sketch(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(k, n, d1, d2, sig): set size, set digest and minwise values of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches):
            _, raw = utf8(b.column(1))
            for lo, hi in slices(raw, 1_000_000):
                h, ends = sets(b.column(1).slice(lo, hi - lo), size)
                one, two = digests(h, ends)
                sig = signatures(h, ends, WIDTH)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "n", "d1", "d2", "sig"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text)).mapInArrow(run, "k long, n long, d1 long, d2 long, sig binary")


def children(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes that the members of nodes descend to."""
    coordinate = np.arange(1, WIDTH + 1).astype(U64) * ODD
    drawn = mix(mix(nodes.astype(np.int64).view(U64) + ODD)[:, None] + coordinate[None, :])
    row, at = np.nonzero(drawn < U64(int(2**64 / (LAMBDA * WIDTH))))
    child = mix(drawn[row, at] ^ mix(sigs[row, at].astype(U64) + ODD))
    return row, child.view(np.int64)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def roots(classes: DataFrame) -> DataFrame:
    """(node, rep, tree): the first level of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig, rep = _sigs(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
                for tree in range(TREES):
                    row, child = children(np.full(len(rep), tree + 1), sig)
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(rep[row]), pa.array(np.full(len(row), tree, np.int32))], names=["node", "rep", "tree"])

    return classes.select("rep", "sig").mapInArrow(run, "node long, rep long, tree int")


def descend(rows: DataFrame) -> DataFrame:
    """(node, rep, comp) one level down, of (node, rep, comp, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, child = children(b.column(0).to_numpy(), _sigs(b.column(3)))
                yield pa.RecordBatch.from_arrays([pa.array(child), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))], names=["node", "rep", "comp"])

    return rows.select("node", "rep", "comp", "sig").mapInArrow(run, "node long, rep long, comp long")


def least_matches(percent: int) -> int:
    """Equal minwise values that a pair at the threshold reaches but for one in tens of thousands."""
    j = percent / 100
    return max(1, int(WIDTH * (j - 4 * (j * (1 - j) / WIDTH) ** 0.5)))


def estimate(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, same): how many minwise values of each pair agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_sigs(b.column(2)) == _sigs(b.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int32())], names=["a", "b", "same"])

    sig = _only(classes, "rep", pairs.select(F.explode(F.array("a", "b")).alias("rep"))).select("rep", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long, same int")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 x intersection >= percent x union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches):
            _, raw = utf8(b.column(1))
            for lo, hi in slices(raw, 1_000_000):
                h, ends = sets(b.column(1).slice(lo, hi - lo), size)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=["k", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    chosen = _only(docs.select(F.col(key).cast("long").alias("k"), F.col(text)), "k", pairs.select(F.explode(F.array("a", "b")).alias("k")))
    full = stored(chosen.mapInArrow(run, "k long, set array<long>"), "sets")
    one = _only(full.select(F.col("k").alias("b"), F.col("set").alias("sb")), "b", pairs.select("b"))
    two = _only(full.select(F.col("k").alias("a"), F.col("set").alias("sa")), "a", pairs.select("a"))
    joined = pairs.join(one, "b").join(two, "a")  # the hot side of a pair first, while its rows are short
    out = stored(joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct(), "links")
    discard(full)
    return out


def _only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted; the ids are broadcast while they are few, so that the rows aren't shuffled."""
    ids = stored(wanted.distinct(), "wanted")  # its plan runs once
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def short_sets(docs: DataFrame, reps: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(rep, set): the shingle set of each wanted document as sorted distinct 32-bit hashes (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches):
            _, raw = utf8(b.column(1))
            for lo, hi in slices(raw, 1_000_000):
                h, ends = sets(b.column(1).slice(lo, hi - lo), size)
                short = (h >> U64(32)).astype(np.uint32)
                out = [np.unique(short[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], names=["rep", "set"])

    chosen = _only(docs.select(F.col(key).cast("long").alias("rep"), F.col(text)), "rep", reps.select("rep"))
    return chosen.mapInArrow(run, "rep long, set binary").dropDuplicates(["rep"])


def similar(members: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) of sorted sets reach the threshold: by one product of incidence matrices, a stretch of members at a time, or pair by pair where few."""
    sizes = np.array([len(m) for m in members])
    both = np.zeros(len(i), np.int64)
    if len(i) < 4 * len(members):
        for n, (x, y) in enumerate(zip(i, j)):
            both[n] = len(np.intersect1d(members[x], members[y], assume_unique=True))
    else:
        rows = np.repeat(np.arange(len(members)), sizes)
        values, at, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        shared = count[at] > 1
        rank = np.cumsum(count > 1) - 1
        rows, cols = rows[shared], rank[at[shared]]
        total = np.zeros((len(members), len(members)), np.float32)
        for lo in range(0, int((count > 1).sum()), 4096):
            here = (cols >= lo) & (cols < lo + 4096)
            part = np.zeros((len(members), 4096), np.float32)
            part[rows[here], cols[here] - lo] = 1
            total += part @ part.T
        both = total[i, j].astype(np.int64)
    return 100 * both >= percent * (sizes[i] + sizes[j] - both)


def blocks(large: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs, from (node, rep, comp, sig, set, main, c, others), of nodes too large to compare in a join.

    Members outside the node's largest component meet all members, in cells of at most two blocks. Only pairs
    that the members' sets confirm (32 bits of each hash, which never misses a link) leave a cell.
    """
    least = least_matches(percent)

    def compare(t: pa.Table) -> pa.Table:
        rep, comp, sig = t["rep"].to_numpy(), t["comp"].to_numpy(), _sigs(t["sig"].combine_chunks())
        asks, target = t["asks"].to_numpy(zero_copy_only=False), np.flatnonzero(t["target"].to_numpy(zero_copy_only=False))
        a, b = [], []
        for i in np.flatnonzero(asks):
            ok = target[comp[target] != comp[i]]
            ok = ok[(sig[ok] == sig[i]).sum(axis=1) >= least]
            a.append(np.full(len(ok), i))
            b.append(ok)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            binary = t["set"].combine_chunks()
            keep = similar([np.frombuffer(binary[int(u)].as_py(), np.uint32) for u in used], place[: len(a)], place[len(a) :], percent)
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64())})

    rows = large.select("node", "rep", "comp", "sig", "set", "main", "c", "others").withColumns({"nb": F.ceil(F.col("c") / BLOCK).cast("int"), "na": F.ceil(F.col("others") / BLOCK).cast("int")})
    number = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    base = ["rep", "comp", "sig", "set"]
    outside = F.col("comp") != F.col("main")
    single = (F.col("nb") == 1) & (F.col("na") == 1)
    one = rows.where(single).select("node", F.lit(0).alias("i"), F.lit(0).alias("j"), *base, outside.alias("asks"), F.lit(True).alias("target"))
    targets = rows.where(~single).select("node", number(3, "nb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("j"), *base, F.lit(False).alias("asks"), F.lit(True).alias("target"))
    asking = rows.where(~single & outside).select("node", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), number(5, "na").alias("j"), *base, F.lit(True).alias("asks"), F.lit(False).alias("target"))
    return one.unionByName(targets).unionByName(asking).groupBy("node", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of docs.

    Rows are linked if 100 x intersection >= percent x union of their sets of `size`-word shingles.
    Texts without words (null, empty, blank) have an empty set and link with nothing. Rows that share a key
    but not the set are compared each by its own text, and belong together; a row with a null key links with nothing, its
    component is null and it is kept. Very long texts are compared whole, further columns are not read. An empty table gives no rows.
    """
    marks = stored(sketch(docs, size, key, text), "marks")
    useful = marks.where((F.col("n") > 0) & F.col("k").isNotNull())
    several = stored(useful.groupBy("k").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("k"), "versions")
    if several.isEmpty():
        discard(several)
        return _classes(docs, marks, None, size, percent, key, text)
    # a number of its own for each text of such a key, past all keys
    own = F.xxhash64("k", "t").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    twins = several.withColumn("more", F.lit(True))
    numbered = rows.join(twins, "k", "left").withColumn("node", F.when(F.col("more"), own).otherwise(F.col("k")))
    twins = stored(numbered.where("more").select("node", F.col("k").alias("real")).distinct(), "twins")
    nodes = numbered.select("node", "t")
    found = _classes(nodes, stored(sketch(nodes, size, "node", "t"), "marks"), twins, size, percent, "node", "t")
    found = found.join(twins, "node", "left").withColumn(key, F.coalesce("real", "node"))
    found = found.withColumn("component_id", F.when(F.col("component_id") == F.col("node"), F.col(key)).otherwise(F.col("component_id")))
    return found.select(key, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, marks: DataFrame, twins: DataFrame | None, size: int, percent: int, key: str, text: str) -> DataFrame:
    """near_duplicates of docs whose keys have one set each; twins (node, real) links a node with the smaller number that it stands for."""
    useful = marks.where((F.col("n") > 0) & F.col("k").isNotNull())
    groups = useful.groupBy("d1", "d2", "n").agg(F.min("k").alias("rep"))
    classes = stored(useful.select(F.col("k").alias("rep"), "sig").join(groups.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"]), "classes")

    first = roots(classes)  # (node, rep, tree)
    shared = first.groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    met = stored(first.join(shared, "node"), "nodes")
    weight = met.groupBy("rep").agg(F.sum("c").alias("w"))
    best = met.join(weight, "rep").groupBy("node").agg(F.max(F.struct("w", F.negative("rep").alias("r"))).alias("x")).select("node", F.negative("x.r").alias("head"))
    heads = met.join(best, "node").where(F.col("rep") != F.col("head")).groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("same")).where(F.col("same") >= SHARED)
    stars = stored(heads.groupBy("a").agg(F.max_by("b", F.struct("same", F.negative("b"))).alias("b")), "stars")
    links = confirm(stars, docs, size, percent, key, text)
    discard(stars)
    if twins is not None:
        same = twins.join(useful.select(F.col("k").alias("node"), "d1", "d2", "n"), "node").join(groups, ["d1", "d2", "n"])
        before, links = links, stored(links.unionByName(same.select(F.col("rep").alias("a"), F.col("real").alias("b")).distinct()), "links")
        discard(before)
    joined = components(links)

    # nodes of medium size, all compared at once, are enough of the first LARGE_TREES trees
    medium = (F.col("c") > SMALL) & (F.col("c") <= BLOCK) & (F.col("tree") >= LARGE_TREES)
    rows = met.where(~medium).select("node", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("comp"))
    found, spent = [], [met]
    for depth in range(1, MAX_DEPTH + 1):
        rows = stored(rows, "rows")
        spent.append(rows)
        counts = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
        mixed = counts.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("comps")).where("comps > 1").select("node", "c", F.col("top.comp").alias("main"), (F.col("c") - F.col("top.c")).alias("others"))
        rows = stored(rows.join(mixed, "node"), "mixed")
        spent.append(rows)
        small = rows.where(F.col("c") <= SMALL).select("node", "rep", "comp")
        other = small.select("node", F.col("rep").alias("b"), F.col("comp").alias("other"))
        pairs = small.join(other, "node").where((F.col("rep") > F.col("b")) & (F.col("comp") != F.col("other"))).select(F.col("rep").alias("a"), "b")
        few = (F.col("others") <= BLOCK // 4) | (F.col("c") <= BLOCK) | F.lit(depth == MAX_DEPTH)
        large = rows.where(F.col("c") > SMALL)
        with_sigs = lambda df: df.join(_only(classes, "rep", df.select("rep")), "rep")
        at_once = large.where(few)
        compared = stored(blocks(with_sigs(at_once).join(short_sets(docs, at_once, size, key, text), "rep"), percent).distinct(), "compared")
        spent.append(compared)
        found += [pairs, compared]
        more = large.where(~few)
        if more.isEmpty():
            break
        rows = descend(with_sigs(more))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = stored(every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    candidates = stored(estimate(every, classes).where(F.col("same") >= least_matches(percent)).select("a", "b"), "candidates")
    discard(*spent, every, classes)
    if not candidates.isEmpty():
        extra = confirm(candidates, docs, size, percent, key, text)
        before, joined = joined, components(links.unionByName(extra))
        discard(before, extra)
    discard(candidates, links)
    return (
        marks.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "d1", "d2", "n")
        .join(groups, ["d1", "d2", "n"], "left")
        .join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component", "rep", key)).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, similarity 0.8 (see near_duplicates)."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
