"""A stored search index: packed units, postings in impact order, exact top-k by pruning.

Two tables in one folder, both partitioned by a bucket of (agent, document), so that a changed document
touches its own bucket alone:

* `units`: one row a searchable unit, with its columns and its lexemes and their scores side by side;
* `postings`: for every (agent, lexeme) of a bucket (of about RUN postings of one) the units and scores in order of falling scores, BLOCK in a row, each row with its largest score.

A lexeme's score grows with its count alone, so a block's largest score bounds all its units. The k best units of a question are found in two
stages. The rarest lexemes give first units, and the best of these their ranks (from their packed rows), which set a threshold: the k-th best so far. A
unit above it must have half of it from lexemes outside of the most frequent ones, as far as their best scores together stay below the other half, and all its
blocks have a bound above it: only such blocks are opened. Units whose scores there, with the best scores of the frequent lexemes, reach the threshold
are ranked from their packed rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import bounded, delete, written
from .knowledge import MOST_POSITIONS, RANK_LIMIT, RANK_WEIGHT, chunk_units

#: Units of a posting row; documents a bucket holds about, until there are MOST_BUCKETS.
BLOCK, BUCKET_DOCS, MOST_BUCKETS = 128, 2000, 16_384
#: Postings that a task sorts at a time, about: a bucket's, while there are fewer than MOST_BUCKETS.
RUN = 1 << 19
#: The first stage opens lexemes of a question until they have so many postings (the rarest one in any case), and ranks so many units for each of the k.
SEEDS, SEED_UNITS = 1024, 4
#: Share of the threshold that the closed lists' best scores may reach: a larger one opens fewer lists, and leaves more units to rank.
FREQUENT = 0.5
#: Rows of (agent, lexeme) or (question, unit) that are broadcast at most.
SMALL = 200_000
#: Ranks are rounded to nine places: a bound within this of the threshold isn't below it.
CLOSE = 1e-8
SCORES = RANK_WEIGHT * np.concatenate([[0.0], np.cumsum(1 / np.arange(1.0, MOST_POSITIONS + 1) ** 2)]) / RANK_LIMIT
UNITS = "unit_id string, document_id string, agent_id string, skill_id string, title string, content string"


def pack_lexemes(units: DataFrame, english: bool = True) -> DataFrame:
    """units with lexemes and scores: the distinct lexemes of title and content in both vocabularies, and the scores of their summed counts (one vocabulary if not english).

    Words come from Spark's own expression; the words of an Arrow batch are numbered, stemmed once and counted in numpy. What a batch took is given back
    before the next one comes: an executor keeps two workers a core, idle ones too, each with all that its allocator has not returned.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, at, lexeme, tf = tx.count_lexemes(b.column("words"), english=english)
            ends = np.searchsorted(at, np.arange(b.num_rows + 1)).astype(np.int32)
            kept = [c for c in b.schema.names if c != "words"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(ends, names.take(pa.array(lexeme))), pa.ListArray.from_arrays(ends, pa.array(SCORES[np.minimum(tf, MOST_POSITIONS)]))], names=[*kept, "lexemes", "scores"])
            del b, names, at, lexeme, tf, ends
            pa.default_memory_pool().release_unused()

    return units.withColumn("words", F.coalesce(tx.words_of(text), F.array())).mapInArrow(run, f"{UNITS}, lexemes array<string>, scores array<double>")


def _packed(docs: DataFrame, buckets: int, english: bool) -> DataFrame:
    """The packed units of documents with their bucket. Documents are dealt by it while they are only their text; chunks and lexemes aren't shuffled."""
    bucket = lambda key: F.pmod(F.xxhash64("agent_id", key), F.lit(buckets)).cast("int")
    dealt = docs.select("id", "agent_id", "skill_id", "title", "content").repartition(buckets, bucket("id"))
    return pack_lexemes(chunk_units(dealt), english).withColumn("bucket", bucket("document_id"))


def _save(df: DataFrame, path: str) -> None:
    """Rows that are dealt by bucket already, each bucket one file; only the buckets that have rows are replaced."""
    df.sortWithinPartitions("bucket", "agent_id", "unit_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


POSTINGS = "bucket int, agent_id string, lexeme string, block int, size int, top double, units array<struct<unit_id:string,score:double>>"


def _run(units: pa.Table) -> pa.RecordBatch:
    """Posting rows of units (bucket, agent_id, unit_id, text: lexemes, scores) that come in the order of these columns: lists by lexeme, by falling score, then unit.

    A posting is one long number until it is placed, made in place; all else that is held of it are narrow ones.
    """
    units = units.combine_chunks()
    bucket, agent, ids = (units[c].combine_chunks() for c in ("bucket", "agent_id", "unit_id"))
    lists = pc.split_pattern(units["text"].combine_chunks(), " ")
    unit = np.repeat(np.arange(len(units), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    coded = lists.flatten().dictionary_encode()
    del lists
    score = units["scores"].combine_chunks().flatten().to_numpy()
    n, names, code = len(unit), coded.dictionary, coded.indices.to_numpy()
    place = np.empty(len(names), np.int64)
    place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(place))
    group = np.zeros(len(units), np.int64)
    for c in (bucket, agent):
        own = c.dictionary_encode().indices.to_numpy()
        group[1:] |= own[1:] != own[:-1]
    levels = np.unique(score)  # a few hundred at most
    key = np.cumsum(group)[unit]
    key *= len(place)
    key += place[code]
    key *= len(levels)
    key += len(levels) - 1
    key -= np.searchsorted(levels, score)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    key //= len(levels)
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    del key
    sizes = np.diff(np.append(heads, n))
    starts = np.flatnonzero((np.arange(n, dtype=np.int32) - np.repeat(heads.astype(np.int32), sizes)) % BLOCK == 0)
    at = (starts - heads[np.searchsorted(heads, starts, "right") - 1]) // BLOCK
    ends, first = np.append(starts, n).astype(np.int32), order[starts]
    pairs = pa.StructArray.from_arrays([ids.take(pa.array(unit[order])), pa.array(score[order])], names=["unit_id", "score"])
    of = pa.array(unit[first])
    columns = [bucket.take(of), agent.take(of), names.take(pa.array(code[first])), pa.array(at.astype(np.int32)), pa.array(np.diff(ends)), pa.array(score[first]), pa.ListArray.from_arrays(ends, pairs)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "agent_id", "lexeme", "block", "size", "top", "units"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of units as they come, about RUN postings at a time: a bucket that has more gets several lists of a lexeme, each in order."""
    held, size = [], 0
    for b in batches:
        held, size = [*held, b], size + len(b.column("scores").flatten())
        if size >= RUN:
            rows = _run(pa.Table.from_batches(held))
            held, size = [], 0
            yield rows
            del b, rows
            pa.default_memory_pool().release_unused()
    if size:
        yield _run(pa.Table.from_batches(held))


def _save_postings(units: DataFrame, path: str, buckets: int) -> None:
    """Postings of whole buckets of units. Units are dealt by bucket and sorted, a row each; their postings are sorted in numpy, RUN at a time, and never are rows of their own."""
    full = units.where(F.col("agent_id").isNotNull() & (F.size("lexemes") > 0))
    # lexemes have no blanks: as one text they are a fifth of what an array of them is in a shuffle
    own = full.select("bucket", "agent_id", "unit_id", F.concat_ws(" ", "lexemes").alias("text"), "scores").repartition(buckets, "bucket")
    rows = own.sortWithinPartitions("bucket", "agent_id", "unit_id").mapInArrow(_blocks, POSTINGS)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def build_index(docs: DataFrame, path: str, english: bool = True, buckets: int | None = None) -> None:
    """Writes the index of documents (id, agent_id, skill_id, title, content) to a folder.

    Texts are chunked and read once. Documents without an agent or without words are stored but never found; ids must be unique. An empty table makes an empty index.
    """
    spark = docs.sparkSession
    buckets = buckets or min(MOST_BUCKETS, max(16, -(-docs.count() // BUCKET_DOCS)))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(english).alias("english")).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    _save(_packed(docs, buckets, english), f"{path}/units")
    _save_postings(_units(spark, path), f"{path}/postings", buckets)


def _about(spark: SparkSession, path: str) -> tuple[int, bool]:
    row = spark.read.parquet(f"{path}/about").first()
    return row["buckets"], row["english"]


def _units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{UNITS}, lexemes array<string>, scores array<double>, bucket int").parquet(f"{path}/units")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings")


def update_index(path: str, changed: DataFrame, gone: DataFrame | None = None) -> list[int]:
    """Replaces the units and postings of changed documents, drops those of `gone` (id), and returns the buckets that were rewritten.

    Only the buckets that hold such a document, before or now (it may have another agent), are read and written. An update that was cut short is whole after it is run again.
    """
    spark = changed.sparkSession
    buckets, english = _about(spark, path)
    fresh = written(_packed(changed, buckets, english), "fresh-units")
    ids = changed.select(F.col("id").alias("document_id"))
    ids = ids.unionByName(gone.select(F.col("id").alias("document_id"))) if gone is not None else ids
    ids = written(ids.distinct(), "changed-ids")
    stored = _units(spark, path)
    before = stored.select("document_id", "bucket").join(ids, "document_id", "left_semi").select("bucket")
    touched = sorted(r[0] for r in before.unionByName(fresh.select("bucket")).distinct().collect())
    if not touched:
        return []
    kept = stored.where(F.col("bucket").isin(touched)).join(ids, "document_id", "left_anti").select(*fresh.columns)
    now = written(kept.unionByName(fresh), "bucket-units")
    _save(now.repartition(len(touched), "bucket"), f"{path}/units")
    _save_postings(now, f"{path}/postings", len(touched))
    left = {r[0] for r in now.where(F.col("agent_id").isNotNull() & (F.size("lexemes") > 0)).select("bucket").distinct().collect()}
    rows = {r[0] for r in now.select("bucket").distinct().collect()}
    for b in touched:  # a bucket without rows isn't replaced by a write
        if b not in left:
            delete(spark, f"{path}/postings/bucket={b}")
        if b not in rows:
            delete(spark, f"{path}/units/bucket={b}")
    return touched


def _asked(queries: DataFrame, english: bool) -> DataFrame:
    """(query_id, agent_id, vocabulary, n, lexeme) of all questions."""
    words = tx.words_of(F.col("question"))
    out = None
    for name, ws in [("simple", words)] + ([("english", tx.stems(words))] if english else []):
        own = queries.select("query_id", "agent_id", F.lit(name).alias("vocabulary"), F.array_distinct(ws).alias("ws"))
        own = own.select("query_id", "agent_id", "vocabulary", F.size("ws").alias("n"), F.explode("ws").alias("lexeme"))
        out = own if out is None else out.unionByName(own)
    return out


def _ranks(pairs: DataFrame, units: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, unit_id, rank) of pairs, from the packed rows of their units."""
    met = units.select("unit_id", "lexemes", "scores").join(pairs, "unit_id")
    one = met.select("query_id", "unit_id", F.explode(F.arrays_zip("lexemes", "scores")).alias("x")).select("query_id", "unit_id", F.col("x.lexemes").alias("lexeme"), F.col("x.scores").alias("score"))
    hits = one.join(asked.select("query_id", "vocabulary", "n", "lexeme"), ["query_id", "lexeme"])
    by = hits.groupBy("query_id", "unit_id", "vocabulary").agg((F.sum("score") / F.max("n")).alias("rank"))
    return by.groupBy("query_id", "unit_id").agg(F.round(F.max("rank"), 9).alias("rank"))


def _best(ranks: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "unit_id")
    return ranks.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _opened(blocks: DataFrame) -> DataFrame:
    """(query_id, vocabulary, unit_id, part): what the lexemes of opened blocks (query_id, vocabulary, n, units) add to their units' ranks."""
    one = blocks.select("query_id", "vocabulary", "n", F.explode("units").alias("u"))
    return one.groupBy("query_id", "vocabulary", "n", F.col("u.unit_id").alias("unit_id")).agg((F.sum("u.score") / F.col("n")).alias("part"))


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 6, scope: Column | None = None) -> DataFrame:
    """The k best units of every question by the stored index: (query_id, unit_id, rank, position), as knowledge.search ranks all units.

    queries: query_id, agent_id, question. `scope` is a condition on the units' columns (their skill, for one). Questions without words, or
    whose agent has none of them, have no rows; of equal ranks the smaller unit_id comes first. Questions, and the lists that they ask for, are stored on the way; sets of at most SMALL rows are broadcast.
    """
    k = min(max(k, 1), 20)
    _, english = _about(spark, path)
    postings, units = _postings(spark, path), _units(spark, path)
    units = units.where(scope) if scope is not None else units
    asked = written(_asked(queries, english), "asked")
    small = F.broadcast if asked.count() <= SMALL else lambda df: df  # all that follows by (question, vocabulary, lexeme) has no more rows
    few = small(asked)
    met = written(postings.join(small(asked.select("agent_id", "lexeme").distinct()), ["agent_id", "lexeme"]).select("agent_id", "lexeme", "block", "size", "top", "units"), "met")
    lists = met.groupBy("agent_id", "lexeme").agg(F.sum("size").alias("df"), F.max("top").alias("m"))
    own = Window.partitionBy("query_id", "vocabulary")
    rare = own.orderBy("df", "lexeme").rowsBetween(Window.unboundedPreceding, -1)
    frequent = own.orderBy(F.desc("df"), F.desc("lexeme"))
    terms = asked.join(lists, ["agent_id", "lexeme"]).withColumn("top", F.col("m") / F.col("n"))
    terms = written(terms.withColumns({"rarer": F.coalesce(F.sum("df").over(rare), F.lit(0)), "below": F.sum("top").over(frequent), "all": F.sum("top").over(own)}).drop("m"), "terms")
    # first stage: the best units of the rarest lexemes, and the k-th best rank among them
    seeds = terms.where(F.col("rarer") < SEEDS).select("query_id", "vocabulary", "n", "agent_id", "lexeme")
    parts = _opened(met.where("block = 0").join(small(seeds), ["agent_id", "lexeme"])).groupBy("query_id", "unit_id").agg(F.max("part").alias("rank"))
    first = written(_best(parts, SEED_UNITS * k).select("query_id", "unit_id"), "seeds")
    first = _best(_ranks(bounded(first, SMALL), units, few), k)
    bar = first.where(F.col("position") == k).select("query_id", (F.col("rank") - CLOSE).alias("bar"))
    # second stage: blocks that can hold a unit at or above it, and units that can reach it
    held = terms.join(bar, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-1.0)))
    needed = held.where(F.col("below") >= FREQUENT * F.col("bar"))
    needed = needed.withColumn("rest", F.col("all") - F.sum("top").over(own))
    needed = written(needed.select("query_id", "vocabulary", "agent_id", "lexeme", "n", "bar", "rest", (F.col("bar") - F.col("all") + F.col("top")).alias("least")), "needed")
    opened = met.join(small(needed), ["agent_id", "lexeme"]).where(F.col("top") / F.col("n") >= F.col("least"))
    reach = needed.select("query_id", "vocabulary", (F.col("bar") - F.col("rest")).alias("least")).distinct()
    found = _opened(opened).join(small(reach), ["query_id", "vocabulary"]).where(F.col("part") >= F.col("least"))
    found = written(found.select("query_id", "unit_id").distinct(), "found")
    return _best(_ranks(bounded(found, SMALL), units, few), k)


def posting_lists(spark: SparkSession, path: str) -> DataFrame:
    """(agent_id, lexeme, units, top) of all stored lists: how many units have the lexeme, and its best score. No posting is opened."""
    return _postings(spark, path).groupBy("agent_id", "lexeme").agg(F.sum("size").alias("units"), F.round(F.max("top"), 9).alias("top"))


def unit_texts(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """hits (unit_id) with title and content of their units, fetched last. Hits are stored on the way: they are counted and joined, and found once."""
    hits = written(hits, "hits")
    return _units(spark, path).select("unit_id", "title", "content").join(bounded(hits, SMALL), "unit_id")
