"""The knowledge base: chunks, searchable units, lexemes and ranked retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import bounded

#: Rank of a lexeme that occurs n times: RANK_WEIGHT x (1 + 1/4 + ... + 1/n^2) / (pi^2 / 6); occurrences count up to MOST_POSITIONS.
RANK_WEIGHT, RANK_LIMIT, MOST_POSITIONS = 0.1, 1.64493406685, 256
#: Rows of (agent, word) that are broadcast at most.
SMALL = 200_000
#: Rows of a batch of counts at most.
COUNTED = 100_000
#: Largest rewrite input, and least share (and characters) of the original that a rewrite must keep.
MOST_REWRITE, LEAST_SHARE, LEAST_CHARS = 120_000, 0.4, 200


def chunk_documents(docs: DataFrame, key: str = "id", content: str = "content", target: int = tx.TARGET, overlap: int = tx.OVERLAP) -> DataFrame:
    """(parent_id, chunk_index, content) of every document of at least two chunks; a document that fits into one has none."""
    several = lambda c: c if len(c) > 1 else []  # noqa: E731  decided here: a filter on what is cut would cut every text once more
    cut = F.pandas_udf(lambda s: s.map(lambda t: several(tx.chunk_text(t, target, overlap))), "array<string>")
    return docs.select(F.col(key).alias("parent_id"), F.posexplode(cut(F.col(content))).alias("chunk_index", "content"))


def slice_documents(docs: DataFrame, key: str = "id", content: str = "content", limit: int = tx.SLICE) -> DataFrame:
    """(id, slice_index, content): groups of paragraphs that one model call can take."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: tx.slice_text(t, limit)), "array<string>")
    return docs.select(F.col(key), F.posexplode(cut(F.col(content))).alias("slice_index", "content"))


def searchable_units(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with their document's columns, and the documents that have none: (unit_id, document_id, agent_id, skill_id, title, content)."""
    base = docs.select(F.col("id").alias("document_id"), "agent_id", "skill_id", "title", "content")
    own = chunks.select(F.concat_ws("#", "parent_id", "chunk_index").alias("unit_id"), F.col("parent_id").alias("document_id"), "content")
    of_chunks = own.join(base.drop("content"), "document_id")
    whole = base.join(chunks.select(F.col("parent_id").alias("document_id")).distinct(), "document_id", "left_anti").withColumn("unit_id", F.col("document_id"))
    return of_chunks.unionByName(whole).select("unit_id", "document_id", "agent_id", "skill_id", "title", "content")


def chunk_units(docs: DataFrame) -> DataFrame:
    """searchable_units of documents that are chunked here, in one pass over their texts."""
    cut = F.pandas_udf(lambda s: s.map(tx.chunk_text), "array<string>")
    rows = docs.select(F.col("id").alias("document_id"), "agent_id", "skill_id", "title", "content", cut("content").alias("_c"))
    several = F.size("_c") > 1
    rows = rows.select("document_id", "agent_id", "skill_id", "title", several.alias("_s"), F.posexplode(F.when(several, F.col("_c")).otherwise(F.array("content"))).alias("_n", "content"))
    return rows.select(F.when(F.col("_s"), F.concat_ws("#", "document_id", "_n")).otherwise(F.col("document_id")).alias("unit_id"), "document_id", "agent_id", "skill_id", "title", "content")


def scope_docs(units: DataFrame, agent: str, skills: list[str] | None = None, include_skills: bool = False) -> DataFrame:
    """An agent's units: with all skills, or those without a skill or with one of the list."""
    own = units.where(F.col("agent_id") == agent)
    return own if include_skills else own.where(F.col("skill_id").isNull() | F.col("skill_id").isin(skills or []))


def word_lexemes(words: DataFrame, english: bool = True) -> DataFrame:
    """(word, lexeme, weight) of distinct words: the word itself and, in the English vocabulary, its stem; weight 2 where they are one."""
    own = F.array(F.struct(F.col("word").alias("lexeme"), F.lit(1).alias("weight")))
    if not english:
        return words.select("word", F.explode(own).alias("x")).select("word", "x.*")
    stemmed = words.withColumn("_s", tx.stem_of("word"))
    both = F.when(F.col("_s").isNull(), own).when(F.col("_s") == F.col("word"), F.array(F.struct(F.col("word").alias("lexeme"), F.lit(2).alias("weight"))))
    return stemmed.select("word", F.explode(both.otherwise(F.concat(own, F.array(F.struct(F.col("_s").alias("lexeme"), F.lit(1).alias("weight")))))).alias("x")).select("word", "x.*")


def lexeme_counts(rows: DataFrame, key: str, text: Column, english: bool = True) -> DataFrame:
    """The inverted index (key, lexeme, tf), both vocabularies summed, as the stored search vector concatenates them.

    A row's lexemes are counted where its text is read (Spark's own words, numbered, stemmed once and counted in numpy, an Arrow batch at a time), so one shuffle
    of counts is left, for rows that share a key.
    """
    words = rows.select(F.col(key), F.coalesce(tx.words_of(text), F.array()).alias("words"))
    if not english:
        return words.select(key, F.explode("words").alias("lexeme")).groupBy(key, "lexeme").agg(F.count("*").alias("tf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, at, lexeme, tf = tx.count_lexemes(b.column("words"))
            for lo in range(0, len(at), COUNTED):
                part = slice(lo, lo + COUNTED)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[part])), names.take(pa.array(lexeme[part])), pa.array(tf[part])], names=[key, "lexeme", "tf"])

    counted = words.mapInArrow(run, f"`{key}` {dict(words.dtypes)[key]}, lexeme string, tf long")
    return counted.groupBy(key, "lexeme").agg(F.sum("tf").alias("tf"))


def occurrence_score(tf: Column) -> Column:
    """The rank of one lexeme by its occurrences, from a table of partial sums."""
    sums, total = [], 0.0
    for j in range(1, MOST_POSITIONS + 1):
        total += 1 / j**2
        sums.append(RANK_WEIGHT * total / RANK_LIMIT)
    return F.element_at(F.array(*[F.lit(x) for x in sums]), F.least(tf, F.lit(MOST_POSITIONS)).cast("int"))


def search(units: DataFrame, queries: DataFrame, k: int = 6, english: bool = True) -> DataFrame:
    """The k best units of every query: (query_id, unit_id, rank, position).

    units: unit_id, agent_id, title, content; queries: query_id, agent_id, question. A unit matches if it
    has any lexeme of the question in either vocabulary. Its rank under a vocabulary is the sum of
    its lexemes' scores over the number of the question's lexemes; the greater one counts.
    Distinct words are stemmed once; of a unit's words only those that an agent's questions ask for are shuffled: where these are at most SMALL they go
    to the units, else a unit's words are counted before they meet them.
    """
    k = min(max(k, 1), 20)
    words = tx.words_of(F.col("question"))
    vocabularies = [("simple", words)] + ([("english", tx.stems(words))] if english else [])
    asked = None
    for name, ws in vocabularies:
        own = queries.select("query_id", "agent_id", F.lit(name).alias("vocabulary"), F.array_distinct(ws).alias("ws"))
        own = own.select("query_id", "agent_id", "vocabulary", F.size("ws").alias("n"), F.explode("ws").alias("lexeme"))
        asked = own if asked is None else asked.unionByName(own)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    words = units.select("unit_id", "agent_id", F.explode(tx.words_of(text)).alias("word"))
    wanted = asked.select("agent_id", "lexeme").distinct()
    if english:
        meant = word_lexemes(words.select("word").distinct())
    else:
        meant = wanted.select(F.col("lexeme").alias("word")).distinct().transform(word_lexemes, False)
    meant = meant.join(wanted, "lexeme").select("agent_id", "word", "lexeme", "weight")
    few = bounded(meant, SMALL)
    words = words.withColumn("_n", F.lit(1)) if few is not meant else words.groupBy("unit_id", "agent_id", "word").agg(F.count("*").alias("_n"))
    index = words.join(few, ["agent_id", "word"]).groupBy("agent_id", "unit_id", "lexeme").agg(F.sum(F.col("weight") * F.col("_n")).alias("tf"))
    hits = index.join(asked, ["agent_id", "lexeme"]).groupBy("query_id", "unit_id", "vocabulary").agg((F.sum(occurrence_score(F.col("tf"))) / F.max("n")).alias("rank"))
    best = hits.groupBy("query_id", "unit_id").agg(F.round(F.max("rank"), 9).alias("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "unit_id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def apply_rewrites(docs: DataFrame, rewrites: DataFrame) -> DataFrame:
    """docs with accepted rewrites: content becomes the joined slices and raw_content the original.

    rewrites: id, slice_index, content. The original stays if it is longer than MOST_REWRITE or the rewrite
    shorter than the smaller of LEAST_CHARS and LEAST_SHARE of it.
    """
    joined = rewrites.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice_index", "content"))), lambda x: F.trim(x["content"])), "\n\n").alias("_new"))
    size = F.length("content")
    good = F.col("_new").isNotNull() & (size <= MOST_REWRITE) & (F.length("_new") >= F.least(F.lit(LEAST_CHARS), size * LEAST_SHARE))
    out = docs.join(joined, "id", "left").withColumn("normalized", F.coalesce(good, F.lit(False)))
    return out.withColumn("raw_content", F.when(F.col("normalized"), F.col("content"))).withColumn("content", F.when(F.col("normalized"), F.col("_new")).otherwise(F.col("content"))).drop("_new")


def restore_originals(docs: DataFrame) -> DataFrame:
    """The original text back, where one is kept."""
    return docs.withColumns({"content": F.coalesce("raw_content", "content"), "raw_content": F.lit(None).cast("string"), "normalized": F.lit(False)})


def document_list(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parents with their chunk count and whether an original is kept."""
    n = chunks.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("chunks"))
    original = F.col("raw_content").isNotNull() if "raw_content" in docs.columns else F.lit(False)
    return docs.join(n, "id", "left").select("id", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"), original.alias("has_original"))


def backfill_report(docs: DataFrame) -> DataFrame:
    """Per document: characters, chunks it would have, and whether it may be rewritten (not crawled, not too long)."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: len(tx.chunk_text(t))), "int")
    n = cut("content")
    return docs.select("id", F.length("content").alias("chars"), F.when(n > 1, n).otherwise(0).alias("chunks"), ((F.col("source_type") != "crawl") & (F.length("content") <= MOST_REWRITE)).alias("eligible"))


def build_contexts(bots: DataFrame, hits: DataFrame, as_of: str, zone: str = "Asia/Jerusalem") -> DataFrame:
    """Prompt of every agent: base, notice, retrieved passages in order, date block last. bots: id, base_prompt, notice; hits: agent_id, position, title, content."""
    passages = hits.groupBy(F.col("agent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "title", "content"))), lambda p: F.concat(F.lit("["), p["title"], F.lit("]\n"), p["content"])).alias("_p"))
    local = F.from_utc_timestamp(F.lit(as_of).cast("timestamp_ntz"), zone)
    parts = F.array(F.col("base_prompt"), F.col("notice"), F.array_join("_p", "\n\n"), F.date_format(local, "'Today is' EEEE, yyyy-MM-dd HH:mm"))
    return bots.join(passages, "id", "left").select("id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n").alias("prompt"))
