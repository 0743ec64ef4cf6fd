"""The corpus pipeline: language ID, quality, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
a DataFrame; run() writes each result to the shared folder and reads it again as
the next stage's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from botlake.llm import cdc, langid, minhash, packing, quality
from botlake.llm.graph import discard, gathered, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose best and second language need almost equally many phrases have no language.
LEAST_LANGUAGE_SCORE = 0.02
LEAST_QUALITY = 0.5
#: Rows of an Arrow batch at most.
BATCH_ROWS, BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> str:
    """Whole texts go to the workers and back: small batches bound what executors hold of them. A stage's rows are read after it has returned, so the setting stays; returns what it was."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before))))
    return before


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: those without a letter (null and empty texts too), or alike near to two languages, go.

    Repeated rows are judged one by one, texts of any length whole; ties go by the language that sorts first and are alike near.
    Without labels nothing goes. Columns beside those of documents are dropped; an empty table stays empty.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    references = langid.fit(docs)
    if not references:
        return docs
    out = langid.predict(docs, references)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality LEAST_QUALITY or more; all of them where no labels of two classes exist.

    Null texts are scored as empty ones, null metadata as such, repeated rows one by one, texts of any length whole.
    Columns beside those of documents are dropped; an empty table stays empty.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score(docs, model)
    return out.where(F.coalesce(F.col("quality_score") >= LEAST_QUALITY, F.lit(True))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8): the smallest doc_id, in one row.

    Rows that share an id but not the text are documents of their own; of rows that share both the first by the other
    columns stays. Rows without an id all stay. Texts without words are no one's duplicates. Columns beside those of
    documents are dropped; an empty table stays empty.
    """
    small_batches(spark)
    docs = row_keys(docs.select(*COLUMNS))
    found = minhash.near_duplicates(docs, key="k")
    gone = found.where(~F.col("kept")).select("k").distinct()
    kept = docs.where(F.col("k").isNotNull()).join(gone, "k", "left_anti")
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("source", "lang", "n_chars"))).where("n = 1")
    return first.select(*COLUMNS).unionByName(docs.where(F.col("k").isNull()).select(*COLUMNS))


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with k: the doc_id, and for the second and further texts of an id a number past all ids of its own."""
    digest = F.xxhash64("text")
    versions = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("doc_id", "low")
    if versions.isEmpty():
        return docs.withColumn("k", F.col("doc_id").cast("long"))
    own = F.xxhash64("doc_id", digest).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.join(versions, "doc_id", "left").withColumn("k", F.when(F.col("low") != digest, own).otherwise(F.col("doc_id").cast("long"))).drop("low")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id has too; n_chars is that of the new text, and texts of which nothing is left go.

    Null and empty texts and rows without an id stay as they are; rows that share an id lose nothing to each other.
    Columns beside those of documents are dropped; an empty table stays empty.
    """
    small_batches(spark)
    out = cdc.dedup_substrings(docs.select(*COLUMNS))
    changed = F.size("removed") > 0
    out = out.where(~changed | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids. Null and empty texts are one id, repeated rows are packed one by one, a null id stays null; an empty table has no pieces."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]
#: SQL can't express the automata, the trained model or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other. When a stage's table is written, all that was stored for it is deleted, the stage before included. The session's batch size is put back."""
    before_run = small_batches(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with gathered() as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before, *[table for table in made if table is not docs])
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    spark.conf.set(BATCH, before_run)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
