"""The training-data pipeline: stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratewise.llm import contamination, jaccard, language, packing, substrings
from ratewise.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
BATCH_BYTES = "8m"


def bounded(spark: SparkSession) -> None:
    """Batches of whole texts go to Python by bytes, so that two workers and the JVM share an executor of a few GB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned from the labelled ones, with a posterior of at least ``LEAST_SCORE``.

    Texts that are null or have no letter go. A label never decides: it is only learned from, outside the held-out fifth.
    """
    bounded(spark)
    fitted = language.train(docs.filter(~language.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    rest = {c: F.col(c) for c in COLUMNS[1:]}
    named = language.identify(docs, fitted, others=rest)
    return named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the row with the least id stays; one without an id only where none has one.

    Rows are judged by their own texts, whatever their ids; of rows with the same id (or none) and text the least stays. A
    key that two different rows share by chance keeps both of them.
    """
    bounded(spark)
    named = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = jaccard.near_duplicates(named, threshold=0.8, size=5, id_col="key")
    ids = named.select("key", "doc_id").distinct()
    classes = found.select("key", "class_id").distinct().join(ids, "key")
    stays = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("least")).select("least.key").distinct()
    kept = named.select("key", "doc_id", "text", F.struct(*COLUMNS).alias("row")).join(stays, "key", "left_semi")
    # The rows of a key already lie together here.
    return kept.groupBy("key", "doc_id", "text").agg(F.min("row").alias("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of 20-word passages that start earlier in the corpus; texts without such words stay as they are."""
    bounded(spark)
    done = substrings.remove_repeats(docs, window=20, keep=["lang", "source", "n_chars"])
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text")
    return done.select("doc_id", text, "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words at least one in twenty lies in a 13-word window of the benchmark go, whatever their ids.

    The verdict is a function of the text alone, so rows are named by their texts' hashes; a hash that texts of both verdicts share
    by chance is no reason to go.
    """
    bounded(spark)
    keyed = docs.withColumn("key", F.xxhash64("text"))
    found = contamination.contamination(spark, keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, id_col="key")
    bad = found.groupBy("key").agg(F.bool_and("contaminated").alias("bad")).filter("bad").select("key")
    return keyed.join(bad, "key", "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's place in bins of 4096 ids, one text per source and copy group in a bin."""
    bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
# Language identification and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    bounded(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
