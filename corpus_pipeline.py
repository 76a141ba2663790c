"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Every stage takes documents(doc_id, text, source, lang, ...) with any further columns, of any names, and keeps them; ids
may be null or repeat, rows may repeat, texts may be null, empty or of any length, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import near_copies as copies
from frameloom.llm import op1_langid, op3_decontaminate, op5_mix, op10_secrets
from frameloom.llm.common import scratch, small_batches, table, tidy


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: no letters, or hardly an n-gram of any language learned from the labelled ones.

    Null and empty texts go; where no row has a language, nothing is learned and all rows go.
    """
    small_batches(spark)
    return op1_langid.of_known_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each component of Jaccard similarities of 0.8 or more on five-word shingles.

    Candidates are linked by the fingerprints and the index of op7_simhash, and by MinHash where these differ in more than three bits.
    Null ids come last; of rows equal in id and text one stays; texts without words, null ones too, are copies of each other.
    """
    small_batches(spark)
    return copies.without_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each row by its own text; null and empty texts stay."""
    return op3_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and counts n_chars anew where it is a column; documents stay, null texts as null."""
    return op10_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and how often each is taken: size, source_size, target, rate, copies, taken replace columns of these names.

    Null sources are a source, the last; texts without words are taken 0 times.
    """
    return op5_mix.mixed(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("secrets", secrets), ("mixing", mixing)]

#: Trained filters, components and Newton steps aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
