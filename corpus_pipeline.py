"""The corpus pipeline: documents in, a deduplicated, decontaminated and mixed corpus out.

Every stage works on all rows that the stage before it kept, written as Parquet below spark.checkpoint.dir and read again;
run() deletes what the stage before wrote as soon as a stage has ended, so two copies exist at most. All stages but the
last return the columns of documents as they are, extra ones included, whatever their names.

Null text: rejected by language_id, as are empty texts and those without a letter, for no language can be told. Null
doc_id: passes language_id, dedup and decontamination, which need an id to remove a row, and is left out by mix, which
samples documents by id. Null lang: takes no part in training, is judged like the others. Null source: a source of its
own. Very long texts are read whole by every stage. Ties: of equal or similar documents the least doc_id stays. Repeated
rows (the same doc_id and text) are one document, kept or removed together. An empty documents table, or one without a
labelled row, gives an empty result; an empty benchmark table removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm import op2_ngram_join, op7_langid, op8_mixing, op9_exact_dedup, op10_decontam, shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; trained on the labelled rows of its own input."""
    return op7_langid.identified(docs, op7_langid.training_texts(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return op9_exact_dedup.exact_duplicates_removed(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op2_ngram_join.near_duplicates_removed(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op10_decontam.contaminated_removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample in which every source has the same weight as far as its documents reach."""
    return op8_mixing.mixed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: Cross-parsing and the cube method have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared.fresh_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            shared.remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
