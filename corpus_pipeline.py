"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Every stage takes documents (null, empty and very long texts, repeated rows and an empty table too) and all but the last
return the columns of documents, in any order of rows; more columns, whatever their names, are left out. Each stage
reads what the one before has written, so its input gives the same rows each time it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliate.llm import decontamination, language_id, packing, secrets, simhash
from foliate.llm.base import DOC_COLUMNS, table
from foliate.sources.shared import delete, scratch, shared_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null, empty and letterless texts among them. Equal texts go or stay alike."""
    return language_id.known_language(docs.select(*DOC_COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least id, nulls last; of equal ids one row. Null and empty texts are a group."""
    return simhash.one_of_each(docs.select(*DOC_COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight consecutive words of a benchmark item, or two whole shorter items, go. Null and empty texts
    stay; ties and repeated rows are decided each by its own text."""
    return decontamination.without_leaks(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are masked and n_chars follows. Null and empty texts stay as they are."""
    return secrets.redacted(docs.select(*DOC_COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secrets", secret_masks),
    ("packing", sequences),
]

#: Tokenizers, trained statistics and fingerprints have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written. What a stage wrote for itself goes when
    its result is written, that result when the next one is; the table that the last stage reads stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
