"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, packing, secrets, simhash, toxicity
from millrace.runtime import small_batches, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone; further ones of the input go no further. Workers get them in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the training labels, predicts as toxic go."""
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxic_score(F.col("text"), model) < 0.5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter at all) go; the language of the others is the predicted one.

    Where no row is labelled, no language can be learned: texts with letters stay, as `und`.
    """
    docs = _documents(docs)
    found = docs.withColumn("_p", langid.predict(F.col("text"), langid.fit(docs)))
    found = found.where((F.col("_p.lang_pred") != langid.UNKNOWN) | F.col("text").rlike("\\p{L}"))
    return found.select("doc_id", "text", F.col("_p.lang_pred").alias("lang"), "source", "n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, a row of the least id; repeated rows stay once."""
    return simhash.one_of_each(_documents(docs)).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    out = secrets.redacted(_documents(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document, with its place."""
    return packing.pack_documents(_documents(docs), with_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The stages are trained models and majority fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
