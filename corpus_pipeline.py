"""Corpus preparation: five stages over documents, each written as Parquet and read again by the next.

Quality classifier, near-duplicates, benchmark decontamination, surrogates for personal data, mixing. All but the last return the
columns of documents; the last adds each document's repetitions in the mix and leaves out those with none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontaminate, mixing, neardup, pii, quality
from twinfold.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of all labels, scores 0.5 or more.

    Null and empty texts are scored like any other, by statistics of zero; equal texts have equal scores; without any label all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    Documents without words are linked to equal ones only, rows without an id to none; equal rows stay once.
    """
    return neardup.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item within its edit budget. Null and empty texts hold none and stay; an empty benchmark removes nothing."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars, where there is one, follows the text. Null texts stay null; no row goes."""
    out = pii.replace_entities(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with all their columns, how often they are repeated, and how many words they give.

    Those that the mix leaves out go. Empty texts give no words. Columns of the documents that are named like one of the mix's own give way to it.
    """
    rest = tuple(c for c in docs.columns if c not in mixing.COLUMNS)
    return mixing.mix(docs, keep=rest).filter("epochs > 0")


#: Documents in an Arrow batch of the stages' Python functions, at most: very long ones meet few others in a worker's memory.
ARROW_ROWS = 1000


def _bounded(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session with batches of ARROW_ROWS; the setting stays, as the stage's result is written later."""

    @wraps(f)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        return f(spark, docs, sf_dir)

    return bounded


STAGES = [
    ("quality", _bounded(quality_stage)),
    ("near_duplicates", _bounded(near_duplicate_stage)),
    ("decontamination", _bounded(decontamination_stage)),
    ("pii", _bounded(pii_stage)),
    ("mixing", _bounded(mixing_stage)),
]

#: Models, fingerprints and edit distances are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
