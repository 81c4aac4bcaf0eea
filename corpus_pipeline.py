"""The corpus pipeline: toxicity, language, exact copies, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. Both classifiers learn from the rows that
reach their stage.

Defined results: an empty table gives no sequences. Null, empty and letterless texts are clean
and have no language, so the language stage drops them, unless nothing was learned and they have
a letter. Rows that repeat a doc_id are judged each by their text in the first three stages, where
of equal rows one stays; the near-duplicate stage takes rows of one doc_id for one document. Rows
with a null doc_id are judged alike, but are nobody's near duplicate. Ties go to the smallest
doc_id; further columns, whatever their names, are carried to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenar.llm import exact_dedup, language_id, minhash, packing, toxicity
from lumenar.storage import remove, table, written_at


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those without a letter or with a prediction under ``language_id.LEAST_SCORE``."""
    return language_id.keep_known(docs, language_id.train(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Classifiers and tokenisers have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written_at(stage(spark, docs, sf_dir), name)
        if older:
            remove(spark, older)  # its successor is written
        older = path
    return STAGES[-1][1](spark, docs, sf_dir)
