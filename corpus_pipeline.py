"""The corpus pipeline: documents go through the stages in order, each stage works on all that the one before kept.

Stages but the last return the columns they get, extra ones too, whatever their names. Null and empty texts are scored as
zeros by the classifier, and where they stay they are in no group of copies, are clean, have no personal data, and are
packed as the end mark alone. Rows that repeat an id with another text are documents of their own; of rows that repeat id
and text one stays, if they have words. Ids may be null. An empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notegraph.llm import decontaminate, jaccard, packing, pii, quality
from notegraph.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled documents, does not reject."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document: that with the smallest id, see `jaccard.one_of_each`."""
    return jaccard.one_of_each(docs, jaccard.jaccard_components(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; a row goes by its id and text together, null ids too."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return jaccard.with_keys(docs, written(found.select("doc_id", "copy")), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.mask_personal_data(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# Trained models and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
