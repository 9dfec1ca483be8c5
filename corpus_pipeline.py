"""From raw documents to packed training sequences, in five stages.

What holds for all stages but the last: the result has the columns of ``docs``, also extra ones with any name (dots,
names that the operators use themselves), and rows with a null doc_id are never taken for copies of each other. An
empty table gives an empty one. Texts are read whole, whatever their length. Only executors' tasks see texts; what
reaches the driver is named in each operator.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spendloom.llm.mixing import mixed_documents
from spendloom.llm.near_dedup import without_near_duplicates
from spendloom.llm.packing import pack_documents
from spendloom.llm.quality import without_low_quality
from spendloom.llm.repeats import without_repeats
from spendloom.sources.shared import remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more).

    A null or empty text is scored as a window of padding and stays or goes as that score says; equal texts score
    alike, so repeated rows stay or go together. Without labels of both kinds all scores are 0.5 and all rows stay.
    """
    return without_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows with equal doc_id and text count once; rows with equal doc_id and different texts are different documents.
    Null, empty and blank texts and rows without a doc_id are copies of nothing and stay.
    """
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document (smaller doc_id) has.

    n_chars is counted anew where a text changes; a document that is left without a word goes. Null, empty and blank
    texts and rows without a doc_id stay as they are; rows with equal doc_id and text lose the same passages.
    """
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights take them, copies as rows of their own.

    A null source is the last source. A null or blank text has no words and is never taken. Rows with equal doc_id and
    size are taken alike; ties at a quota's end are decided by a seeded hash, so reruns agree.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences.

    A null or empty text is the end id alone; each row is packed, repeated ones too; a null doc_id stays null. Of the
    columns of ``docs`` only doc_id and text are used.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: No stage but the mixing could be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    A stage's output is removed when the next one is written; the last one read stays, since the result depends on it.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if read:
            remove(spark, read)
        read = f"{base}/{name}"
        docs = spark.read.parquet(read)
    return STAGES[-1][1](spark, docs, sf_dir)
