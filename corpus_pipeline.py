"""Documents to training tokens in five stages: quality rules, line dedup, near-dedup, source mix, encoding.

Each stage takes all that its predecessor kept and returns the columns of `documents`; the last returns the encoded
texts: doc_id, ids (pieces of the vocabulary) and score. A document that the mix takes twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkspark.functions.layout import spread
from chunkspark.llm.common import session_ready
from chunkspark.llm.linedup import dedup_lines
from chunkspark.llm.mixing import mixed_documents
from chunkspark.llm.neardup import without_near_duplicates
from chunkspark.llm.pieces import encode_documents
from chunkspark.llm.rules import clean_documents


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their host's boilerplate lines."""
    return _counted(clean_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the blocks of lines that an earlier document has; a document that has nothing else goes."""
    return _counted(dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates; rows are told apart, also by null ids."""
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, documents repeated as often as they are taken."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and score of each text."""
    return encode_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("source_mix", mix), ("encode", encode)]

#: Sampling by the cube method and piece segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_ready(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
