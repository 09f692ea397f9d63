"""Row types of documents and chunks, deterministic chunk ids, and what to do with a document without chunks."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_STRINGS = ("document_id", "document_name", "document_path", "text", "conversion_method", "reader_method", "ocr_method", "page_placeholder", "metadata")

#: One document a row; metadata is a JSON object.
DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in _STRINGS])

#: One chunk a row; split_params and metadata are JSON objects.
CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("document_id", "document_name", "document_path", "conversion_method", "reader_method", "ocr_method", "split_method", "split_params", "metadata")]
    + [T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("chunk", T.StringType())]
)

ON_EMPTY = ("fail", "drop", "emit")


def as_documents(df: DataFrame, text: str = "text", document_id: str | None = None, **fixed: str) -> DataFrame:
    """Any DataFrame with a text column as documents; envelope columns that it has are kept, others are null.

    document_id: the column of the id. fixed: constant values for envelope columns.
    """
    have = set(df.columns)

    def column(name: str) -> Column:
        if name in fixed:
            return F.lit(fixed[name])
        if name == "text":
            return F.col(text)
        if name == "document_id" and document_id:
            return F.col(document_id).cast("string")
        if name in have:
            return F.col(name).cast("string")
        return F.lit("{}" if name == "metadata" else None).cast("string")

    return df.select([column(c).alias(c) for c in _STRINGS])


def from_variable(spark: SparkSession, variable: str | dict | list, name: str) -> DataFrame:
    """One document from a string (txt) or from a dict or list, as indented JSON (json)."""
    if isinstance(variable, str):
        text, method = variable, "txt"
    elif isinstance(variable, dict | list):
        text, method = json.dumps(variable, indent=2, ensure_ascii=False), "json"
    else:
        raise ValueError("variable must be a string, a dict or a list")
    details = json.dumps({"details": f"Generated from variable {name}"})
    return spark.createDataFrame(
        [(None, name, "", text, method, "vanilla", None, None, details)], DOCUMENT,
    ).withColumn("document_id", uuid_of(F.lit(name), F.lit(text)))


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id that depends on the parts alone, so a retried task gives the same."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def with_metadata(df: DataFrame, extra: dict[str, Any]) -> DataFrame:
    """Adds entries to the JSON object in `metadata`; the last wins."""

    @F.pandas_udf("string")
    def merge(old: pd.Series) -> pd.Series:
        return old.map(lambda x: json.dumps((json.loads(x) if x else {}) | extra, ensure_ascii=False))

    return df.withColumn("metadata", merge("metadata"))


def collect_chunks(chunks: DataFrame) -> DataFrame:
    """One row a document, with the parallel arrays chunks and chunk_id."""
    carried = [c for c in CHUNK.names[:9]]
    rows = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "chunk")))
    return chunks.groupBy(*carried).agg(rows.alias("r")).select(*carried, F.col("r.chunk").alias("chunks"), F.col("r.chunk_id").alias("chunk_id"))


def from_chunks(spark: SparkSession, chunks: list[str]) -> DataFrame:
    """Chunk rows from plain strings; an empty list is an error."""
    if not chunks:
        raise ValueError("Chunks list cannot be empty.")
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(chunks)], "chunk_index int, chunk string")
    fixed = [F.lit("{}" if c in ("split_params", "metadata") else None).cast("string").alias(c) for c in CHUNK.names[:9]]
    return rows.select(*fixed, "chunk_index", uuid_of(F.col("chunk_index"), F.col("chunk")).alias("chunk_id"), "chunk")
