"""What all splitters share: the envelope, chunk ids, and documents without chunks."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import CHUNK, ON_EMPTY, as_documents, uuid_of

STRINGS = T.ArrayType(T.StringType())


class Splitter:
    """Turns documents into chunk rows: `df.transform(splitter.transform)`. Lazy; needs no shuffle unless said.

    A subclass gives `chunks()`, an array column over the document's columns, or `split_text()`, which runs on whole
    batches in Python. on_empty: what to do with a document that has no chunk: fail, drop it, or emit one empty chunk.
    """

    method = ""
    #: Whether no chunk is an error of the method itself, or the method gives one empty chunk.
    empty_is_chunk = False

    def __init__(self, chunk_size: int = 1000, on_empty: str = "fail"):
        if on_empty not in ON_EMPTY:
            raise ValueError(f"on_empty must be one of {ON_EMPTY}")
        self.chunk_size, self.on_empty = chunk_size, on_empty

    def params(self) -> dict[str, Any]:
        return {"chunk_size": self.chunk_size}

    def split_text(self, text: str | None) -> list[str]:
        raise NotImplementedError

    def chunks(self, docs: DataFrame) -> Column:
        return python_array(self.split_text)(F.col("text"))

    def prepare(self, docs: DataFrame) -> DataFrame:
        """The documents with `__chunks`."""
        return docs.withColumn("__chunks", self.chunks(docs))

    def metadata(self) -> Column:
        """Metadata of a document's chunks, from the prepared row."""
        return F.lit("{}")

    def split_params(self) -> Column:
        return F.lit(json.dumps(self.params(), ensure_ascii=False, default=str))

    def transform(self, docs: DataFrame) -> DataFrame:
        d = as_documents(docs)
        d = d.withColumn(
            "document_id",
            F.when(
                F.coalesce(F.col("document_id"), F.lit("")) != "", F.col("document_id"),
            ).otherwise(uuid_of(F.col("document_name"), F.col("document_path"), F.col("text"))),
        )
        d = self.prepare(d)
        empty = F.coalesce(F.size("__chunks"), F.lit(0)) <= 0
        one = F.array(F.lit(""))
        if self.empty_is_chunk or self.on_empty == "emit":
            d = d.withColumn("__chunks", F.when(empty, one).otherwise(F.col("__chunks")))
        elif self.on_empty == "fail":
            d = d.withColumn(
                "__chunks",
                F.when(
                    empty, F.raise_error(F.concat(F.lit("Chunks list cannot be empty: document "), F.col("document_id"))).cast(STRINGS),
                ).otherwise(F.col("__chunks")),
            )
        d = d.withColumn("split_method", F.lit(self.method)).withColumn("split_params", self.split_params()).withColumn("metadata", self.metadata())
        carried = [c for c in CHUNK.names[:9]]
        # The outer form, as for the plain one the optimizer adds a filter that computes the chunks a second time.
        out = d.select(*carried, F.posexplode_outer("__chunks").alias("chunk_index", "chunk")).where("chunk_index IS NOT NULL")
        return out.select(
            *carried,
            "chunk_index",
            uuid_of(F.col("document_id"), F.col("split_method"), F.col("split_params"), F.col("chunk_index")).alias("chunk_id"),
            "chunk",
        )


def python_array(split: Callable[[str | None], list[str]]) -> Callable[..., Column]:
    """A batch function text -> array of strings."""

    @F.pandas_udf(STRINGS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(split)

    return run


def python_array_of(split: Callable[..., list[str]]) -> Callable[..., Column]:
    """A batch function of several string columns -> array of strings."""

    @F.pandas_udf(STRINGS)
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([split(a, b) for a, b in zip(first, second, strict=True)], dtype=object)

    return run
