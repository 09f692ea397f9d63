"""HTML by elements."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.native import html
from .base import Splitter


class HTMLTagSplitter(Splitter):
    """Chunks of the elements named tag, or of the most frequent element. batch: several to a chunk, up to chunk_size
    characters of HTML (0 or 1: all in one); rows and cells are then grouped by their table, each chunk with its head."""

    method = "html_tag_splitter"
    empty_is_chunk = True

    def __init__(self, chunk_size: int = 1, tag: str | None = None, *, batch: bool = True, to_markdown: bool = True, on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.tag, self.batch, self.to_markdown = tag, batch, to_markdown

    def params(self) -> dict[str, Any]:
        return super().params() | {"tag": self.tag, "batch": self.batch, "to_markdown": self.to_markdown}

    def split_text(self, text: str | None) -> list[str]:
        return html.split_by_tag(text, self.tag, self.chunk_size, self.batch, self.to_markdown)[0]

    def prepare(self, docs: DataFrame) -> DataFrame:
        """split_params names the tag that was used, as it may differ by document."""
        tag, size, batch, markdown, params = self.tag, self.chunk_size, self.batch, self.to_markdown, self.params()

        @F.pandas_udf("chunks array<string>, params string")
        def cut(texts: pd.Series) -> pd.DataFrame:
            found = [html.split_by_tag(t, tag, size, batch, markdown) for t in texts]
            return pd.DataFrame({"chunks": [c for c, _ in found], "params": [json.dumps(params | {"tag": t}) for _, t in found]})

        return docs.withColumn("__cut", cut("text")).withColumn("__chunks", F.col("__cut.chunks"))

    def split_params(self) -> Column:
        return F.col("__cut.params")


def html_to_markdown(text: Column, leaks: bool = False) -> Column:
    """HTML as Markdown. leaks: with the text of comments, scripts, styles and the document type."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        markdown = html.Markdown(leaks)
        return texts.map(lambda t: None if t is None else markdown.convert(t))

    return convert(text)


def html_auto_tag(text: Column) -> Column:
    """The element that HTMLTagSplitter takes when none is named."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.auto_tag(html.parse(t or "")))

    return find(text)
