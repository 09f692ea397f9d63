"""Markdown or HTML by headings, and JSON by size."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.native import html, packing, structured
from .base import Splitter, python_array_of


class HeaderSplitter(Splitter):
    """Sections under the named headings ('Header 1' to 'Header 6'; all if none are named). HTML is turned into Markdown
    first; a text without headings is split by separators with a small overlap."""

    method = "header_splitter"

    def __init__(self, chunk_size: int = 1000, headers_to_split_on: list[str] | None = None, *, group_header_with_content: bool = True, on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.headers = headers_to_split_on or [f"Header {k}" for k in range(1, 7)]
        self.levels = {structured.header_level(h) for h in self.headers}
        self.group = group_header_with_content

    def params(self) -> dict[str, Any]:
        return super().params() | {"headers_to_split_on": self.headers, "group_header_with_content": self.group}

    def split_named(self, text: str | None, name: str | None) -> list[str]:
        if not text:
            raise ValueError("the text is empty or None")
        if html.looks_like_html(text, name):
            text = html.Markdown().convert(text)
        text = structured.atx_headings(text)
        if re.search(r"(?m)^\s*#{1,6}\s+\S", text):
            return structured.split_by_headers(text, self.levels, self.group)
        return packing.split_by_separators(text, self.chunk_size, min(200, self.chunk_size // 10), ["\n\n", "\n", " ", ""])

    def split_text(self, text: str | None) -> list[str]:
        return self.split_named(text, None)

    def chunks(self, docs: DataFrame) -> Column:
        return python_array_of(self.split_named)(F.col("text"), F.col("document_name"))


class RecursiveJSONSplitter(Splitter):
    """JSON objects of about chunk_size characters; a chunk closes from chunk_size - min_chunk_size on."""

    method = "recursive_json_splitter"

    def __init__(self, chunk_size: int = 1000, min_chunk_size: int = 200, on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.min_chunk_size = min_chunk_size

    def params(self) -> dict[str, Any]:
        return super().params() | {"min_chunk_size": self.min_chunk_size}

    def split_text(self, text: str | None) -> list[str]:
        return structured.split_json(json.loads(text), self.chunk_size, self.chunk_size - self.min_chunk_size) if text else []
