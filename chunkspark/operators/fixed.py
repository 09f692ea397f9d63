"""Chunks of a fixed number of characters or words: closed forms over Spark's own functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import overlap_units, windows, words
from .base import Splitter


class _Stepped(Splitter):
    def __init__(self, chunk_size: int, chunk_overlap: float | int = 0, on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.chunk_overlap = chunk_overlap
        self.overlap = overlap_units(chunk_overlap, chunk_size)
        if self.overlap >= chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
        self.step = chunk_size - self.overlap

    def params(self) -> dict[str, Any]:
        return super().params() | {"chunk_overlap": self.chunk_overlap}


class CharacterSplitter(_Stepped):
    """Characters [start, start + chunk_size) for each start 0, step, 2 * step, ... inside the text."""

    method = "character_splitter"

    def __init__(self, chunk_size: int = 1000, chunk_overlap: float | int = 0, on_empty: str = "fail"):
        super().__init__(chunk_size, chunk_overlap, on_empty)

    def split_text(self, text: str | None) -> list[str]:
        return [text[i : i + self.chunk_size] for i in range(0, len(text or ""), self.step)]

    def chunks(self, docs: DataFrame) -> Column:
        # One pass cuts pieces of `step` characters; a chunk is its piece and as much of the next ones as it overlaps.
        # (A substring from each start would read the text from its beginning every time.)
        pieces = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"(?s).{{1,{self.step}}}"), F.lit(0))
        if self.step == self.chunk_size:
            return pieces
        if self.step > self.chunk_size:  # a negative overlap leaves text out
            return F.transform(pieces, lambda p: F.left(p, F.lit(self.chunk_size)))
        n = -(-self.chunk_size // self.step)
        return F.flatten(
            F.transform(
                F.array(pieces),
                lambda all_: F.transform(all_, lambda p, i: F.left(F.array_join(F.slice(all_, i + 1, F.lit(n)), ""), F.lit(self.chunk_size))),
            ),
        )


class WordSplitter(_Stepped):
    """The same over words, joined by one space."""

    method = "word_splitter"

    def __init__(self, chunk_size: int = 5, chunk_overlap: float | int = 0, on_empty: str = "fail"):
        super().__init__(chunk_size, chunk_overlap, on_empty)

    def split_text(self, text: str | None) -> list[str]:
        all_words = (text or "").split()
        return [" ".join(all_words[i : i + self.chunk_size]) for i in range(0, len(all_words), self.step)]

    def chunks(self, docs: DataFrame) -> Column:
        all_words = words(F.coalesce(F.col("text"), F.lit("")))
        # Bound once: the array is used for the starts and for each slice.
        return F.transform(F.flatten(F.transform(F.array(all_words), lambda w: windows(w, self.chunk_size, self.step))), lambda w: F.array_join(w, " "))
