"""Sentences, paragraphs, pages and keyword cuts. Without overlap they are Spark expressions; overlap repeats text of
the chunk given out before, which is a fold and runs in Python batches."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.native import prose
from ..functions.text import SPACE, is_blank, literal_split, strip, windows
from .base import STRINGS, Splitter, python_array


def _joined(items: Column, size: int, joint: str) -> Column:
    return F.transform(windows(items, size, size), lambda w: F.array_join(w, joint))


class SentenceSplitter(Splitter):
    """chunk_size sentences a chunk, after the last words of the chunk before. A float overlap is a share of the words
    in the document's longest sentence. separators: a regular expression, or a list of literals."""

    method = "sentence_splitter"
    empty_is_chunk = True

    def __init__(self, chunk_size: int = 5, chunk_overlap: float | int = 0, separators: str | list[str] = prose.SENTENCE_END, on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        if chunk_overlap < 0:
            raise ValueError("chunk_overlap must not be negative")
        self.chunk_overlap, self.separators = chunk_overlap, separators

    def params(self) -> dict[str, Any]:
        return super().params() | {"chunk_overlap": self.chunk_overlap, "separators": self.separators}

    def split_text(self, text: str | None) -> list[str]:
        return prose.with_word_overlap(prose.sentences(text, self.separators), self.chunk_size, self.chunk_overlap, " ", " ")

    def sentence_array(self, text: Column) -> Column:
        """Sentences by marks around each end: text <1><5>end<2>, cut at <2>, white space before <1><5> goes. The characters 1
        and 2 of the text itself become <1><3> and <1><4> meanwhile."""
        replace = lambda x, old, new: F.replace(x, F.lit(old), F.lit(new))
        ends = prose.sentence_pattern(self.separators)
        escaped = replace(replace(text, "\x01", "\x01\x03"), "\x02", "\x01\x04")
        marked = F.regexp_replace(escaped, f"({ends})", "\x01\x05$1\x02")
        parts = F.transform(F.split(marked, "\x02"), lambda p: strip(F.regexp_replace(strip(p), f"{SPACE}*\x01\x05", "")))
        return F.transform(F.array_remove(parts, ""), lambda p: replace(replace(p, "\x01\x04", "\x02"), "\x01\x03", "\x01"))

    def chunks(self, docs: DataFrame) -> Column:
        literals = isinstance(self.separators, list) and not any(mark in s for s in self.separators for mark in "\x01\x02\x03\x04\x05")
        if self.chunk_overlap or not literals and self.separators != prose.SENTENCE_END:
            return python_array(self.split_text)(F.col("text"))
        items = self.sentence_array(F.coalesce(F.col("text"), F.lit("")))
        return F.flatten(F.transform(F.array(items), lambda s: _joined(s, self.chunk_size, " ")))


class ParagraphSplitter(Splitter):
    """chunk_size paragraphs a chunk, joined by the first line break. Blank paragraphs are dropped, others kept as they are."""

    method = "paragraph_splitter"

    def __init__(self, chunk_size: int = 3, chunk_overlap: float | int = 0, line_break: str | list[str] = "\n", on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.chunk_overlap = chunk_overlap
        self.line_break = [line_break] if isinstance(line_break, str) else list(line_break)

    def params(self) -> dict[str, Any]:
        return super().params() | {"chunk_overlap": self.chunk_overlap, "line_break": self.line_break}

    def split_text(self, text: str | None) -> list[str]:
        paragraphs = [p for p in re.split("|".join(map(re.escape, self.line_break)), text or "") if p.strip()]
        return prose.with_word_overlap(paragraphs, self.chunk_size, self.chunk_overlap, self.line_break[0], self.line_break[0])

    def chunks(self, docs: DataFrame) -> Column:
        if self.chunk_overlap:
            return python_array(self.split_text)(F.col("text"))
        items = F.filter(literal_split(F.coalesce(F.col("text"), F.lit("")), self.line_break), lambda p: ~is_blank(p))
        return F.flatten(F.transform(F.array(items), lambda p: _joined(p, self.chunk_size, self.line_break[0])))


class PagedSplitter(Splitter):
    """Pages between the document's page placeholder, stripped, chunk_size a chunk, joined by line feeds, after the last
    characters of the chunk before. A text without its placeholder is an error."""

    method = "paged_splitter"

    def __init__(self, chunk_size: int = 1, chunk_overlap: int = 0, on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        if chunk_size < 1:
            raise ValueError("chunk_size must be 1 or more")
        if chunk_overlap < 0:
            raise ValueError("chunk_overlap must not be negative")
        self.chunk_overlap = chunk_overlap

    def params(self) -> dict[str, Any]:
        return super().params() | {"chunk_overlap": self.chunk_overlap}

    def split_pages(self, text: str | None, placeholder: str | None) -> list[str]:
        return prose.with_character_overlap(prose.pages(text or "", placeholder or ""), self.chunk_size, self.chunk_overlap)

    def chunks(self, docs: DataFrame) -> Column:
        mark = F.col("page_placeholder")
        present = F.coalesce(F.contains(F.col("text"), mark) & (mark != ""), F.lit(False))
        missing = F.raise_error(F.lit("The text has no page placeholder")).cast(STRINGS)
        cut = F.split(F.col("text"), F.concat(F.lit("\\Q"), mark, F.lit("\\E")))
        pages = F.array_remove(F.transform(cut, strip), "")
        if not self.chunk_overlap:
            return F.when(present, F.flatten(F.transform(F.array(pages), lambda p: _joined(p, self.chunk_size, "\n")))).otherwise(missing)
        k = self.chunk_overlap
        group = F.flatten(F.transform(F.array(pages), lambda p: _joined(p, self.chunk_size, "\n")))
        # The last k characters of a chunk are those of all pages up to it, joined: where the chunk before has fewer than k,
        # they come from k chunks at most, as none is empty. So no chunk waits for the one before.
        joined = lambda g, i: F.array_join(F.transform(F.slice(g, F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k))), lambda t: F.right(t, F.lit(k))), "")
        tail = lambda g, i: F.right(F.when(F.length(F.get(g, i - 1)) >= k, F.get(g, i - 1)).otherwise(joined(g, i)), F.lit(k))
        with_tails = F.transform(F.array(group), lambda g: F.transform(g, lambda x, i: F.when(i > 0, F.concat(tail(g, i), x)).otherwise(x)))
        return F.when(present, F.flatten(with_tails)).otherwise(missing)


class KeywordSplitter(Splitter):
    """Cuts at matches of patterns; the match goes before (to the end of the chunk before it), after, to both, or to none.
    Chunks are wrapped to chunk_size. Their metadata has the reader's, and the matches' counts and spans."""

    method = "keyword"
    empty_is_chunk = True

    def __init__(
        self,
        patterns: list[str] | dict[str, str],
        *,
        flags: int = 0,
        include_delimiters: str = "before",
        chunk_size: int = 100_000,
        on_empty: str = "fail",
    ):
        super().__init__(chunk_size, on_empty)
        if include_delimiters not in ("none", "before", "after", "both"):
            raise ValueError("include_delimiters must be none, before, after or both")
        self.patterns, self.flags, self.include_delimiters = patterns, int(flags), include_delimiters
        re.compile(prose.named_pattern(patterns)[0], self.flags)

    def params(self) -> dict[str, Any]:
        return super().params() | {"patterns": self.patterns, "flags": self.flags, "include_delimiters": self.include_delimiters}

    def split_text(self, text: str | None) -> list[str]:
        return prose.keyword_cut(text, self.patterns, self.flags, self.include_delimiters, self.chunk_size).chunks

    def prepare(self, docs: DataFrame) -> DataFrame:
        """One pass gives the chunks and the matches."""
        fixed = {
            "include_delimiters": self.include_delimiters,
            "flags": self.flags,
            "pattern_names": prose.named_pattern(self.patterns)[1],
            "chunk_size": self.chunk_size,
        }
        patterns, flags, delimiters, size = self.patterns, self.flags, self.include_delimiters, self.chunk_size

        @F.pandas_udf("chunks array<string>, metadata string")
        def cut(texts: pd.Series, old: pd.Series) -> pd.DataFrame:
            out = []
            for text, metadata in zip(texts, old, strict=True):
                c = prose.keyword_cut(text, patterns, flags, delimiters, size)
                matches = {"counts": c.counts, "spans": c.spans} | fixed
                out.append((c.chunks, json.dumps((json.loads(metadata) if metadata else {}) | {"keyword_matches": matches}, ensure_ascii=False)))
            return pd.DataFrame(out, columns=["chunks", "metadata"])

        return docs.withColumn("__cut", cut("text", "metadata")).withColumn("__chunks", F.col("__cut.chunks"))

    def metadata(self) -> Column:
        return F.col("__cut.metadata")
