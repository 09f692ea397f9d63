"""Splitters as table functions in SQL: SELECT ... FROM docs, LATERAL char_split(text, 500, 50)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import CharacterSplitter, CodeSplitter, HeaderSplitter, HTMLTagSplitter, KeywordSplitter, PagedSplitter, ParagraphSplitter, RecursiveCharacterSplitter, RecursiveJSONSplitter, RowColumnSplitter, SemanticSplitter, SentenceSplitter, Splitter, TokenSplitter, WordSplitter
from .embedding import HashedEmbedding

SCHEMA = "chunk_index int, chunk string"


def _function(make: Callable[..., Splitter]):
    class Split:
        def __init__(self) -> None:
            self.made: dict[tuple, Splitter] = {}

        def eval(self, text: str, *arguments) -> Iterator[tuple[int, str]]:
            if arguments not in self.made:
                self.made[arguments] = make(*arguments)
            yield from enumerate(self.made[arguments].split_text(text))

    return udtf(Split, returnType=SCHEMA, useArrow=True)


class _Bound:
    """A splitter of a text and one more value, which is given once."""

    def __init__(self, split: Callable[[str, str], list[str]], value: str):
        self.split, self.value = split, value

    def split_text(self, text: str) -> list[str]:
        return self.split(text, self.value)


FUNCTIONS = {
    "char_split": CharacterSplitter,
    "word_split": WordSplitter,
    "sentence_split": SentenceSplitter,
    "paragraph_split": ParagraphSplitter,
    "recursive_split": RecursiveCharacterSplitter,
    "code_split": CodeSplitter,
    "token_split": TokenSplitter,
    "json_split": RecursiveJSONSplitter,
    "header_split": HeaderSplitter,
    "html_tag_split": HTMLTagSplitter,
    "paged_split": lambda placeholder, *a: _Bound(PagedSplitter(*a).split_pages, placeholder),
    "row_split": lambda method, n, overlap=0: _Bound(lambda t, m: RowColumnSplitter(num_rows=n, chunk_overlap=overlap).split_table(t, m)[0], method),
    "column_split": lambda method, n, overlap=0: _Bound(lambda t, m: RowColumnSplitter(num_cols=n, chunk_overlap=overlap).split_table(t, m)[0], method),
    "semantic_split": lambda size=1000, kind="percentile": SemanticSplitter(HashedEmbedding(), chunk_size=size, breakpoint_threshold_type=kind),
    "keyword_split": lambda pattern, where="before": KeywordSplitter([pattern], include_delimiters=where),
}


def _plain(value):
    """SQL literals with a point are decimals."""
    from decimal import Decimal

    return float(value) if isinstance(value, Decimal) else value


def register(spark: SparkSession) -> list[str]:
    """Registers all table functions and returns their names."""
    for name, make in FUNCTIONS.items():
        spark.udtf.register(name, _function(lambda *a, make=make: make(*map(_plain, a))))
    return list(FUNCTIONS)
