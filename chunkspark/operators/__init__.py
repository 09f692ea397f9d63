"""Splitters: documents in, one row a chunk out."""

from .base import Splitter
from .fixed import CharacterSplitter, WordSplitter
from .html import HTMLTagSplitter
from .markup import HeaderSplitter, RecursiveJSONSplitter
from .prose import KeywordSplitter, PagedSplitter, ParagraphSplitter, SentenceSplitter
from .recursive import CodeSplitter, RecursiveCharacterSplitter, TokenSplitter
from .semantic import SemanticSplitter
from .tables import RowColumnSplitter

__all__ = [
    "CharacterSplitter",
    "CodeSplitter",
    "HTMLTagSplitter",
    "HeaderSplitter",
    "KeywordSplitter",
    "PagedSplitter",
    "ParagraphSplitter",
    "RecursiveCharacterSplitter",
    "RecursiveJSONSplitter",
    "RowColumnSplitter",
    "SemanticSplitter",
    "SentenceSplitter",
    "Splitter",
    "TokenSplitter",
    "WordSplitter",
]
