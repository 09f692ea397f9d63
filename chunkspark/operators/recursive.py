"""Splitting by separators from coarse to fine: plain text, source code, and text measured in tokens."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..functions import tokens
from ..functions.native import packing
from ..functions.text import overlap_units
from .base import Splitter


class RecursiveCharacterSplitter(Splitter):
    """A float overlap is measured against chunk_size when it is checked, but used as it is, as a number of characters
    below one, so it has no effect; scale_float_overlap makes it the share of chunk_size that it looks like."""

    method = "recursive_character_splitter"

    def __init__(
        self,
        chunk_size: int = 1000,
        chunk_overlap: float | int = 0.1,
        separators: list[str] | None = None,
        *,
        scale_float_overlap: bool = False,
        on_empty: str = "fail",
    ):
        super().__init__(chunk_size, on_empty)
        self.chunk_overlap = chunk_overlap
        self.separators = list(packing.DEFAULT_SEPARATORS if separators is None else separators)
        scaled = overlap_units(chunk_overlap, chunk_size)
        if scaled >= chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
        self.used_overlap = scaled if scale_float_overlap else chunk_overlap

    def params(self) -> dict[str, Any]:
        return super().params() | {"chunk_overlap": self.chunk_overlap, "separators": self.separators}

    def split_text(self, text: str | None) -> list[str]:
        return packing.split_by_separators(text, self.chunk_size, self.used_overlap, self.separators) if text else []


class CodeSplitter(Splitter):
    method = "code_splitter"

    def __init__(self, chunk_size: int = 1000, language: str = "python", on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.language = language
        self.separators = packing.code_separators(language)

    def params(self) -> dict[str, Any]:
        return super().params() | {"language": self.language}

    def split_text(self, text: str | None) -> list[str]:
        return packing.split_by_separators(text, self.chunk_size, 0, self.separators, is_regex=True) if text else []


class TokenSplitter(Splitter):
    """model_name is 'backend/model'. Backends tiktoken and regex measure tokens; spacy and nltk cut sentences, packed by
    characters. Other backends can be registered (`tokens.register`). A backend that is not there is an error; nothing
    is downloaded."""

    method = "token_splitter"

    def __init__(self, chunk_size: int = 1000, model_name: str = "tiktoken/cl100k_base", language: str = "english", on_empty: str = "fail"):
        super().__init__(chunk_size, on_empty)
        self.model_name, self.language = model_name, language
        self.backend = tokens.backend(model_name, language)
        self._ready: Callable | None = None

    def params(self) -> dict[str, Any]:
        return super().params() | {"model_name": self.model_name, "language": self.language}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def split_text(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._ready is None:  # once a worker
            self._ready = self.backend.load()
        if self.backend.kind == "length":
            return packing.split_by_separators(text, self.chunk_size, 0, ["\n\n", "\n", " ", ""], length=self._ready)
        return packing.pack(self._ready(text), self.chunk_size, 0, "\n\n")
