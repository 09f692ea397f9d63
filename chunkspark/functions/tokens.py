"""Token backends: a length function, or a function that cuts sentences."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial


@dataclass(frozen=True)
class Backend:
    """kind: 'length' (text -> number of tokens) or 'sentences' (text -> list). load() makes the function in a worker."""

    kind: str
    load: Callable[[], Callable]


WORDS_AND_MARKS = re.compile(r"\w+|[^\w\s]")


def _regex(model: str, language: str) -> Backend:
    return Backend("length", lambda: lambda text: len(WORDS_AND_MARKS.findall(text)))


def _tiktoken(model: str, language: str) -> Backend:
    """A named encoding, if its files are here, or the path of a file of ranks."""
    import tiktoken

    if not model.endswith(".tiktoken") and model not in tiktoken.list_encoding_names():
        raise ValueError(f"unknown tiktoken encoding {model!r}; one of {', '.join(tiktoken.list_encoding_names())}")
    return Backend("length", partial(load_tiktoken, model))


def load_tiktoken(model: str) -> Callable[[str], int]:
    import tiktoken

    if model.endswith(".tiktoken"):
        import base64
        from pathlib import Path

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(model).read_bytes().splitlines() if line)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    else:
        try:
            encoding = tiktoken.get_encoding(model)
        except Exception as error:
            raise RuntimeError(f"the files of encoding {model!r} are not here and are not downloaded") from error
    return lambda text: len(encoding.encode_ordinary(text))


def _spacy(model: str, language: str) -> Backend:
    def load() -> Callable[[str], list[str]]:
        try:
            import spacy

            nlp = spacy.load(model)
        except (ImportError, OSError) as error:
            raise RuntimeError(f"spaCy model {model!r} is not here and is not downloaded") from error
        return lambda text: [s.text for s in nlp(text).sents]

    return Backend("sentences", load)


def _nltk(model: str, language: str) -> Backend:
    def load() -> Callable[[str], list[str]]:
        try:
            from nltk.tokenize import sent_tokenize

            sent_tokenize("A. B.", language)
        except (ImportError, LookupError) as error:
            raise RuntimeError("NLTK's punkt files are not here and are not downloaded") from error
        return lambda text: sent_tokenize(text, language)

    return Backend("sentences", load)


_BACKENDS: dict[str, Callable[[str, str], Backend]] = {"tiktoken": _tiktoken, "spacy": _spacy, "nltk": _nltk, "regex": _regex}


def register(name: str, make: Callable[[str, str], Backend]) -> None:
    _BACKENDS[name] = make


def backend(model_name: str, language: str) -> Backend:
    if "/" not in model_name:
        raise ValueError("model_name must be 'backend/model'")
    name, _, model = model_name.partition("/")
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}; one of {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[name](model, language)
