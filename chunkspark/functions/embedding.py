"""Text to vector: the backend interface, deterministic backends, and hosted ones as named interfaces.

A backend is loaded once a worker; an Arrow batch is a request batch.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .tokens import load_tiktoken

#: Fixed value: tokens that the hosted text models take.
MAX_TOKENS = 8192


class Embedding:
    """embed_documents keeps the order; an empty list is an error. Subclasses give embed_text, or better embed_documents."""

    model_name = ""

    def get_client(self) -> Any:
        return None

    def embed_text(self, text: str) -> list[float]:
        raise NotImplementedError

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            raise ValueError("texts must not be empty")
        return [self.embed_text(t) for t in texts]


class HashedEmbedding(Embedding):
    """Bag of words by a stable hash, of length 1 unless the text has no word."""

    def __init__(self, size: int = 64):
        self.size, self.model_name = size, f"hashed-{size}"
        self._places: dict[str, int] = {}

    def _place(self, word: str) -> int:
        if word not in self._places:
            if len(self._places) > 100_000:
                self._places.clear()
            self._places[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") % self.size
        return self._places[word]

    def embed_text(self, text: str) -> list[float]:
        out = np.zeros(self.size)
        for w in re.findall(r"\w+", text.lower()):
            out[self._place(w)] += 1
        norm = float(np.sqrt((out**2).sum()))
        return (out / norm if norm else out).tolist()


class ClientEmbedding(Embedding):
    """A hosted or local model behind a client that the caller makes: `make_client()` runs once a worker.

    request: (client, model_name, texts) -> list of vectors. count_tokens: (client, model_name, text) -> number or None;
    with max_tokens, a number or client -> number or None, it checks each text. Blank texts can be refused; a wrong number
    of vectors is an error.
    """

    def __init__(
        self,
        model_name: str,
        make_client,
        request,
        *,
        max_tokens: int | None = None,
        count_tokens=None,
        refuse_blank: bool = False,
        normalize: bool = False,
    ):
        self.model_name, self.make_client, self.request = model_name, make_client, request
        self.max_tokens, self.count_tokens, self.refuse_blank, self.normalize = max_tokens, count_tokens, refuse_blank, normalize
        self._client = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def get_client(self) -> Any:
        self._client = self._client or self.make_client()
        return self._client

    def embed_text(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            raise ValueError("texts must not be empty")
        if self.refuse_blank and any(not t or not t.strip() for t in texts):
            raise ValueError("texts must not be blank")
        try:
            client = self.get_client()
        except Exception as error:
            raise RuntimeError(f"embedding with {self.model_name} failed: {error}") from error
        if self.max_tokens and self.count_tokens:
            limit = self.max_tokens(client) if callable(self.max_tokens) else self.max_tokens
            for t in texts:
                if limit and (n := self.count_tokens(client, self.model_name, t) or 0) > limit:
                    raise ValueError(f"a text has {n} tokens, the model takes {limit}")
        try:
            out = self.request(client, self.model_name, texts)
        except Exception as error:
            raise RuntimeError(f"embedding with {self.model_name} failed: {error}") from error
        if len(out) != len(texts):
            raise RuntimeError(f"{len(texts)} texts gave {len(out)} vectors")
        if self.normalize:
            out = [(np.asarray(v, np.float32) / max(float(np.linalg.norm(v)), 1e-12)).tolist() for v in out]
        return [list(map(float, v)) for v in out]


def _hosted(name: str, package: str, default: str, client, request, settings=None, counter=None, **limits):
    """A constructor for a hosted backend; the package is imported in the worker, with a hint if it is not there.

    client: (model_name, **options) -> client. settings: (model_name, options) -> the same two, complete. The constructor
    also takes max_tokens and count_tokens in place of the backend's own, and tokenizer, the name of an encoding or the
    path of a file of ranks, where the backend counts with one.
    """

    def make(model_name: str = default, *, tokenizer: str | None = None, **options: Any) -> ClientEmbedding:
        own = limits | {k: options.pop(k) for k in ("max_tokens", "count_tokens", "normalize") if k in options}
        if counter:
            own.setdefault("count_tokens", counter(tokenizer))
        if settings:
            model_name, options = settings(model_name, options)

        def make_client() -> Any:
            try:
                return client(model_name, **options)
            except ImportError as error:
                raise ImportError(f"{name} embeddings need the package {package!r}") from error

        return ClientEmbedding(model_name, make_client, request, **own)

    make.__name__ = name
    return make


#: The encoding of models that have no other, and the version of the hosted interface.
FALLBACK_ENCODING = "cl100k_base"
AZURE_VERSION = "2025-04-14-preview"


def azure_settings(model_name: str | None, options: dict[str, Any], name_is_deployment: bool = True) -> tuple[str, dict[str, Any]]:
    """The deployment and the client's options, completed from the environment; what is missing is an error here, not in
    a worker. The model's name serves as the deployment where nothing else is given, if it may."""
    environment = os.environ
    out = dict(options)
    for key, variable in {"api_key": "AZURE_OPENAI_API_KEY", "azure_endpoint": "AZURE_OPENAI_ENDPOINT"}.items():
        out[key] = out.get(key) or environment.get(variable)
        if not out[key]:
            raise ValueError(f"{key} is not given and {variable} is not set")
    deployment = out.get("azure_deployment") or environment.get("AZURE_OPENAI_DEPLOYMENT") or (model_name if name_is_deployment else None)
    if not deployment:
        raise ValueError("azure_deployment is not given and AZURE_OPENAI_DEPLOYMENT is not set")
    version = out.get("api_version") or environment.get("AZURE_OPENAI_API_VERSION") or AZURE_VERSION
    return deployment, out | {"azure_deployment": deployment, "api_version": version}


class TokenCounter:
    """(client, model_name, text) -> number of tokens; the encoding is loaded once a worker: that of the name or file of
    ranks given, else the model's, else the fallback."""

    def __init__(self, tokenizer: str | None = None):
        self.tokenizer, self._count = tokenizer, None

    def __getstate__(self) -> dict:
        return {"tokenizer": self.tokenizer, "_count": None}

    def __call__(self, client: Any, model_name: str, text: str) -> int:
        if self._count is None:
            import tiktoken

            name = self.tokenizer
            if name is None:
                try:
                    name = tiktoken.encoding_name_for_model(model_name)
                except KeyError:
                    name = FALLBACK_ENCODING
            self._count = load_tiktoken(name)
        return self._count(text)


def _openai_client(_: str, **options: Any) -> Any:
    import openai

    return openai.OpenAI(**options)


def _azure_client(_: str, **options: Any) -> Any:
    import openai

    return openai.AzureOpenAI(**options)


def _openai_request(client: Any, model: str, texts: list[str]) -> list[list[float]]:
    return [x.embedding for x in client.embeddings.create(input=texts, model=model).data]


def _gemini_client(_: str, **options: Any) -> Any:
    from google import genai

    return genai.Client(**options)


def _gemini_request(client: Any, model: str, texts: list[str]) -> list[list[float]]:
    return [x.values for x in client.models.embed_content(model=model, contents=texts).embeddings]


def _voyage_client(_: str, **options: Any) -> Any:
    import voyageai

    return voyageai.Client(**options)


def _voyage_request(client: Any, model: str, texts: list[str]) -> list[list[float]]:
    return client.embed(texts, model=model, input_type="document").embeddings


def _sentence_client(model: str, **options: Any) -> Any:
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model, **options)


def _sentence_limit(client: Any) -> int | None:
    """What the model says it takes, if it says so."""
    ask = getattr(client, "get_max_seq_length", None)
    limit = ask() if ask else getattr(client, "max_seq_length", None)
    return None if limit is None else int(limit)


def _sentence_tokens(client: Any, _: str, text: str) -> int | None:
    ids = client.tokenize([text]).get("input_ids") if hasattr(client, "tokenize") else None
    return None if ids is None else len(ids[0])


def _sentence_request(client: Any, model: str, texts: list[str]) -> list[list[float]]:
    return client.encode(texts).tolist()


#: Hosted and local backends by name; each gives a ClientEmbedding. Keyword arguments go to the client.
openai_embedding = _hosted("openai", "openai", "text-embedding-3-large", _openai_client, _openai_request, counter=TokenCounter, max_tokens=MAX_TOKENS)
azure_openai_embedding = _hosted(
    "azure_openai",
    "openai",
    "text-embedding-3-large",
    _azure_client,
    _openai_request,
    settings=azure_settings,
    counter=TokenCounter,
    max_tokens=MAX_TOKENS,
)
gemini_embedding = _hosted("gemini", "google-genai", "models/embedding-001", _gemini_client, _gemini_request, refuse_blank=True)
anthropic_embedding = _hosted("voyage", "voyageai", "voyage-3.5", _voyage_client, _voyage_request, refuse_blank=True)
_sentence_embedding = _hosted(
    "huggingface", "sentence-transformers", "sentence-transformers/all-MiniLM-L6-v2", _sentence_client, _sentence_request, normalize=True,
)


def huggingface_embedding(model_name: str = "sentence-transformers/all-MiniLM-L6-v2", enforce_max_length: bool = True, **options: Any) -> ClientEmbedding:
    """A local model; enforce_max_length: a text of more tokens than the model takes is an error."""
    checks = {"max_tokens": _sentence_limit, "count_tokens": _sentence_tokens} if enforce_max_length else {}
    return _sentence_embedding(model_name, **checks, **options)


EMBEDDINGS = {
    "hashed": HashedEmbedding,
    "openai": openai_embedding,
    "azure_openai": azure_openai_embedding,
    "gemini": gemini_embedding,
    "anthropic": anthropic_embedding,
    "huggingface": huggingface_embedding,
}


def embed(text: Column, backend: Embedding) -> Column:
    """Vectors of a text column; null and empty batches cost no request."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            have = texts[texts.notna()]
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(have):
                out[have.index] = pd.Series(backend.embed_documents(have.tolist()), index=have.index, dtype=object)
            yield out

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot / max(|a| |b|, 1e-12), in double precision."""
    return 1 - dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
