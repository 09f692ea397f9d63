"""Image to text: the interface, a deterministic double, and hosted models. Arguments are by keyword everywhere."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F

from .embedding import azure_settings

#: Prompts, and media types by extension.
EXTRACTION_PROMPT = "Extract all the elements (text, formulas, tables, images, etc.) detected in the page in markdown format, orderly. Return ONLY the extracted content, with no previous comments or placeholders."
CAPTION_PROMPT = "Provide a caption describing the following resource. Return the output with the following format: *Caption: <A brief description>*."
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


class VisionModel:
    """analyze_content takes the image as base64; extensions limits what the model reads."""

    model_name = ""
    extensions = frozenset(MEDIA_TYPES)

    def media_type(self, extension: str) -> str:
        name = extension.lower().lstrip(".")
        if name not in self.extensions:
            raise ValueError(f"{type(self).__name__} does not read {extension!r}; it reads {', '.join(sorted(self.extensions))}")
        return MEDIA_TYPES[name]

    def analyze_content(self, *, prompt: str, file: str, file_ext: str = "png", **parameters: Any) -> str:
        raise NotImplementedError


class EchoVision(VisionModel):
    """Says what it was given: for tests and dry runs."""

    model_name = "echo"

    def analyze_content(self, *, prompt: str, file: str, file_ext: str = "png", **parameters: Any) -> str:
        return f"{self.media_type(file_ext)} of {len(base64.b64decode(file))} bytes"


class ChatVision(VisionModel):
    """A chat model that takes a text part and an image part as a data URI. make_client runs once a worker; ask: (client,
    model_name, messages, parameters) -> text."""

    def __init__(
        self,
        model_name: str,
        make_client: Callable[[], Any],
        ask: Callable[..., str] | None = None,
        extensions: frozenset[str] = frozenset(MEDIA_TYPES),
        detail: str | None = None,
    ):
        self.model_name, self.make_client, self.ask = model_name, make_client, ask or _chat
        self.extensions, self.detail, self._client = extensions, detail, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def messages(self, prompt: str, file: str, file_ext: str) -> list[dict]:
        image = {"url": f"data:{self.media_type(file_ext)};base64,{file}"} | ({"detail": self.detail} if self.detail else {})
        return [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": image}]}]

    def analyze_content(self, *, prompt: str, file: str, file_ext: str = "png", **parameters: Any) -> str:
        messages = self.messages(prompt, file, file_ext)
        self._client = self._client or self.make_client()
        return self.ask(self._client, self.model_name, messages, parameters)


def _chat(client: Any, model: str, messages: list[dict], parameters: dict) -> str:
    return client.chat.completions.create(model=model, messages=messages, **parameters).choices[0].message.content


def _openai(**options: Any) -> Callable[[], Any]:
    def make() -> Any:
        import openai

        return (openai.AzureOpenAI if "azure_endpoint" in options else openai.OpenAI)(**options)

    return make


def openai_vision(model_name: str = "gpt-4o", **options: Any) -> ChatVision:
    return ChatVision(model_name, _openai(**options))


def azure_openai_vision(model_name: str | None = None, **options: Any) -> ChatVision:
    """model_name is the deployment; what is not given comes from the environment."""
    deployment, options = azure_settings(model_name, options)
    return ChatVision(deployment, _openai(**options))


def grok_vision(model_name: str = "grok-4", detail: str = "auto", **options: Any) -> ChatVision:
    return ChatVision(model_name, _openai(**{"base_url": "https://api.x.ai/v1"} | options), extensions=frozenset({"jpg", "jpeg", "png"}), detail=detail)


def anthropic_vision(model_name: str, **options: Any) -> ChatVision:
    return ChatVision(model_name, _openai(**{"base_url": "https://api.anthropic.com/v1"} | options))


def gemini_vision(model_name: str = "gemini-2.5-flash", **options: Any) -> ChatVision:
    def make() -> Any:
        from google import genai

        return genai.Client(**options)

    def ask(client: Any, model: str, messages: list[dict], parameters: dict) -> str:
        from google.genai import types

        text, image = messages[0]["content"]
        head, _, body = image["image_url"]["url"].partition(";base64,")
        part = types.Part.from_bytes(data=base64.b64decode(body), mime_type=head.removeprefix("data:"))
        return client.models.generate_content(model=model, contents=[part, text["text"]], **parameters).text

    return ChatVision(model_name, make, ask)


def huggingface_vision(model_name: str, max_new_tokens: int = 40, **options: Any) -> ChatVision:
    """A local model: its processor and its class are the first that load, see `first_that_loads`."""

    def ask(client: tuple[Any, Any], model: str, messages: list[dict], parameters: dict) -> str:
        processor, network = client
        inputs = processor.apply_chat_template(messages, add_generation_prompt=True, tokenize=True, return_dict=True, return_tensors="pt")
        made = network.generate(**inputs, max_new_tokens=parameters.get("max_new_tokens", max_new_tokens))
        return processor.decode(made[0][inputs["input_ids"].shape[-1] :])

    return ChatVision(model_name, lambda: load_local(model_name, **options), ask)


#: General classes of processors and of models, in the order in which they are tried.
PROCESSORS = ("AutoProcessor", "AutoImageProcessor")
MODEL_CLASSES = ("AutoModelForVision2Seq", "AutoModelForImageTextToText", "AutoModelForCausalLM", "AutoModelForPreTraining", "AutoModel")


def first_that_loads(what: str, library: Any, names: Iterable[str], model_name: str, **options: Any) -> Any:
    """The first of the library's classes that loads the model; if none does, an error that says why for each."""
    failed = []
    for name in names:
        try:
            return getattr(library, name).from_pretrained(model_name, **options)
        except Exception as error:  # each class fails in its own way
            failed.append(f"{name}: {error}")
    raise RuntimeError(f"no {what} of {model_name} could be loaded:\n" + "\n".join(failed))


def load_local(model_name: str, **options: Any) -> tuple[Any, Any]:
    """Processor and model; the class that the model's own configuration names comes first."""
    import transformers

    options = {"trust_remote_code": True} | options
    processor = first_that_loads("processor", transformers, PROCESSORS, model_name, **options)
    named = getattr(transformers.AutoConfig.from_pretrained(model_name, **options), "architectures", None) or []
    return processor, first_that_loads("model", transformers, [*named[:1], *MODEL_CLASSES], model_name, **options)


VISION_MODELS = {
    "echo": EchoVision,
    "openai": openai_vision,
    "azure_openai": azure_openai_vision,
    "grok": grok_vision,
    "anthropic": anthropic_vision,
    "gemini": gemini_vision,
    "huggingface": huggingface_vision,
}


def describe(content: Column, extension: Column, model: VisionModel, prompt: str = CAPTION_PROMPT) -> Column:
    """Text of binary images; the model is loaded once a worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for images, kinds in batches:
            yield pd.Series(
                [None if x is None else model.analyze_content(prompt=prompt, file=base64.b64encode(x).decode(), file_ext=e) for x, e in zip(images, kinds, strict=True)],
                dtype=object,
            )

    return run(content, extension)
