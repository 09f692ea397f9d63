"""Bytes of one file to text: what readers run on workers for formats that are not plain text."""

from __future__ import annotations

import base64
import io
import json
import re
from collections.abc import Callable
from typing import Any

from ..functions.native import html

#: Extensions by how they are read.
TEXT = {"txt", "md", "markdown", "xml", "csv", "tsv", "json"}
HTML = {"html", "htm"}
YAML = {"yaml", "yml"}
EXCEL = {"xlsx", "xls"}
OFFICE = {"docx", "pptx"}
IMAGES = {"png", "jpg", "jpeg", "webp", "gif"}
CODE = {
    "lua", "java", "ts", "tsx", "ps1", "psm1", "psd1", "ps1xml", "php", "php3", "php4", "php5", "phps",
    "phtml", "rs", "cs", "csx", "cob", "cbl", "hs", "scala", "swift", "tex", "rb", "erb", "kt",
    "kts", "go", "rst", "ex", "exs", "proto", "sol", "c", "h", "cpp", "cc", "cxx", "c++",
    "hpp", "hh", "hxx", "js", "mjs", "py", "pyw", "pyc", "pyo", "pl", "pm",
}
#: Fixed value: what marks a page's beginning.
PLACEHOLDER = "<!-- page -->"

#: Converters that callers add, by extension: (content, name) -> text. They come before the built-in ones.
CONVERTERS: dict[str, Callable[[bytes, str], str]] = {}


def as_text(value: Any) -> str:
    """Strings as they are; dicts and lists as indented JSON."""
    return value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)


def yaml_text(content: bytes) -> str:
    import yaml

    return yaml.safe_dump(yaml.safe_load(content.decode("utf-8")), allow_unicode=True, sort_keys=False)


def parquet_csv(content: bytes) -> str:
    import pyarrow.parquet as pq

    return pq.read_table(io.BytesIO(content)).to_pandas().to_csv(index=False)


def excel_csv(content: bytes) -> str:
    import pandas as pd

    try:
        return pd.read_excel(io.BytesIO(content)).to_csv(index=False)
    except ImportError as error:
        raise RuntimeError("spreadsheets need the package openpyxl") from error


def pdf_markdown(content: bytes, placeholder: str = PLACEHOLDER) -> str:
    """Lines and tables of each page by place, after the page's placeholder."""
    try:
        import pdfplumber
    except ImportError as error:
        raise RuntimeError("PDF files need the package pdfplumber, or a converter in CONVERTERS['pdf']") from error
    from .pdf import page_blocks, page_text

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        pages = []
        for number, page in enumerate(pdf.pages, 1):
            tables = [{"cells": t.extract(), "top": t.bbox[1], "bottom": t.bbox[3]} for t in page.find_tables()]
            pages.append(page_text(page_blocks(page.extract_words(), tables), placeholder, number))
    return "\n\n".join(pages)


#: Renderers that callers add, by extension: content -> one PNG a page. And cutters: content -> one file a page.
RENDERERS: dict[str, Callable[[bytes], list[bytes]]] = {}
CUTTERS: dict[str, Callable[[bytes], list[bytes]]] = {}


def plugins() -> tuple[dict, dict, dict]:
    """What callers have added, to be sent to workers with `install`."""
    return dict(CONVERTERS), dict(RENDERERS), dict(CUTTERS)


def install(added: tuple[dict, dict, dict]) -> None:
    for known, new in zip((CONVERTERS, RENDERERS, CUTTERS), added, strict=True):
        known.update(new)


def pdf_images(content: bytes, resolution: float = 150) -> list[bytes]:
    try:
        import pdfplumber
    except ImportError as error:
        raise RuntimeError("PDF pages need the package pdfplumber, or a renderer in RENDERERS['pdf']") from error
    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            page.to_image(resolution=resolution).original.save(held := io.BytesIO(), format="PNG")
            out.append(held.getvalue())
    return out


def pdf_pages(content: bytes) -> list[bytes]:
    try:
        from pypdf import PdfReader, PdfWriter
    except ImportError as error:
        raise RuntimeError("PDF pages need the package pypdf, or a cutter in CUTTERS['pdf']") from error
    out = []
    for page in PdfReader(io.BytesIO(content)).pages:
        writer = PdfWriter()
        writer.add_page(page)
        writer.write(held := io.BytesIO())
        out.append(held.getvalue())
    return out


def marked(placeholder: str, number: int) -> str:
    """The placeholder of a page; {page} in it becomes the number."""
    return placeholder.replace("{page}", str(number))


def scanned_pages(content: bytes, vision: Any, prompt: str | None = None, placeholder: str = PLACEHOLDER, kind: str = "pdf") -> str:
    """What a vision model reads on each page, after the page's placeholder; a page that fails says so in its place."""
    from ..functions.vision import EXTRACTION_PROMPT

    out = []
    for number, image in enumerate(RENDERERS.get(kind, pdf_images)(content), 1):
        try:
            text = vision.analyze_content(prompt=prompt or EXTRACTION_PROMPT, file=base64.b64encode(image).decode(), file_ext="png")
        except Exception as error:  # one page does not lose the document
            text = f"**Error on page {number}:** {error}"
        out.append(f"{marked(placeholder, number)}\n\n{text}")
    return "\n\n---\n\n".join(out)


def page_images(content: bytes, scale: float, kind: str = "pdf") -> list[bytes]:
    """One PNG a page, at 72 dots an inch times the scale; a renderer that was added has its own resolution."""
    return RENDERERS[kind](content) if kind in RENDERERS else pdf_images(content, 72 * scale)


def read_pages(content: bytes, vision: Any, prompt: str | None = None, placeholder: str = PLACEHOLDER, scale: float = 1.0) -> str:
    """What a vision model reads on each page, after the page's placeholder; a page that fails is an error."""
    from ..functions.vision import EXTRACTION_PROMPT

    codes = [base64.b64encode(image).decode() for image in page_images(content, scale)]
    texts = [vision.analyze_content(prompt=prompt or EXTRACTION_PROMPT, file=code, file_ext="png") for code in codes]
    return "".join(f"{placeholder}\n\n{text.strip()}\n\n" for text in texts)


def show_pages(content: bytes, placeholder: str = PLACEHOLDER, scale: float = 1.0) -> str:
    """Each page as an embedded image, after the page's placeholder."""
    shown = (f"![Page {n}](data:image/png;base64,{base64.b64encode(image).decode()})" for n, image in enumerate(page_images(content, scale), 1))
    return "".join(f"{placeholder}\n\n{page}\n\n" for page in shown)


def paged(content: bytes, name: str, run: Callable[[bytes, str], str], placeholder: str = PLACEHOLDER) -> str:
    """A file converted page by page, each page after its placeholder."""
    kind = name.rpartition(".")[2].lower()
    pages = CUTTERS.get(kind, pdf_pages)(content)
    return "\n\n".join(f"{marked(placeholder, n)}\n\n{run(page, name)}" for n, page in enumerate(pages, 1))


#: What stands before a described image, and what is said where there is no description.
IMAGE_PLACEHOLDER = "<!-- image -->"
NO_DESCRIPTION = "Image description not available."
FAILED = "Image extraction failed: "

EMBEDDED = re.compile(r"!\[[^\]]*\]\(data:image/([a-z]+);base64,([A-Za-z0-9+/=\s]+)\)")


def captioned(markdown: str, vision: Any, prompt: str | None = None, placeholder: str = IMAGE_PLACEHOLDER) -> str:
    """Each embedded base64 image as the placeholder and, on the next line, what a vision model says of it; an image that
    fails says so there and does not lose the file."""
    from ..functions.vision import CAPTION_PROMPT

    def said(kind: str, code: str) -> str:
        try:
            answer = vision.analyze_content(prompt=prompt or CAPTION_PROMPT, file="".join(code.split()), file_ext=kind)
        except Exception as error:
            return f"{FAILED}{error}"
        return (answer or "").strip() or NO_DESCRIPTION

    return EMBEDDED.sub(lambda m: f"{placeholder}\n{said(m[1], m[2])}".strip(), markdown)


def without_images(markdown: str, placeholder: str = IMAGE_PLACEHOLDER) -> str:
    """Embedded images as the placeholder alone."""
    return EMBEDDED.sub(lambda _: placeholder, markdown)


def convert(
    extension: str,
    content: bytes,
    name: str,
    *,
    html_to_markdown: bool = False,
    as_table: bool = False,
    vision: Any = None,
    prompt: str | None = None,
    scan_pdf_pages: bool = False,
    page_placeholder: str = PLACEHOLDER,
) -> tuple[str, str, str | None]:
    """(text, conversion_method, ocr_method) of a file; an extension that is not known is an error."""
    kind = extension.lower().lstrip(".")
    if kind in CONVERTERS:
        return CONVERTERS[kind](content, name), kind, None
    if kind in TEXT or kind in CODE:
        return content.decode("utf-8"), kind if kind in TEXT else "txt", None
    if kind in HTML:
        text = content.decode("utf-8")
        return (html.Markdown().convert(text), "md", None) if html_to_markdown else (text, "html", None)
    if kind in YAML:
        return yaml_text(content), "json", None
    if kind == "parquet":
        return parquet_csv(content), "csv", None
    if kind in EXCEL and as_table:
        return excel_csv(content), kind, None
    if kind == "pdf" and scan_pdf_pages:
        if vision is None:
            raise ValueError("scanned pages need a vision model")
        return scanned_pages(content, vision, prompt, page_placeholder), "png", vision.model_name
    if kind == "pdf":
        return pdf_markdown(content, page_placeholder), "pdf", None
    if kind in EXCEL | OFFICE:
        raise RuntimeError(f"{kind} files need a converter in CONVERTERS[{kind!r}]")
    if kind in IMAGES:
        if vision is None:
            raise ValueError("images need a vision model")
        from ..functions.vision import CAPTION_PROMPT

        return vision.analyze_content(prompt=prompt or CAPTION_PROMPT, file=base64.b64encode(content).decode(), file_ext=kind), "image", vision.model_name
    raise ValueError(f"unsupported extension {extension!r}")
