"""Documents from paths, URLs, values and texts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Iterator
from typing import Any
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.native import html
from ..schema import DOCUMENT, uuid_of
from . import convert as files

Fetch = Callable[[str], tuple[bytes, str]]


class BaseReader:
    """`read` gives documents; the rest are the tests that readers share."""

    method = ""

    def read(self, spark: SparkSession, source: Any = None, **options: Any) -> DataFrame:
        raise NotImplementedError

    @staticmethod
    def is_url(value: Any) -> bool:
        if not isinstance(value, str):
            return False
        try:
            parts = urlparse(value)
        except ValueError:
            return False
        return parts.scheme in ("http", "https") and bool(parts.netloc)

    @staticmethod
    def url_column(column: Column) -> Column:
        return column.rlike("^https?://[^/?#]+")

    @staticmethod
    def parse_json(value: Any) -> Any:
        if isinstance(value, dict | list):
            return value
        if not isinstance(value, str):
            raise TypeError("JSON must be a string, a dict or a list")
        try:
            return json.loads(value)
        except ValueError as error:
            raise ValueError(f"not JSON: {error}") from error


def sniff(text: str) -> tuple[str, str]:
    """(text, conversion_method) of a bare text: JSON, else YAML that is a dict or list, else plain."""
    try:
        value = json.loads(text)
        if isinstance(value, dict | list):
            return files.as_text(value), "json"
    except ValueError:
        pass
    import yaml

    try:
        value = yaml.safe_load(text)
    except yaml.YAMLError:
        value = None
    return (files.as_text(value), "json") if isinstance(value, dict | list) else (text, "txt")


def documents_from_value(
    spark: SparkSession,
    value: str | dict | list,
    name: str | None = None,
    document_id: str | None = None,
    metadata: dict | None = None,
    page_placeholder: str | None = None,
) -> DataFrame:
    text, method = (files.as_text(value), "json") if isinstance(value, dict | list) else sniff(value)
    mark = _surfaced(text, page_placeholder or files.PLACEHOLDER)
    row = (document_id or str(uuid.uuid4()), name, "", text, method, "vanilla", None, mark, json.dumps(metadata or {}, ensure_ascii=False))
    return spark.createDataFrame([row], DOCUMENT)


def _surfaced(text: str, placeholder: str) -> str | None:
    """A placeholder is reported where the text has it, and never one with a percent sign."""
    return placeholder if placeholder and "%" not in placeholder and placeholder in text else None


def extension_of(path: str) -> Column:
    """The extension of a file's path, in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def binary_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_documents(
    spark: SparkSession,
    path: str | list[str],
    *,
    html_to_markdown: bool = False,
    as_table: bool = False,
    vision: Any = None,
    prompt: str | None = None,
    scan_pdf_pages: bool = False,
    page_placeholder: str = files.PLACEHOLDER,
    on_unsupported: str = "fail",
    partitions: int | None = None,
    without: Collection[str] = (),
) -> DataFrame:
    """One document a file. path: a file, a folder, a pattern or a list of them, in any store that Spark reads; one that
    is not there is an error. on_unsupported: fail, or skip files whose extension is not known. without: extensions of files
    that are left out.

    Plain formats are decoded in the JVM; only the others go through Python.
    """
    d = binary_files(spark, path).select("path", "content", extension_of("path").alias("ext"))
    if without:
        d = d.where(~F.col("ext").isin(*without))
    if partitions:
        d = d.repartition(partitions)
    known = files.TEXT | files.CODE | files.HTML | files.YAML | {"parquet", "pdf"} | files.EXCEL | files.OFFICE | files.IMAGES | set(files.CONVERTERS)
    if on_unsupported == "skip":
        d = d.where(F.col("ext").isin(*known))
    plain_kinds = (files.TEXT | files.CODE | (set() if html_to_markdown else files.HTML)) - set(files.CONVERTERS)
    plain = F.col("ext").isin(*plain_kinds)

    added = files.plugins()

    @F.pandas_udf("text string, method string, ocr string")
    def other(names: pd.Series, kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        files.install(added)
        rows = [(None, None, None) if c is None else files.convert(k, c, n, html_to_markdown=html_to_markdown, as_table=as_table, vision=vision, prompt=prompt, scan_pdf_pages=scan_pdf_pages, page_placeholder=page_placeholder) for n, k, c in zip(names, kinds, contents, strict=True)]
        return pd.DataFrame(rows, columns=["text", "method", "ocr"])

    name = F.element_at(F.split("path", "/"), -1)
    d = d.withColumn("name", name).withColumn("o", other("name", "ext", F.when(~plain, F.col("content"))))
    method = F.when(F.col("ext").isin(*files.HTML), F.lit("html")).when(F.col("ext").isin(*files.TEXT), F.col("ext")).otherwise("txt")
    d = d.select(
        "path",
        "name",
        F.when(plain, F.decode("content", "UTF-8")).otherwise(F.col("o.text")).alias("text"),
        F.when(plain, method).otherwise(F.col("o.method")).alias("method"),
        F.col("o.ocr").alias("ocr"),
    )
    mark = F.when(F.contains("text", F.lit(page_placeholder)), F.lit(page_placeholder)) if page_placeholder and "%" not in page_placeholder else F.lit(None)
    return d.select(
        uuid_of(F.col("path")).alias("document_id"),
        F.col("name").alias("document_name"),
        F.col("path").alias("document_path"),
        "text",
        F.col("method").alias("conversion_method"),
        F.lit("vanilla").alias("reader_method"),
        F.col("ocr").alias("ocr_method"),
        mark.cast("string").alias("page_placeholder"),
        F.lit("{}").alias("metadata"),
    )


def fetch(url: str) -> tuple[bytes, str]:
    """Content and media type of a URL."""
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as answer:
        return answer.read(), answer.headers.get("Content-Type", "")


def url_text(url: str, content: bytes, media_type: str, html_to_markdown: bool = False) -> tuple[str, str]:
    """By media type, else by the path's ending: JSON, HTML, YAML, else plain."""
    path, kind, text = urlparse(url).path.lower(), media_type.lower(), content.decode("utf-8", "replace")
    if "json" in kind or path.endswith(".json"):
        return files.as_text(json.loads(text)), "json"
    if "html" in kind or path.endswith((".html", ".htm")):
        return (html.Markdown().convert(text), "md") if html_to_markdown else (text, "html")
    if "yaml" in kind or path.endswith((".yaml", ".yml")):
        import yaml

        return files.as_text(yaml.safe_load(text)), "json"
    return text, "txt"


def read_urls(spark: SparkSession, urls: list[str] | DataFrame, fetch_with: Fetch = fetch, html_to_markdown: bool = False) -> DataFrame:
    """One document a URL (a list, or a DataFrame with a column url), fetched by the workers."""
    given = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *url_text(u, *fetch_with(u), html_to_markdown)) for u in batch["url"]]
            yield pd.DataFrame(rows, columns=["url", "text", "method"])

    d = given.select("url").mapInPandas(get, "url string, text string, method string")
    null = F.lit(None).cast("string")
    return d.select(
        uuid_of(F.col("url")).alias("document_id"),
        F.element_at(F.split("url", "/"), -1).alias("document_name"),
        F.col("url").alias("document_path"),
        "text",
        F.col("method").alias("conversion_method"),
        F.lit("vanilla").alias("reader_method"),
        null.alias("ocr_method"),
        null.alias("page_placeholder"),
        F.lit("{}").alias("metadata"),
    )


class VanillaReader(BaseReader):
    """Sources in this order: path or URL, file_url, json_document, text_document."""

    method = "vanilla"

    def __init__(self, model: Any = None, fetch_with: Fetch = fetch):
        self.model, self.fetch_with = model, fetch_with

    def read(
        self,
        spark: SparkSession,
        source: Any = None,
        *,
        file_url: str | None = None,
        json_document: Any = None,
        text_document: str | None = None,
        html_to_markdown: bool = False,
        as_table: bool = False,
        prompt: str | None = None,
        page_placeholder: str = files.PLACEHOLDER,
        document_id: str | None = None,
        document_name: str | None = None,
        metadata: dict | None = None,
        **options: Any,
    ) -> DataFrame:
        if self.is_url(source):
            source, file_url = None, source
        if source is not None:
            return read_documents(
                spark,
                source,
                html_to_markdown=html_to_markdown,
                as_table=as_table,
                vision=self.model,
                prompt=prompt,
                page_placeholder=page_placeholder,
                **options,
            )
        if file_url is not None:
            if not self.is_url(file_url):
                raise ValueError(f"not a URL: {file_url!r}")
            return read_urls(spark, [file_url], self.fetch_with, html_to_markdown)
        if json_document is not None:
            return documents_from_value(spark, self.parse_json(json_document), document_name, document_id, metadata, page_placeholder)
        if text_document is not None:
            return documents_from_value(spark, text_document, document_name, document_id, metadata, page_placeholder)
        raise ValueError("no source is given")


class ConverterReader(BaseReader):
    """Files through a converter that runs on workers: (content, name) -> Markdown."""

    def __init__(self, convert: Callable[[bytes, str], str] | None = None, model: Any = None):
        self.convert, self.model = convert or self.default, model

    @staticmethod
    def default(content: bytes, name: str) -> str:
        raise NotImplementedError

    def method_of(self, extension: Column) -> Column:
        return F.lit("markdown")

    def read(
        self,
        spark: SparkSession,
        source: Any = None,
        *,
        page_placeholder: str = files.PLACEHOLDER,
        split_by_pages: bool = False,
        caption_images: bool = False,
        only: Collection[str] = (),
        **options: Any,
    ) -> DataFrame:
        """split_by_pages: page by page, each after its placeholder. caption_images: embedded images become what the
        reader's vision model says of them. only: the extensions to read, all if there are none."""
        whole, vision, added = self.convert, self.model, files.plugins()
        run = (lambda content, name: files.paged(content, name, whole, page_placeholder)) if split_by_pages else whole

        @F.pandas_udf("string")
        def to_text(contents: pd.Series, names: pd.Series) -> pd.Series:
            files.install(added)
            texts = [run(c, n) for c, n in zip(contents, names, strict=True)]
            return pd.Series([files.captioned(t, vision) for t in texts] if vision and caption_images else texts, dtype=object)

        raw = binary_files(spark, source)
        if only:
            raw = raw.where(extension_of("path").isin(*only))
        name = F.element_at(F.split("path", "/"), -1)
        d = raw.select("path", name.alias("name"), to_text("content", name).alias("text"))
        null = F.lit(None).cast("string")
        mark = F.when(F.contains("text", F.lit(page_placeholder)), F.lit(page_placeholder))
        return d.select(
            uuid_of(F.col("path")).alias("document_id"),
            F.col("name").alias("document_name"),
            F.col("path").alias("document_path"),
            "text",
            self.method_of(extension_of("path")).alias("conversion_method"),
            F.lit(self.method).alias("reader_method"),
            null.alias("ocr_method"),
            mark.alias("page_placeholder"),
            F.lit("{}").alias("metadata"),
        )


class MarkItDownReader(ConverterReader):
    method = "markitdown"

    def method_of(self, extension: Column) -> Column:
        return F.when(extension == "json", F.lit("json")).otherwise(F.lit("markdown"))

    @staticmethod
    def default(content: bytes, name: str) -> str:
        import io

        try:
            from markitdown import MarkItDown
        except ImportError as error:
            raise RuntimeError("this reader needs the package markitdown, or a convert function") from error
        return MarkItDown().convert_stream(io.BytesIO(content), file_extension="." + name.rpartition(".")[2]).text_content


#: Pipelines by name: keyword options -> converter.
PIPELINES: dict[str, Callable[..., Callable[[bytes, str], str]]] = {}


def register_pipeline(name: str, make: Callable[..., Callable[[bytes, str], str]]) -> None:
    PIPELINES[name] = make


def exported(
    content: bytes,
    name: str,
    *,
    embedded: bool,
    image_resolution: float = 1.0,
    page_placeholder: str = files.PLACEHOLDER,
    image_placeholder: str = files.IMAGE_PLACEHOLDER,
) -> str:
    """Markdown of one file by the layout model; images as base64, or as the placeholder."""
    import io

    try:
        from docling.datamodel.base_models import DocumentStream, InputFormat
        from docling.datamodel.pipeline_options import PdfPipelineOptions
        from docling.document_converter import DocumentConverter, PdfFormatOption
        from docling_core.types.doc import ImageRefMode
    except ImportError as error:
        raise RuntimeError("this reader needs the package docling, or a registered pipeline") from error
    pdf = PdfFormatOption(pipeline_options=PdfPipelineOptions(images_scale=image_resolution, generate_picture_images=True))
    result = DocumentConverter(format_options={InputFormat.PDF: pdf}).convert(DocumentStream(name=name, stream=io.BytesIO(content)))
    images = {"image_mode": ImageRefMode.EMBEDDED} if embedded else {"image_mode": ImageRefMode.PLACEHOLDER, "image_placeholder": image_placeholder}
    return result.document.export_to_markdown(page_break_placeholder=page_placeholder, **images)


def page_image_pipeline(
    model: Any = None,
    prompt: str | None = None,
    image_resolution: float = 1.0,
    show_base64_images: bool = False,
    page_placeholder: str = files.PLACEHOLDER,
    **_: Any,
) -> Callable[[bytes, str], str]:
    """Each page is an image, which the model reads, or which is embedded where there is no model."""
    if model is None and not show_base64_images:
        raise ValueError("a model must be given, or show_base64_images must be set")

    def run(content: bytes, name: str) -> str:
        if model is not None:
            return files.read_pages(content, model, prompt, page_placeholder, image_resolution)
        return files.show_pages(content, page_placeholder, image_resolution)

    return run


def vlm_pipeline(
    model: Any = None,
    prompt: str | None = None,
    export: Callable[..., str] = exported,
    image_placeholder: str = files.IMAGE_PLACEHOLDER,
    **options: Any,
) -> Callable[[bytes, str], str]:
    """The whole file as Markdown, each image as the placeholder and what the model says of it."""
    if model is None:
        raise ValueError("a model must be given")
    given = {k: options[k] for k in ("page_placeholder", "image_resolution") if k in options}
    return lambda content, name: files.captioned(export(content, name, embedded=True, **given), model, prompt, image_placeholder)


def markdown_pipeline(show_base64_images: bool = False, export: Callable[..., str] = exported, **options: Any) -> Callable[[bytes, str], str]:
    """The whole file as Markdown, images embedded or as the placeholder."""
    given = {k: options[k] for k in ("page_placeholder", "image_placeholder", "image_resolution") if k in options}
    return lambda content, name: export(content, name, embedded=show_base64_images, **given)


register_pipeline("page_image", page_image_pipeline)
register_pipeline("vlm", vlm_pipeline)
register_pipeline("markdown", markdown_pipeline)


class DoclingReader(ConverterReader):
    """The pipeline of each file follows from its extension and the options: PDF pages as images, a vision model, or plain
    Markdown. Files whose extension it does not read go to VanillaReader, also within a folder, a pattern or a list.

    Options go to the pipelines: prompt, image_resolution, show_base64_images, page_placeholder, image_placeholder, export.
    """

    method = "docling"
    #: Fixed value: what the converter reads.
    extensions = {"md", "markdown", "pdf", "docx", "pptx", "xlsx", "html", "htm", "odt", "rtf", "jpg", "jpeg", "png", "bmp", "gif", "tiff"}

    def __init__(self, model: Any = None, pipeline: str | None = None):
        self.pipeline = pipeline
        super().__init__(None, model)

    @staticmethod
    def choose(extension: str, scan_pdf_pages: bool, has_model: bool) -> str:
        if extension == "pdf" and scan_pdf_pages:
            return "page_image"
        return "vlm" if extension == "pdf" and has_model else "markdown"

    def read(
        self, spark: SparkSession, source: Any = None, *, scan_pdf_pages: bool = False, page_placeholder: str = files.PLACEHOLDER, **options: Any,
    ) -> DataFrame:
        if source is None or self.is_url(source):
            return VanillaReader(self.model).read(spark, source, page_placeholder=page_placeholder, **options)
        made: dict[str, Callable[[bytes, str], str]] = {}

        def pipeline_of(extension: str) -> Callable[[bytes, str], str]:
            name = self.pipeline or self.choose(extension, scan_pdf_pages, self.model is not None)
            if name not in made:
                made[name] = PIPELINES[name](model=self.model, page_placeholder=page_placeholder, **options)
            return made[name]

        # Pipelines are made here, so that what is wrong with the options is an error of the call.
        by_kind = {kind: pipeline_of(kind) for kind in sorted(kinds)} if (kinds := self._kinds(spark, source)) else {}
        self.convert = lambda content, name: by_kind[name.lower().rpartition(".")[2]](content, name)
        own = super().read(spark, source, page_placeholder=page_placeholder, only=self.extensions)
        if self.model is not None:
            own = own.withColumn("ocr_method", F.lit(self.model.model_name))
        return own.unionByName(read_documents(spark, source, vision=self.model, page_placeholder=page_placeholder, without=self.extensions))

    def _kinds(self, spark: SparkSession, source: Any) -> set[str]:
        """The extensions of the files that it reads; only paths are looked at, and only distinct endings come back."""
        found = binary_files(spark, source).select(extension_of("path").alias("ext")).distinct().where(F.col("ext").isin(*self.extensions))
        return {r["ext"] for r in found.collect()}
