"""Readers, conversions, PDF core, embeddings, vision, SQL functions and streaming."""

import base64
import json
import sys
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkspark.functions.embedding import EMBEDDINGS, ClientEmbedding, HashedEmbedding, cosine_distance, embed
from chunkspark.functions.native.html import Markdown, auto_tag, looks_like_html, parse
from chunkspark.functions.sql import register
from chunkspark.functions.vision import VISION_MODELS, ChatVision, EchoVision, describe, first_that_loads
from chunkspark.operators import CharacterSplitter, RowColumnSplitter, SentenceSplitter
from chunkspark.sources import BaseReader, DoclingReader, MarkItDownReader, VanillaReader, assemble_pages, convert, documents_from_value, lines_from_words, lines_outside_tables, read_documents, sniff, table_is_real
from chunkspark.sources.pdf import table_markdown
from chunkspark.sources.readers import PIPELINES, read_urls, register_pipeline, url_text
from chunkspark.streaming import split_stream, stream_documents


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo <!-- page --> x")
    (tmp_path / "b.json").write_text('{"k": 1}')
    (tmp_path / "c.yaml").write_text("k: [1, 2]")
    (tmp_path / "d.html").write_text("<h1>T</h1><p>x</p>")
    (tmp_path / "e.py").write_text("x = 1")
    (tmp_path / "f.csv").write_text("a,b\n1,2")
    pd.DataFrame({"a": [1, 2]}).to_parquet(tmp_path / "g.parquet")
    (tmp_path / "h.png").write_bytes(b"12345")
    got = {r.document_name: r for r in read_documents(spark, str(tmp_path), vision=EchoVision()).collect()}
    assert {n: r.conversion_method for n, r in got.items()} == {"a.txt": "txt", "b.json": "json", "c.yaml": "json", "d.html": "html", "e.py": "txt", "f.csv": "csv", "g.parquet": "csv", "h.png": "image"}
    assert got["a.txt"].text == "héllo <!-- page --> x" and got["a.txt"].page_placeholder == "<!-- page -->"
    assert got["b.json"].page_placeholder is None and got["g.parquet"].text == "a\n1\n2\n" and got["h.png"].text == "image/png of 5 bytes"
    assert "k:" in got["c.yaml"].text
    md = read_documents(spark, str(tmp_path / "d.html"), html_to_markdown=True).first()
    assert md.text == "# T\n\nx" and md.conversion_method == "md"
    assert RowColumnSplitter(num_rows=1).transform(read_documents(spark, str(tmp_path / "g.parquet"))).count() == 2
    (tmp_path / "x.exe").write_bytes(b"no")
    with pytest.raises(Exception, match="unsupported extension"):
        read_documents(spark, str(tmp_path / "x.exe")).collect()
    assert read_documents(spark, str(tmp_path), vision=EchoVision(), on_unsupported="skip").count() == 8
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_documents(spark, str(tmp_path / "missing.txt")).collect()
    with pytest.raises(Exception, match="vision model"):
        read_documents(spark, str(tmp_path / "h.png")).collect()


def test_vanilla_sources(spark):
    reader = VanillaReader(fetch_with=lambda url: (b'{"a": 1}', "application/json"))
    assert reader.read(spark, text_document="plain words").first().conversion_method == "txt"
    assert json.loads(reader.read(spark, text_document="k: v").first().text) == {"k": "v"}
    assert json.loads(reader.read(spark, json_document='{"é": 1}').first().text) == {"é": 1}
    assert reader.read(spark, "https://x.org/a.json").first().conversion_method == "json"
    with pytest.raises(ValueError, match="no source"):
        reader.read(spark)
    with pytest.raises(ValueError, match="not a URL"):
        reader.read(spark, file_url="ftp//x")
    with pytest.raises(ValueError, match="not JSON"):
        reader.read(spark, json_document="{")
    with pytest.raises(TypeError):
        BaseReader.parse_json(3)
    assert sniff("a\nb") == ("a\nb", "txt")
    assert documents_from_value(spark, "x %p", page_placeholder="%p").first().page_placeholder is None
    assert BaseReader.is_url("http://x") and not BaseReader.is_url("file:///x") and not BaseReader.is_url(None)
    urls = read_urls(
        spark,
        ["https://x.org/a.md", "https://x.org/b.html"],
        lambda u: (b"<p>t</p>", "text/html" if u.endswith("html") else ""),
        html_to_markdown=True,
    )
    assert sorted((r.document_name, r.conversion_method, r.text) for r in urls.collect()) == [("a.md", "txt", "<p>t</p>"), ("b.html", "md", "t")]
    assert url_text("https://x/a.yaml", b"a: 1", "")[1] == "json"


def test_converter_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"body")
    got = MarkItDownReader(lambda c, n: f"# {n}\n{c.decode()}").read(spark, str(tmp_path / "a.pdf")).first()
    assert got.text == "# a.pdf\nbody" and got.conversion_method == "markdown" and got.reader_method == "markitdown"
    with pytest.raises(Exception, match="markitdown"):
        MarkItDownReader().read(spark, str(tmp_path / "a.pdf")).collect()
    register_pipeline("upper", lambda **options: lambda content, name: content.decode().upper())
    assert DoclingReader(pipeline="upper").read(spark, str(tmp_path / "a.pdf")).first().text == "BODY"
    assert DoclingReader.choose("pdf", True, False) == "page_image" and DoclingReader.choose("pdf", False, True) == "vlm" and DoclingReader.choose("docx", True, True) == "markdown"
    assert {"page_image", "vlm", "markdown"} <= PIPELINES.keys()
    convert.CUTTERS["pdf"] = lambda content: [content[:2], content[2:]]
    paged = MarkItDownReader(lambda c, n: c.decode()).read(spark, str(tmp_path / "a.pdf"), split_by_pages=True, page_placeholder="<p {page}>").first()
    assert paged.text == "<p 1>\n\nbo\n\n<p 2>\n\ndy"
    captions = (
        MarkItDownReader(lambda c, n: "x ![i](data:image/png;base64,QUJD) y", EchoVision())
        .read(spark, str(tmp_path / "a.pdf"), caption_images=True)
        .first()
    )
    assert captions.text == "x <!-- image -->\nimage/png of 3 bytes y"
    (tmp_path / "b.txt").write_text("t")
    assert DoclingReader().read(spark, str(tmp_path / "b.txt")).first().reader_method == "vanilla"
    for kind in ("pdf", "docx"):
        with pytest.raises(RuntimeError):
            convert.convert(kind, b"", "x")


def test_docling_by_file(spark, tmp_path, monkeypatch):
    """Each file of a folder goes its own way; the three pipelines differ."""
    for name in ("a.pdf", "b.docx", "c.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"abc")

    def export(content, name, *, embedded, image_placeholder="<!-- image -->", **_):
        return f"{name} " + ("![i](data:image/png;base64,QUJD)" if embedded else image_placeholder)

    monkeypatch.setitem(convert.RENDERERS, "pdf", lambda content: [content, b"ab"])
    read = lambda model=None, source=str(tmp_path / "in"), **options: {r.document_name: (r.reader_method, r.text) for r in DoclingReader(model).read(spark, source, export=export, **options).collect()}
    got = read(EchoVision())
    assert got == {"a.pdf": ("docling", "a.pdf <!-- image -->\nimage/png of 3 bytes"), "b.docx": ("docling", "b.docx <!-- image -->"), "c.txt": ("vanilla", "abc")}
    assert read(image_placeholder="#")["a.pdf"][1] == "a.pdf #" and read(show_base64_images=True)["b.docx"][1].endswith("QUJD)")
    assert read(EchoVision(), scan_pdf_pages=True)["a.pdf"][1] == "<!-- page -->\n\nimage/png of 3 bytes\n\n<!-- page -->\n\nimage/png of 2 bytes\n\n"
    assert read(None, scan_pdf_pages=True, show_base64_images=True)["a.pdf"][1].startswith("<!-- page -->\n\n![Page 1](data:image/png;base64,YWJj)")
    assert read(EchoVision(), [str(tmp_path / "in" / "a.pdf"), str(tmp_path / "in" / "c.txt")]).keys() == {"a.pdf", "c.txt"}
    assert read(None, str(tmp_path / "in" / "*.docx")).keys() == {"b.docx"}
    with pytest.raises(ValueError, match="model"):
        read(None, scan_pdf_pages=True)


def test_captions_that_fail():
    class Mute(EchoVision):
        def analyze_content(self, *, prompt, file, file_ext="png", **parameters):
            if file == "QUJD":
                raise RuntimeError("no")
            return " "

    text = "![a](data:image/png;base64,QUJD) ![b](data:image/png;base64,QQ==)"
    assert convert.captioned(text, Mute(), placeholder="#") == "#\nImage extraction failed: no #\nImage description not available."
    assert convert.without_images(text, "#") == "# #"


def test_scanned_pages(spark, tmp_path, monkeypatch):
    class Fussy(EchoVision):
        def analyze_content(self, *, prompt, file, file_ext="png", **parameters):
            if file == "Yg==":
                raise RuntimeError("too small")
            return super().analyze_content(prompt=prompt, file=file, file_ext=file_ext)

    monkeypatch.setitem(convert.RENDERERS, "pdf", lambda content: [content, b"b"])
    assert convert.convert("pdf", b"abc", "x", vision=Fussy(), scan_pdf_pages=True) == ("<!-- page -->\n\nimage/png of 3 bytes\n\n---\n\n<!-- page -->\n\n**Error on page 2:** too small", "png", "echo")
    with pytest.raises(ValueError, match="vision"):
        convert.convert("pdf", b"abc", "x", scan_pdf_pages=True)


def test_html_to_markdown():
    md = Markdown().convert
    assert md("<h2>A <b>b</b></h2><p>x <i>y</i> <code>z</code> <a href='u'>l</a></p>") == "## A **b**\n\nx *y* `z` [l](u)"
    assert md("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>d</li></ol>") == "- a\n  - b\n- c\n1. d"
    assert md("<blockquote>q<br>r</blockquote><hr><img alt=a src=s>") == "> qr\n\n---\n\n![a](s)"
    assert md('<pre><code class="language-py">x &lt; 1\n</code></pre>') == "```py\nx < 1\n```"
    assert md("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>") == "| a |\n| --- |\n| 1 |"
    page = "<!doctype html><html><head><title>T</title><style>s{}</style><script>j()</script></head><body><!-- c --><p>x</p></body></html>"
    assert md(page) == "T\nx"
    assert "j()" in Markdown(leaks=True).convert(page) and "c" in Markdown(leaks=True).convert(page)
    assert looks_like_html("x", "a.HTM") and not looks_like_html("<div>", "a.md") and looks_like_html("<div>x") and not looks_like_html("a < b")
    assert auto_tag(parse("<body><p><b>x</b></p><div><b>y</b><p>z</p></div></body>")) == "p" and auto_tag(parse("<p>x</p>")) == "div"


def test_pdf_core(spark):
    words = spark.createDataFrame(
        [
            (1, "world", 10.4, 20.0, 50.0),
            (1, "Hello", 10.0, 20.0, 10.0),
            (1, "is", 30.0, 40.0, 30.0),
            (1, "This", 30.5, 40.0, 10.0),
            (1, "cell", 60.0, 70.0, 0.0),
        ],
        "page int, text string, top double, bottom double, x0 double",
    )
    lines = lines_from_words(words)
    assert [r.content for r in lines.orderBy("top").collect()] == ["Hello world", "This is", "cell"]
    tables = spark.createDataFrame([(1, 55.0, 80.0)], "page int, top double, bottom double")
    assert [r.content for r in lines_outside_tables(lines, tables).orderBy("top").collect()] == ["Hello world", "This is"]
    assert "BroadcastNestedLoop" not in lines_outside_tables(lines, tables)._jdf.queryExecution().toString()
    text = assemble_pages(lines.withColumn("document_id", F.lit("d"))).first().text
    assert text == "<!-- page -->\n\nHello world\nThis is\ncell"
    assert table_is_real([["a", "b"], ["c", None]]) and not table_is_real([["a", "b"]]) and not table_is_real([["a"], ["b"], ["c"], ["d", "e"]])
    # Cells are counted, empty ones too; blank rows are not.
    assert table_is_real([["a", None, None], ["b", "", None], ["c", "", ""]]) and not table_is_real([["a", "b"], ["", None]]) and not table_is_real([])
    assert table_markdown([["a", "b"], [None, " "], ["c", None]]).count("\n") == 2


def test_embeddings(spark):
    e = HashedEmbedding(8)
    a, b = e.embed_documents(["x y", "y x"])
    assert a == b and abs(np.linalg.norm(a) - 1) < 1e-9 and e.embed_text("") == [0.0] * 8
    with pytest.raises(ValueError):
        e.embed_documents([])
    rows = spark.createDataFrame([(1, "x y"), (2, None)], "i int, t string").withColumn("v", embed(F.col("t"), e)).orderBy("i").collect()
    assert list(rows[0].v) == a and rows[1].v is None
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0]
    good = ClientEmbedding(
        "m",
        lambda: None,
        lambda c, m, texts: [[float(len(t))] for t in texts],
        max_tokens=3,
        count_tokens=lambda client, model, t: len(t.split()),
        refuse_blank=True,
    )
    assert good.embed_text("ab c") == [4.0]
    for texts in (["a b c d"], [" "], []):
        with pytest.raises(ValueError):
            good.embed_documents(texts)
    with pytest.raises(RuntimeError, match="gave 0"):
        ClientEmbedding("m", lambda: None, lambda c, m, t: []).embed_documents(["a"])
    with pytest.raises(RuntimeError, match="failed"):
        EMBEDDINGS["huggingface"]().embed_documents(["a"])


def test_local_embedding(monkeypatch):
    """The model that is named is the one that is loaded; too long a text is an error."""

    class Model:
        max_seq_length = 3

        def __init__(self, name, **options):
            self.name = name

        def tokenize(self, texts):
            return {"input_ids": [t.split() for t in texts]}

        def encode(self, texts):
            return np.array([[3.0, 4.0 if self.name == "other/model" else 0.0] for _ in texts])

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Model))
    assert np.allclose(EMBEDDINGS["huggingface"]("other/model").embed_text("a b"), [0.6, 0.8])
    assert EMBEDDINGS["huggingface"]().embed_text("a b") == [1.0, 0.0]
    with pytest.raises(ValueError, match="4 tokens"):
        EMBEDDINGS["huggingface"]().embed_text("a b c d")
    assert EMBEDDINGS["huggingface"](enforce_max_length=False).embed_text("a b c d") == [1.0, 0.0]


def test_hosted_embedding_limits(monkeypatch, tmp_path):
    class Client:
        def __init__(self, **options):
            self.options = options
            self.embeddings = self

        def create(self, input, model):
            return types.SimpleNamespace(data=[types.SimpleNamespace(embedding=[float(len(t))]) for t in input])

    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=Client, AzureOpenAI=Client))
    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    e = EMBEDDINGS["openai"](tokenizer=str(ranks), api_key="k")
    assert e.embed_text("abc") == [3.0]
    with pytest.raises(ValueError, match="8193 tokens"):
        e.embed_text("a" * 8193)
    for name in ("API_KEY", "ENDPOINT", "DEPLOYMENT", "API_VERSION"):
        monkeypatch.delenv(f"AZURE_OPENAI_{name}", raising=False)
    with pytest.raises(ValueError, match="AZURE_OPENAI_API_KEY"):
        EMBEDDINGS["azure_openai"]()
    monkeypatch.setenv("AZURE_OPENAI_API_KEY", "k")
    monkeypatch.setenv("AZURE_OPENAI_ENDPOINT", "https://x")
    assert EMBEDDINGS["azure_openai"]().get_client().options["azure_deployment"] == "text-embedding-3-large"
    monkeypatch.setenv("AZURE_OPENAI_DEPLOYMENT", "d")
    azure = EMBEDDINGS["azure_openai"](max_tokens=None)
    assert azure.model_name == "d" and azure.get_client().options["api_version"] and azure.embed_text("ab") == [2.0]
    assert VISION_MODELS["azure_openai"]().model_name == "d"


def test_local_vision_falls_back():
    class Broken:
        @staticmethod
        def from_pretrained(name, **options):
            raise OSError("not this one")

    class Good:
        @staticmethod
        def from_pretrained(name, **options):
            return f"{name} loaded"

    library = types.SimpleNamespace(A=Broken, B=Good)
    assert first_that_loads("model", library, ["A", "Missing", "B"], "m") == "m loaded"
    with pytest.raises(RuntimeError, match="A: not this one"):
        first_that_loads("model", library, ["A"], "m")


def test_vision(spark):
    chat = ChatVision("m", lambda: "client", lambda client, model, messages, parameters: messages[0]["content"][1]["image_url"]["url"][:15])
    assert chat.analyze_content(prompt="p", file="QUJD", file_ext="jpg") == "data:image/jpeg"
    with pytest.raises(ValueError):
        VISION_MODELS["grok"]().media_type("webp")
    images = spark.createDataFrame([(bytearray(b"abc"), "png"), (None, "png")], "c binary, e string")
    assert [r[0] for r in images.select(describe(F.col("c"), F.col("e"), EchoVision())).collect()] == ["image/png of 3 bytes", None]


def test_sql_functions(spark):
    names = register(spark)
    assert "char_split" in names
    spark.createDataFrame([(1, "abcdef"), (2, "xy")], "id int, t string").createOrReplaceTempView("texts_for_sql")
    rows = spark.sql("SELECT id, s.* FROM texts_for_sql, LATERAL char_split(t, 4, 0.5) s ORDER BY id, chunk_index").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "abcd"), (1, 1, "cdef"), (1, 2, "ef"), (2, 0, "xy")]
    assert spark.sql("SELECT * FROM sentence_split('A. B. C.', 2)").count() == 2
    assert [r.chunk for r in spark.sql("SELECT * FROM paged_split('##a##b', '##', 1) ORDER BY chunk_index").collect()] == ["a", "b"]
    assert spark.sql("SELECT * FROM row_split('a,b\n1,2\n3,4', 'csv', 1)").count() == 2
    assert spark.sql("SELECT * FROM column_split('a,b\n1,2', 'csv', 1)").count() == 2
    assert spark.sql("SELECT * FROM semantic_split('One thing. Another.', 1)").count() >= 1
    assert spark.sql("SELECT * FROM header_split('# A\nx\n# B\ny')").count() == 2


@pytest.mark.parametrize("splitter", [CharacterSplitter(4), SentenceSplitter(1, 1)])
def test_streaming(spark, tmp_path, splitter):
    docs = spark.createDataFrame([("a", "one. two. three."), ("b", "four.")], "document_id string, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        split_stream(stream_documents(spark, source, docs.schema), splitter, out, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out).select("document_id", "chunk_index", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, splitter.transform(docs).select("document_id", "chunk_index", "chunk").collect()))
