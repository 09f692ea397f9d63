"""Exact outputs, edges and properties of the splitters, in Python and through Spark."""

import json
import re

import pytest
from hypothesis import given, settings, strategies as st

from chunkspark.functions.embedding import Embedding, HashedEmbedding
from chunkspark.functions.native.prose import soft_wrap
from chunkspark.functions.native.structured import markdown_table, split_table_size
from chunkspark.operators import (
    CharacterSplitter,
    CodeSplitter,
    HeaderSplitter,
    HTMLTagSplitter,
    KeywordSplitter,
    PagedSplitter,
    ParagraphSplitter,
    RecursiveCharacterSplitter,
    RecursiveJSONSplitter,
    RowColumnSplitter,
    SemanticSplitter,
    SentenceSplitter,
    TokenSplitter,
    WordSplitter,
)
from chunkspark.schema import CHUNK, DOCUMENT, collect_chunks, from_chunks, from_variable, with_metadata

LETTERS = "abcdefghijklmnopqrstuvwxyz"
FOX = "The quick brown fox jumps over the lazy dog and runs away"
HELLO = "Hello world! How are you? I am fine. Testing sentence splitting. Short. End! And another?"
TODO = "Intro text.\nTODO: refactor parser.\nBody continues here.\nNOTE: verify edge cases.\nEnding.\n"


def document(spark, text, **envelope):
    row = {c: envelope.get(c) for c in DOCUMENT.names} | {"text": text}
    return spark.createDataFrame([row], DOCUMENT)


def run(spark, splitter, text, **envelope):
    rows = splitter.transform(document(spark, text, **envelope)).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    return [r.chunk for r in rows]


EXACT = [
    (CharacterSplitter(5), LETTERS, ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "z"]),
    (CharacterSplitter(5, 2), LETTERS, ["abcde", "defgh", "ghijk", "jklmn", "mnopq", "pqrst", "stuvw", "vwxyz", "yz"]),
    (CharacterSplitter(10, 0.3), LETTERS, ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxyz"]),
    (CharacterSplitter(5, 4), "abcdefg", ["abcde", "bcdef", "cdefg", "defg", "efg", "fg", "g"]),
    (CharacterSplitter(2, -1), "abcdefg", ["ab", "de", "g"]),
    (CharacterSplitter(3), "a\nb\r\nc", ["a\nb", "\r\nc"]),
    (CharacterSplitter(2), "a\U0001f600bé", ["a\U0001f600", "bé"]),
    (WordSplitter(4), FOX, ["The quick brown fox", "jumps over the lazy", "dog and runs away"]),
    (WordSplitter(4, 2), FOX, ["The quick brown fox", "brown fox jumps over", "jumps over the lazy", "the lazy dog and", "dog and runs away", "runs away"]),
    (WordSplitter(6, 0.5), FOX, ["The quick brown fox jumps over", "fox jumps over the lazy dog", "the lazy dog and runs away", "and runs away"]),
    (WordSplitter(2), " a b\u2003c\x1cd\u0085 ", ["a b", "c d"]),
    (SentenceSplitter(3), HELLO, ["Hello world! How are you? I am fine.", "Testing sentence splitting. Short. End!", "And another?"]),
    (SentenceSplitter(2, separators=["|"]), "A|B|C|D", ["A| B|", "C| D"]),
    (SentenceSplitter(1), "Wait?! Hello ! 3.14 e", ["Wait?", "!", "Hello!", "3.", "14 e"]),
    (SentenceSplitter(1), '“Hi.” he said… (Yes.) ok', ["“Hi.”", "he said…", "(Yes.)", "ok"]),
    (SentenceSplitter(2, 1), "A b. C d. E f. G h.", ["A b. C d.", "d. E f. G h."]),
    (SentenceSplitter(5), "  ", [""]),
    (ParagraphSplitter(2), "Para1\nPara2\n \nPara3\nPara4\nPara5", ["Para1\nPara2", "Para3\nPara4", "Para5"]),
    (ParagraphSplitter(2, line_break="||"), "P1||P2||P3", ["P1||P2", "P3"]),
    (ParagraphSplitter(1, 1), "a b\nc d", ["a b", "b\nc d"]),
    (ParagraphSplitter(1, -3), "a b\nc d", ["a b", "c d"]),
    (
        KeywordSplitter({"todo": "^TODO:", "note": "^NOTE:"}, flags=re.M),
        TODO,
        ["Intro text.\nTODO:", "refactor parser.\nBody continues here.\nNOTE:", "verify edge cases.\nEnding."],
    ),
    (
        KeywordSplitter({"todo": "^TODO:", "note": "^NOTE:"}, flags=re.M, include_delimiters="after"),
        TODO,
        ["Intro text.", "TODO: refactor parser.\nBody continues here.", "NOTE: verify edge cases.\nEnding."],
    ),
    (
        KeywordSplitter(["^TODO:", "^NOTE:"], flags=re.M, include_delimiters="none"),
        TODO,
        ["Intro text.", "refactor parser.\nBody continues here.", "verify edge cases.\nEnding."],
    ),
    (
        KeywordSplitter(["^TODO:", "^NOTE:"], flags=re.M, include_delimiters="both"),
        TODO,
        ["Intro text.\nTODO:", "TODO: refactor parser.\nBody continues here.\nNOTE:", "NOTE: verify edge cases.\nEnding."],
    ),
    (KeywordSplitter(["x"], chunk_size=50), "y" * 120, ["y" * 50, "y" * 50, "y" * 20]),
    (KeywordSplitter([]), "nothing", ["nothing"]),
    (KeywordSplitter(["a"]), "", [""]),
    (RecursiveCharacterSplitter(10, 0), "one two three four", ["one two", "three", "four"]),
    (RecursiveCharacterSplitter(10, 4), "one two three four", ["one two", "two three", "four"]),
    (RecursiveCharacterSplitter(4, 0), "abcdefgh", ["abcd", "efgh"]),
    (CodeSplitter(30, "python"), "import os\nclass A:\n    pass\ndef f():\n    return 1\n", ["import os", "class A:\n    pass", "def f():\n    return 1"]),
    (
        RecursiveJSONSplitter(40, 20),
        '{"a": {"x": 1, "y": "long text here"}, "b": [1, 2]}',
        ['{"a": {"x": 1, "y": "long text here"}}', '{"b": {"0": 1, "1": 2}}'],
    ),
    (HTMLTagSplitter(1, "div"), "<body><div>a</div><div>b</div></body>", ["a\nb"]),
    (
        HTMLTagSplitter(1, "div", batch=False, to_markdown=False),
        "<body><div id=x>a<br>&lt;</div><div>b</div></body>",
        ['<html><body><div id="x">a<br/>&lt;</div></body></html>', "<html><body><div>b</div></body></html>"],
    ),
    (HTMLTagSplitter(1, "section"), "<body><div>a</div></body>", [""]),
]


@pytest.mark.parametrize(("splitter", "text", "want"), EXACT, ids=lambda x: type(x).__name__ if hasattr(x, "transform") else None)
def test_exact(spark, splitter, text, want):
    assert splitter.split_text(text) == want
    assert run(spark, splitter, text) == want


def test_sentence_overlap_of_longest():
    # The longest sentence has four words, so 0.5 is two.
    assert SentenceSplitter(1, 0.5).split_text("A b c d. E f.") == ["A b c d.", "c d. E f."]


@pytest.mark.parametrize(
    ("make", "error"),
    [
        (lambda: CharacterSplitter(5, 5), ValueError),
        (lambda: WordSplitter(4, 4), ValueError),
        (lambda: SentenceSplitter(1, -1), ValueError),
        (lambda: PagedSplitter(0), ValueError),
        (lambda: PagedSplitter(1, -1), ValueError),
        (lambda: RecursiveCharacterSplitter(10, 10), ValueError),
        (lambda: RowColumnSplitter(num_rows=1, num_cols=1), ValueError),
        (lambda: RowColumnSplitter(chunk_overlap=1.0), ValueError),
        (lambda: CodeSplitter(10, "klingon"), ValueError),
        (lambda: TokenSplitter(10, "tiktoken"), ValueError),
        (lambda: TokenSplitter(10, "other/model"), ValueError),
        (lambda: TokenSplitter(10, "tiktoken/none"), ValueError),
        (lambda: HeaderSplitter(10, ["Title 1"]), ValueError),
        (lambda: KeywordSplitter(["a"], include_delimiters="some"), ValueError),
        (lambda: SemanticSplitter(HashedEmbedding(), breakpoint_threshold_type="other"), ValueError),
        (lambda: CharacterSplitter(5, on_empty="other"), ValueError),
        (lambda: from_chunks(None, []), ValueError),
    ],
)
def test_refused(make, error):
    with pytest.raises(error):
        make()


@pytest.mark.parametrize(
    "splitter",
    [
        CharacterSplitter(5),
        WordSplitter(5),
        ParagraphSplitter(2),
        RecursiveCharacterSplitter(50, 0),
        RecursiveJSONSplitter(50, 5),
        RowColumnSplitter(num_rows=2),
    ],
)
@pytest.mark.parametrize("text", [None, ""])
def test_empty_text(spark, splitter, text):
    with pytest.raises(Exception, match="Chunks list cannot be empty"):
        run(spark, splitter, text)
    for policy, want in (("drop", []), ("emit", [""])):
        splitter.on_empty = policy
        assert run(spark, splitter, text) == want
    splitter.on_empty = "fail"


def test_pages(spark):
    mark = "<!-- page -->"
    text = f"{mark} abcde {mark} fghij {mark} klmno"
    assert run(spark, PagedSplitter(1, 2), text, page_placeholder=mark) == ["abcde", "defghij", "ijklmno"]
    text = f"{mark}1{mark}2{mark} \n {mark}3{mark}4"
    assert run(spark, PagedSplitter(2), text, page_placeholder=mark) == ["1\n2", "3\n4"]
    with pytest.raises(Exception, match="no page placeholder"):
        run(spark, PagedSplitter(1), "no pages", page_placeholder=mark)
    with pytest.raises(Exception, match="no page placeholder"):
        run(spark, PagedSplitter(1), "no pages")


INVOICES = 'id,name,amount,Remark\n1,"Johnson, Smith, and Jones Co.",345.33,Pays on time\n2,"Sam ""Mad Dog"" Smith",993.44,\n3,Barney & Company,0,"Great to work with and always pays with cash."\n4,Johnson\'s Automotive,2344,'


def test_table_modes(spark):
    by_size = run(spark, RowColumnSplitter(200), INVOICES, conversion_method="csv")
    assert len(by_size) == 3
    assert by_size[0].split("\n")[2:] == ["|    1 | Johnson, Smith, and Jones Co. |   345.33 | Pays on time |", '|    2 | Sam "Mad Dog" Smith |   993.44 |      nan |']
    rows = run(spark, RowColumnSplitter(num_rows=2), INVOICES, conversion_method="csv")
    assert len(rows) == 2
    assert rows[0].split("\n")[1] == "|-----:|:------------------------------|---------:|:-------------|"
    columns = run(spark, RowColumnSplitter(num_cols=2), INVOICES, conversion_method="csv")
    assert columns[1] == "[['amount', 345.33, 993.44, 0.0, 2344.0], ['Remark', 'Pays on time', nan, 'Great to work with and always pays with cash.', nan]]"
    # A row that fits nowhere: its own chunk, or lost as in the compatible mode.
    kept = RowColumnSplitter(150, chunk_overlap=0.2).split_text(INVOICES)
    lost = RowColumnSplitter(150, chunk_overlap=0.2, oversize="compat").split_text(INVOICES)
    assert any("Barney" in c for c in kept) and not any("Barney" in c for c in lost) and len(lost) == 4
    with pytest.raises(ValueError, match="too small"):
        RowColumnSplitter(10).split_text(INVOICES)
    assert [json.loads(r.metadata)["chunks"][r.chunk_index]["rows"] for r in RowColumnSplitter(num_rows=1, chunk_overlap=1).transform(document(spark, INVOICES, conversion_method="csv")).orderBy("chunk_index").collect()] == [[0], [1], [2], [3]]


def test_table_formats():
    pipes = "text\n| a | b |\n|---|---|\n| 1 | x |\nno pipes\n| 2 | y |\n\n| 3 | z |"
    records = '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]'
    lists = '{"a": [1, 2], "b": ["x", "y"]}'
    tabs = "a\tb\n1\tx\n2\ty"
    want = [["a", 1, 2], ["b", "x", "y"]]
    split = RowColumnSplitter(num_cols=2).split_table
    for text, method in ((pipes, "markdown"), (records, "json"), (lists, "json"), (tabs, "tsv"), (tabs.replace("\t", ","), "txt"), (tabs.replace("\t", ","), "xlsx")):
        assert split(text, method)[0] == [repr(want)]


def test_headers():
    text = "Title\n=====\nintro\n\nSub\n---\nbody\n\n```\n# no header\n```\n## Next\ntext"
    got = HeaderSplitter(headers_to_split_on=["Header 1", "Header 2"]).split_text(text)
    assert got == ["# Title\nintro", "## Sub\nbody  \n```\n# no header\n```", "## Next\ntext"]
    bare = HeaderSplitter(headers_to_split_on=["Header 2"], group_header_with_content=False).split_text("## A\none\n## B\ntwo")
    assert bare == ["one", "two"]
    assert HeaderSplitter().split_text("<html><body><h1>T</h1><p>x</p></body></html>") == ["# T  \nx"]
    assert len(HeaderSplitter(100).split_text("word " * 100)) > 4
    with pytest.raises(ValueError, match="empty"):
        HeaderSplitter().split_text("")


TABLE = "<body><table class='t'><thead><tr><th>h</th></tr></thead><tbody>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(4)) + "</tbody></table></body>"


def test_html_tables(spark):
    rows = HTMLTagSplitter(160, "tr", to_markdown=False).split_text(TABLE)
    assert len(rows) > 1 and all("<thead><tr><th>h</th></tr></thead>" in r and '<table class="t">' in r for r in rows)
    assert HTMLTagSplitter(1, "td").split_text(TABLE) == ["| h |\n| --- |\n| 0 |\n| 1 |\n| 2 |\n| 3 |"]
    assert HTMLTagSplitter(1, "tr", batch=False).split_text(TABLE) == [f"| h |\n| --- |\n| {i} |" for i in range(4)]
    bare = TABLE.replace("<thead>", "").replace("</thead>", "")
    assert HTMLTagSplitter(1, "table", batch=False).split_text(bare)[0].startswith("| h |")
    used = HTMLTagSplitter(1, "td").transform(document(spark, TABLE)).first().split_params
    assert json.loads(used)["tag"] == "table"
    assert HTMLTagSplitter().split_text("<body><p>a</p><p>b</p><div>c</div></body>") == ["a\n\nb"]


class Counting(Embedding):
    model_name = "counting"

    def __init__(self):
        self.calls = 0

    def embed_documents(self, texts):
        self.calls += 1
        return HashedEmbedding(32).embed_documents(texts)


def test_semantic():
    text = "Cats purr. Cats sleep. Cats eat fish. Stocks fell. Stocks rose. Stocks crashed today."
    e = Counting()
    one = SemanticSplitter(e, buffer_size=0, number_of_chunks=2, chunk_size=1).split_text(text)
    assert e.calls == 1 and len(one) == 2 and " ".join(one) == text
    assert SemanticSplitter(HashedEmbedding(), chunk_size=10_000).split_text(text) == [text]
    assert SemanticSplitter(HashedEmbedding(), breakpoint_threshold_type="gradient").split_text("A b. C d.") == ["A b.", "C d."]
    assert SemanticSplitter(HashedEmbedding()).split_text("Only one.") == ["Only one."]
    for kind in ("percentile", "standard_deviation", "interquartile", "gradient"):
        got = SemanticSplitter(HashedEmbedding(), breakpoint_threshold_type=kind, chunk_size=1).split_text(text)
        assert " ".join(got) == text
    assert SemanticSplitter(HashedEmbedding(), breakpoint_threshold_amount=0.8).amount == 80
    with pytest.raises(ValueError, match="empty"):
        SemanticSplitter(HashedEmbedding()).split_text(" ")


def test_tokens():
    got = TokenSplitter(4, "regex/words").split_text("one two three four five, six")
    assert got == ["one two three four", "five, six"]
    import public_tokenizers

    bytes_ = TokenSplitter(8, "tiktoken/" + public_tokenizers.path("byte_bpe_50k.tiktoken")).split_text(FOX)
    assert " ".join(bytes_) == FOX and len(bytes_) > 1
    with pytest.raises(RuntimeError):
        TokenSplitter(8, "spacy/en_core_web_sm").split_text(FOX)
    with pytest.raises(RuntimeError):
        TokenSplitter(8, "nltk/punkt").split_text(FOX)


def test_keyword_metadata(spark):
    rows = KeywordSplitter({"todo": "TODO", "fix": "FIX"}).transform(document(spark, "a TODO b", metadata='{"k": 1}')).collect()
    m = json.loads(rows[0].metadata)
    assert m["k"] == 1 and m["keyword_matches"]["counts"] == {"todo": 1} and m["keyword_matches"]["spans"] == {"todo": [[2, 6]]}
    assert rows[0].split_method == "keyword"


def test_rows_and_ids(spark):
    docs = spark.createDataFrame([("d1", "a b c d"), ("d2", "e f")], "document_id string, text string")
    made = WordSplitter(2).transform(docs)
    assert made.schema.names == CHUNK.names
    first = {(r.document_id, r.chunk_index): r.chunk_id for r in made.collect()}
    again = {(r.document_id, r.chunk_index): r.chunk_id for r in WordSplitter(2).transform(docs.repartition(3)).collect()}
    assert first == again and len(set(first.values())) == 3
    assert all(re.fullmatch(r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", x) for x in first.values())
    arrays = {r.document_id: list(r.chunks) for r in collect_chunks(made).collect()}
    assert arrays == {"d1": ["a b", "c d"], "d2": ["e f"]}
    assert [r.chunk for r in from_chunks(spark, ["x", "y"]).orderBy("chunk_index").collect()] == ["x", "y"]
    v = from_variable(spark, {"a": [1]}, "name").first()
    assert v.conversion_method == "json" and json.loads(v.text) == {"a": [1]}
    assert json.loads(with_metadata(docs.selectExpr("*", "'{\"a\": 1}' AS metadata"), {"a": 2, "b": 3}).first().metadata) == {"a": 2, "b": 3}


TEXTS = st.text(alphabet=st.sampled_from("ab .!?\n\t,…”)é\u2003"), max_size=120)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 20), st.integers(0, 5))
def test_properties(text, size, overlap):
    if overlap < size:
        step = size - overlap
        got = CharacterSplitter(size, overlap).split_text(text)
        assert "".join(c[:step] for c in got) == text and all(len(c) <= size for c in got)
        assert " ".join(" ".join(c.split()[:step]) for c in WordSplitter(size, overlap).split_text(text)).split() == text.split()
    assert "".join(RecursiveCharacterSplitter(size, 0).split_text(text)).split() == [] or "".join("".join(RecursiveCharacterSplitter(size, 0).split_text(text)).split()) == "".join(text.split())
    assert "".join("".join(SentenceSplitter(size).split_text(text)).split()) == "".join(text.split())
    assert all(len(c) <= size for c in KeywordSplitter(["b"], chunk_size=size).split_text(text))


def test_spark_equals_python(spark):
    """Expressions and plain Python agree on awkward texts."""
    texts = ["a. b! \u2003c?\x1c d…e", "x\ny\n\n z \x85w", "...", "!?.", " lead", "trail ", "\U0001f600. é\u00a0f", "(a.) 'b!' ”c"]
    for splitter in (CharacterSplitter(3, 1), WordSplitter(2, 1), SentenceSplitter(2), ParagraphSplitter(2)):
        docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")
        got = {r.document_id: list(r.chunks) for r in collect_chunks(splitter.transform(docs)).collect()}
        assert got == {str(i): splitter.split_text(t) for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=60), st.integers(-1, 12))
def test_soft_wrap_packs_tokens(text, size):
    """Against a packing of words and white space token by token, characters of long tokens one by one."""
    if size <= 0 or len(text) <= size:
        assert soft_wrap(text, size) == [text]
        return
    lines = [""]
    for token in re.findall(r"\S+|\s+", text):
        if len(lines[-1] + token) > size and lines[-1]:
            lines.append("")
        for c in token:
            if len(lines[-1]) == size:
                lines.append("")
            lines[-1] += c
    assert soft_wrap(text, size) == [x.strip() for x in lines if x.strip()]


@pytest.mark.parametrize("overlap", [0, 1, 2, 0.5])
def test_table_sizes(overlap):
    """Each chunk holds as many rows as fit, begins where the overlap says, and no row is lost."""
    widths = [3, 9, 1, 40, 2, 2, 2, 8, 30, 1]
    rows = [[f"{k}" + "x" * n] for k, n in enumerate(widths)]
    for size in (34, 45, 60, 400):
        head = len(markdown_table(["name"], [])) + 1
        line = lambda k: len(markdown_table(["name"], [rows[k]]).split("\n")[2])  # noqa: B023, E731
        chunks = split_table_size((["name"], rows), size, overlap)
        found = [[int(re.match(r"\| (\d)", x)[1]) for x in c.split("\n")[2:]] for c in chunks]
        assert sorted({k for c in found for k in c}) == list(range(len(rows)))
        for c, after in zip(found, [*found[1:], None], strict=True):
            assert c == list(range(c[0], c[0] + len(c)))
            used = head + sum(line(k) + 1 for k in c) - 1
            assert used <= size or len(c) == 1
            assert c[-1] == len(rows) - 1 or used + 1 + line(c[-1] + 1) > size
            if after:
                back = int(len(c) * overlap) if isinstance(overlap, float) else overlap
                assert after[0] == c[-1] + 1 - min(back, len(c) - 1)


def test_sentences_keep_control_characters(spark):
    text = "a\x01b one. tw\x02o\x01\x03c.\x01\x02 d\x04. \x05e"
    want = SentenceSplitter(1).split_text(text)
    assert "".join(want).count("\x01") == 3 and run(spark, SentenceSplitter(1), text) == want
    assert run(spark, SentenceSplitter(1, separators=["\x01"]), text) == SentenceSplitter(1, separators=["\x01"]).split_text(text)


@pytest.mark.parametrize("overlap", [1, 3, 7])
def test_page_overlap_equals_the_fold(spark, overlap):
    text = "#".join(["", "a", "bc", "d", "efghij", "k", "l", "mnopqrstu", "v"])
    splitter = PagedSplitter(1, overlap)
    assert run(spark, splitter, text, page_placeholder="#") == splitter.split_pages(text, "#")
