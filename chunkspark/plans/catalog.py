"""Every query of the library by name, and the SQL that DuckDB answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.embedding import HashedEmbedding, dot, embed
from ..functions.layout import spread
from ..operators import CharacterSplitter, CodeSplitter, HeaderSplitter, HTMLTagSplitter, KeywordSplitter, PagedSplitter, ParagraphSplitter, RecursiveCharacterSplitter, RecursiveJSONSplitter, RowColumnSplitter, SemanticSplitter, SentenceSplitter, Splitter, TokenSplitter, WordSplitter
from ..operators.html import html_auto_tag, html_to_markdown
from ..operators.semantic import AMOUNTS, group_thresholds, neighbour_distances, top_breakpoints
from ..operators.tables import split_columns, split_rows
from ..schema import as_documents
from ..sources.pdf import assemble_pages, lines_from_words, lines_outside_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(df: DataFrame, splitter: Splitter, text: str = "text", key: str = "doc_id", **fixed: str) -> DataFrame:
    """key, chunk_index, chunk."""
    docs = as_documents(spread(df.select(text, key), key), text=text, document_id=key, **fixed)
    return splitter.transform(docs).select(F.col("document_id").cast("long").alias(key), "chunk_index", "chunk")


def over_documents(name: str, splitter: Callable[[], Splitter], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf: chunks(table(spark, sf, "documents"), splitter()))


# ---- Characters and words ----


def _character_sql(size: int, step: int) -> str:
    return f"""SELECT doc_id, CAST(s / {step} AS INTEGER) AS chunk_index, substr(text, CAST(s + 1 AS BIGINT), {size}) AS chunk
               FROM (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS s FROM documents)"""


def _word_sql(size: int, step: int) -> str:
    return rf"""SELECT doc_id, CAST(s / {step} AS INTEGER) AS chunk_index, array_to_string(w[s + 1 : s + {size}], ' ') AS chunk
                FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS s
                      FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))"""


over_documents("character_split", lambda: CharacterSplitter(500), _character_sql(500, 500))
over_documents("character_overlap", lambda: CharacterSplitter(500, 50), _character_sql(500, 450))
over_documents("character_overlap_float", lambda: CharacterSplitter(1000, 0.2), _character_sql(1000, 800))
over_documents("word_split", lambda: WordSplitter(50), _word_sql(50, 50))
over_documents("word_overlap", lambda: WordSplitter(50, 10), _word_sql(50, 40))

# ---- Paragraphs and sentences ----

_PARAGRAPHS = r"SELECT doc_id AS k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS p FROM documents"
_SENTENCES = r"""SELECT doc_id AS k, list_filter(list_transform(string_split(regexp_replace(text, '((?:\.\.\.|…|[.!?])["”’''\)\]\}»]*\s*)', chr(1) || '\1' || chr(2), 'g'), chr(2)),
                 lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s*' || chr(1), ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents"""


def _group_sql(items: str, size: int, joint: str, key: str = "doc_id") -> str:
    return f"""SELECT k AS {key}, CAST(s / {size} AS INTEGER) AS chunk_index, array_to_string(p[s + 1 : s + {size}], {joint}) AS chunk
               FROM (SELECT k, p, unnest(range(0, len(p), {size})) AS s FROM ({items}))"""


def _fold_sql(items: str, size: int, joint: str, tail: str, key: str = "doc_id") -> str:
    """Each chunk after the first begins with `tail` of the one before, an expression over `chunk`."""
    return f"""WITH RECURSIVE g AS ({_group_sql(items, size, joint, "k")}),
               f AS (SELECT k, chunk_index, chunk FROM g WHERE chunk_index = 0
                     UNION ALL SELECT g.k, g.chunk_index, {tail} || g.chunk FROM f JOIN g ON f.k = g.k AND g.chunk_index = f.chunk_index + 1)
               SELECT k AS {key}, chunk_index, chunk FROM f"""


def _last_words(n: int, joint: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array(f.chunk, '\s+'), lambda x: x <> '')[-{n} : ], ' ') || {joint}"


over_documents("paragraph_split", lambda: ParagraphSplitter(3), _group_sql(_PARAGRAPHS, 3, "chr(10)"))
over_documents("paragraph_overlap", lambda: ParagraphSplitter(2, 5), _fold_sql(_PARAGRAPHS, 2, "chr(10)", _last_words(5, "chr(10)")))
over_documents("sentence_split", lambda: SentenceSplitter(5), _group_sql(_SENTENCES, 5, "' '"))
over_documents("sentence_overlap", lambda: SentenceSplitter(3, 4), _fold_sql(_SENTENCES, 3, "' '", _last_words(4, "' '")))

# ---- Pages: the turns of a conversation ----

_MARK = "<!-- page -->"
_PAGES = rf"""SELECT conv_id AS k, list_filter(list_transform(string_split(t, '{_MARK}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p
              FROM (SELECT conv_id, string_agg('{_MARK}' || text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"""


def _paged(spark: SparkSession, sf_dir: str, splitter: PagedSplitter) -> DataFrame:
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: F.concat(F.lit(_MARK), t["text"]))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(turns, "").alias("text"))
    return chunks(docs, splitter, key="conv_id", page_placeholder=_MARK)


query("paged_split", _group_sql(_PAGES, 2, "chr(10)", "conv_id"))(lambda spark, sf: _paged(spark, sf, PagedSplitter(2)))
query("paged_overlap", _fold_sql(_PAGES, 1, "chr(10)", "right(f.chunk, 20)", "conv_id"))(lambda spark, sf: _paged(spark, sf, PagedSplitter(1, 20)))

# ---- Keywords ----

_KEYWORDS = {"the": r"\bthe\b", "secret": r"password|token|secret"}


def _keyword_sql(form: str) -> str:
    return rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, c[i] AS chunk
                FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (
                  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(\bthe\b|password|token|secret)', {form}, 'g'), chr(2)),
                         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM documents))"""


for _where, _form in {"none": "chr(2)", "before": r"'\1' || chr(2)", "after": r"chr(2) || '\1'", "both": r"'\1' || chr(2) || '\1'"}.items():
    over_documents(f"keyword_{_where}", lambda where=_where: KeywordSplitter(_KEYWORDS, include_delimiters=where, chunk_size=0), _keyword_sql(_form))


def _wrap_sql(size: int) -> str:
    """The chunks of `keyword_before`, cut at the last end of a word or of white space within `size` characters, or just there."""
    cut = f"coalesce(list_max(list_filter(ends, lambda z: z > {{0}} AND z <= {{0}} + {size})), {{0}} + {size})"
    return rf"""WITH RECURSIVE c AS (SELECT *, CASE WHEN length(chunk) <= {size} THEN [chunk] ELSE regexp_extract_all(chunk, '\S+|\s+') END AS tokens FROM ({_keyword_sql("'\\1' || chr(2)")})),
                t AS (SELECT doc_id, chunk_index, chunk, n, sum(length(token)) OVER (PARTITION BY doc_id, chunk_index ORDER BY n) AS e
                      FROM (SELECT doc_id, chunk_index, chunk, unnest(tokens) AS token, unnest(range(len(tokens))) AS n FROM c)),
                e AS (SELECT doc_id, chunk_index, any_value(chunk) AS chunk, list(CAST(e AS BIGINT) ORDER BY n) AS ends FROM t GROUP BY doc_id, chunk_index),
                w AS (SELECT doc_id, chunk_index, chunk, ends, CAST(0 AS BIGINT) AS a, {cut.format("0")} AS b FROM e
                      UNION ALL SELECT doc_id, chunk_index, chunk, ends, b, {cut.format("b")} FROM w WHERE b < length(chunk))
                SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, a) - 1 AS INTEGER) AS chunk_index, piece AS chunk
                FROM (SELECT doc_id, chunk_index, a, regexp_replace(substr(chunk, a + 1, b - a), '^\s+|\s+$', '', 'g') AS piece FROM w) WHERE piece <> ''"""


over_documents("keyword_wrap", lambda: KeywordSplitter(_KEYWORDS, chunk_size=80), _wrap_sql(80))


@query(
    "keyword_counts",
    r"""SELECT doc_id, CAST(len(list_filter(m, lambda x: x = 'the')) AS BIGINT) AS n_the, CAST(len(list_filter(m, lambda x: x <> 'the')) AS BIGINT) AS n_secret
        FROM (SELECT doc_id, regexp_extract_all(text, '\bthe\b|password|token|secret') AS m FROM documents)""",
)
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), document_id="doc_id")
    first = KeywordSplitter(_KEYWORDS, chunk_size=0).transform(docs).where("chunk_index = 0")
    n = lambda name: F.coalesce(F.get_json_object("metadata", f"$.keyword_matches.counts.{name}").cast("long"), F.lit(0).cast("long")).alias(f"n_{name}")
    return first.select(F.col("document_id").cast("long").alias("doc_id"), n("the"), n("secret"))


# ---- Rows and columns ----


@query(
    "row_split",
    """WITH r AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
       SELECT CAST(c AS INTEGER) AS chunk_index, CAST(i - c * 3 AS INTEGER) AS row_in_chunk, n_nationkey, n_name, n_regionkey
       FROM r, (SELECT unnest(range(0, 100)) AS c) WHERE i >= c * 3 AND i < c * 3 + 4""",
)
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], 4, 1)


@query(
    "row_split_large",
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
       SELECT CAST(i // 100 AS INTEGER) AS chunk_index, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(sum(o_custkey) AS BIGINT) AS sum_cust
       FROM r GROUP BY 1""",
)
def row_split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100)
    return rows.groupBy("chunk_index").agg(
        F.count("*").alias("n_rows"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
        F.sum("o_custkey").alias("sum_cust"),
    )


@query(
    "column_split",
    """SELECT p_partkey, 0 AS chunk_index, 'p_name,p_brand' AS column_names, concat_ws('|', p_name, p_brand) AS cells FROM part
       UNION ALL SELECT p_partkey, 1, 'p_type,p_size', concat_ws('|', p_type, CAST(p_size AS VARCHAR)) FROM part""",
)
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return split_columns(part, ["p_partkey"], 2).withColumn("cells", F.array_join("cells", "|"))


def _nation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as one CSV document."""
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat_ws(",", x["n_nationkey"].cast("string"), x["n_name"]),
    )
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), F.array_join(lines, "\n")).alias("text"))


#: The cells of each region's table, its name column padded to the widest cell of a chunk, and its lines.
_NATIONS = "SELECT n_regionkey, n_nationkey AS k, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation"


def _table_rows_sql(size: int, overlap: int) -> str:
    """Numbers to the right and names to the left, in columns two wider than their header at least."""
    head = "'| ' || lpad('key', w, ' ') || ' | ' || rpad('name', v, ' ') || ' |' || chr(10) || '|' || repeat('-', w + 1) || ':|:' || repeat('-', v + 1) || '|'"
    return f"""SELECT n_regionkey, CAST(c AS INTEGER) AS chunk_index, any_value({head}) || chr(10) || string_agg('| ' || lpad(CAST(k AS VARCHAR), w, ' ') || ' | ' || rpad(name, v, ' ') || ' |', chr(10) ORDER BY i) AS chunk
               FROM (SELECT *, CAST(greatest(5, max(length(CAST(k AS VARCHAR))) OVER p) AS INTEGER) AS w, CAST(greatest(6, max(length(name)) OVER p) AS INTEGER) AS v
                     FROM (SELECT *, unnest(range(0, 100)) AS c FROM ({_NATIONS})) WHERE i >= c * {size - overlap} AND i < c * {size - overlap} + {size} WINDOW p AS (PARTITION BY n_regionkey, c))
               GROUP BY n_regionkey, c"""


def _table_size_sql(size: int) -> str:
    """Rows, each as wide as it needs, are added to a chunk as long as they fit under the header."""
    head = "'| key   | name   |' || chr(10) || '|-------|--------|'"
    return f"""WITH RECURSIVE r AS (SELECT n_regionkey, i, '| ' || lpad(CAST(k AS VARCHAR), 5, ' ') || ' | ' || rpad(name, CAST(greatest(6, length(name)) AS INTEGER), ' ') || ' |' AS line FROM ({_NATIONS})),
               f AS (SELECT n_regionkey, i, 0 AS c, {head} || chr(10) || line AS chunk FROM r WHERE i = 0
                     UNION ALL SELECT f.n_regionkey, r.i, CASE WHEN length(f.chunk) + 1 + length(r.line) <= {size} THEN c ELSE c + 1 END,
                                      CASE WHEN length(f.chunk) + 1 + length(r.line) <= {size} THEN f.chunk ELSE {head} END || chr(10) || r.line
                     FROM f JOIN r ON f.n_regionkey = r.n_regionkey AND r.i = f.i + 1)
               SELECT n_regionkey, CAST(c AS INTEGER) AS chunk_index, arg_max(chunk, i) AS chunk FROM f GROUP BY n_regionkey, c"""


_QUOTED = "string_agg(chr(39) || {} || chr(39), ', ' ORDER BY i)"
_TABLE_COLUMNS_SQL = f"""SELECT n_regionkey, 0 AS chunk_index, '[[' || chr(39) || 'key' || chr(39) || ', ' || string_agg(k, ', ' ORDER BY i) || ']]' AS chunk FROM ({_NATIONS}) GROUP BY n_regionkey
                         UNION ALL SELECT n_regionkey, 1, '[[' || chr(39) || 'name' || chr(39) || ', ' || {_QUOTED.format("name")} || ']]' FROM ({_NATIONS}) GROUP BY n_regionkey"""
query("table_rows", _table_rows_sql(3, 1))(
    lambda spark, sf: chunks(_nation_csv(spark, sf), RowColumnSplitter(num_rows=3, chunk_overlap=1), key="n_regionkey", conversion_method="csv"),
)
query("table_columns", _TABLE_COLUMNS_SQL)(
    lambda spark, sf: chunks(_nation_csv(spark, sf), RowColumnSplitter(num_cols=1), key="n_regionkey", conversion_method="csv"),
)
query("table_size", _table_size_sql(120))(
    lambda spark, sf: chunks(_nation_csv(spark, sf), RowColumnSplitter(chunk_size=120), key="n_regionkey", conversion_method="csv"),
)

# ---- Meaning ----

_NEXT = "SELECT label, vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_DISTANCES = f"SELECT label, vec_id, 1 - {_DOT.format('a', 'b')} / greatest(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}), 1e-12) AS distance FROM ({_NEXT}) WHERE b IS NOT NULL"


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


query(
    "semantic_distance", f"SELECT label, vec_id, round(distance, 9) AS distance FROM ({_DISTANCES})",
)(lambda spark, sf: _distances(spark, sf).withColumn("distance", F.round("distance", 9)))

_SLOPES = f"""SELECT label, vec_id, CASE WHEN b IS NULL THEN a - distance WHEN a IS NULL THEN distance - b ELSE (a - b) / 2 END AS distance
              FROM (SELECT label, vec_id, distance, lag(distance) OVER w AS b, lead(distance) OVER w AS a FROM ({_DISTANCES}) WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""
_LIMITS = {
    "percentile": (_DISTANCES, "quantile_cont(distance, 0.95)"),
    "standard_deviation": (_DISTANCES, "avg(distance) + 3 * stddev_pop(distance)"),
    "interquartile": (_DISTANCES, "avg(distance) + 1.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))"),
    "gradient": (_SLOPES, "quantile_cont(distance, 0.95)"),
}
for _kind in AMOUNTS:
    query(f"semantic_threshold_{_kind}", f"SELECT label, round({_LIMITS[_kind][1]}, 8) AS threshold FROM ({_LIMITS[_kind][0]}) GROUP BY label")(
        lambda spark, sf, kind=_kind: group_thresholds(_distances(spark, sf), "label", "vec_id", kind).withColumn("threshold", F.round("threshold", 8))
    )
query("semantic_topm", f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS n FROM ({_DISTANCES})) WHERE n < 5")(
    lambda spark, sf: top_breakpoints(_distances(spark, sf), "label", "vec_id", 5).select("label", "vec_id")
)


@query(
    "retrieval_topk",
    f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 9) AS score
        FROM (SELECT e.vec_id, {_DOT.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)
        ORDER BY score DESC, vec_id LIMIT 10""",
)
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the greatest dot product with the first: one row is broadcast, ten a task come back."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    best = vectors.join(F.broadcast(asked)).select("vec_id", dot(F.col("embedding"), F.col("q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"), "vec_id", F.round("score", 9).alias("score"))


query("semantic_split")(lambda spark, sf: chunks(table(spark, sf, "documents"), SemanticSplitter(HashedEmbedding(64), chunk_size=200)))
query("embed_documents")(
    lambda spark, sf: spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.transform(embed(F.col("text"), HashedEmbedding(64)), lambda x: F.round(x, 9)).alias("vector"),
    ),
)

# ---- Pages of a PDF file: words with places, as a layout reader gives them ----

_PAGE, _LINE, _TOLERANCE = 60, 6, 3.0
#: Words in lines of _LINE and pages of _PAGE, with tops that differ within a line.
_LAYOUT = rf"""SELECT item_id, text, n // {_PAGE} AS page, 12.0 * (n % {_PAGE} // {_LINE}) + (n % 3) * 0.4 AS top, 12.0 * (n % {_PAGE} // {_LINE}) + 10 AS bottom, 40.0 * (n % {_LINE}) AS x0
              FROM (SELECT item_id, unnest(w) AS text, unnest(range(len(w))) AS n FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark))"""


@query(
    "pdf_pages",
    rf"""WITH words AS ({_LAYOUT}),
        lines AS (SELECT item_id, page, round_even(top / {_TOLERANCE}, 0) AS line, string_agg(text, ' ' ORDER BY x0, text) AS content, min(top) AS top, max(bottom) AS bottom FROM words GROUP BY 1, 2, 3),
        outside AS (SELECT * FROM lines WHERE NOT (36 <= (top + bottom) / 2 AND (top + bottom) / 2 <= 58)),
        blocks AS (SELECT item_id, page, top, content FROM outside UNION ALL SELECT DISTINCT item_id, page, 36.0, '[table]' FROM words),
        pages AS (SELECT item_id, page, string_agg(content, chr(10) ORDER BY top, content) AS content FROM blocks GROUP BY 1, 2)
        SELECT item_id, string_agg('<!-- page -->' || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY 1""",
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to lines, lines outside a table of each page, and pages with their placeholder."""
    place = F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("n", "word")
    words = table(spark, sf_dir, "benchmark").select("item_id", place)
    row = F.floor(F.col("n") % _PAGE / _LINE)
    words = words.select(
        "item_id",
        F.floor(F.col("n") / _PAGE).alias("page"),
        F.col("word").alias("text"),
        (12.0 * row + F.col("n") % 3 * 0.4).alias("top"),
        (12.0 * row + 10).alias("bottom"),
        (40.0 * (F.col("n") % _LINE)).alias("x0"),
    )
    keys = ("item_id", "page")
    tables = words.select(*keys).distinct().select(*keys, F.lit(36.0).alias("top"), F.lit(58.0).alias("bottom"), F.lit("[table]").alias("content"))
    lines = lines_outside_tables(lines_from_words(words, _TOLERANCE, keys), tables, keys)
    blocks = lines.select(*keys, "top", "content").unionByName(tables.select(*keys, "top", "content"))
    return assemble_pages(blocks, keys=("item_id",)).select("item_id", "text")


# ---- Chunks as a table ----


@query(
    "chunk_stats",
    f"""SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(chunk)) AS BIGINT) AS n_chars, CAST(max(length(chunk)) AS INTEGER) AS longest
        FROM ({_group_sql(_PARAGRAPHS, 3, "chr(10)")}) JOIN documents USING (doc_id) GROUP BY lang""",
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.length("chunk")
    return (
        chunks(docs, ParagraphSplitter(3))
        .join(docs.select("doc_id", "lang"), "doc_id")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_chunks"),
            F.countDistinct("doc_id").alias("n_docs"),
            F.sum(n.cast("long")).alias("n_chars"),
            F.max(n).alias("longest"),
        )
    )


@query(
    "chunk_quality",
    f"""SELECT quality, toxic, count(*) AS n_chunks, round(avg(length(chunk)), 6) AS mean_chars
        FROM ({_word_sql(50, 50)}) JOIN labels USING (doc_id) GROUP BY quality, toxic""",
)
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks(table(spark, sf_dir, "documents"), WordSplitter(50))
    return (
        made.join(table(spark, sf_dir, "labels"), "doc_id")
        .groupBy("quality", "toxic")
        .agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("chunk")), 6).alias("mean_chars"))
    )


# ---- Parsers: no SQL form ----

over_documents("recursive_split", lambda: RecursiveCharacterSplitter(800, 80))
over_documents("token_split", lambda: TokenSplitter(200, "regex/words"))


@query("token_split_bpe")
def token_split_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in tokens of a byte-level vocabulary, whose file of ranks is a parameter of the backend."""
    import public_tokenizers

    return chunks(table(spark, sf_dir, "documents"), TokenSplitter(200, f"tiktoken/{public_tokenizers.path('byte_bpe_50k.tiktoken')}"))


over_documents("code_split", lambda: CodeSplitter(600, "python"))
query("header_split")(lambda spark, sf: chunks(table(spark, sf, "pages"), HeaderSplitter(1000, ["Header 1", "Header 2"]), text="html", key="page_id"))
query("html_tag_split")(lambda spark, sf: chunks(table(spark, sf, "pages"), HTMLTagSplitter(600, "p"), text="html", key="page_id"))
query("html_auto_split")(lambda spark, sf: chunks(table(spark, sf, "pages"), HTMLTagSplitter(), text="html", key="page_id"))
query("html_to_markdown")(
    lambda spark, sf: spread(
        table(spark, sf, "pages").select("page_id", "html"), "page_id",
    ).select("page_id", html_to_markdown(F.col("html")).alias("markdown")),
)
#: The body's tags in order; how deep each begins; the most frequent, of these the shallowest, of these the first.
_AUTO_TAG = """WITH t AS (SELECT page_id, unnest(m) AS tag, unnest(range(len(m))) AS n
                        FROM (SELECT page_id, regexp_extract_all(substr(html, strpos(html, '<body') + 5), '</?[a-z][a-z0-9]*') AS m FROM pages)),
               d AS (SELECT page_id, n, regexp_replace(tag, '[</]+', '') AS tag, tag LIKE '</%' AS closes,
                            sum(CASE WHEN tag LIKE '</%' THEN -1 WHEN tag IN ('<br', '<hr', '<img', '<input', '<meta', '<link') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY n) AS depth FROM t),
               c AS (SELECT page_id, tag, count(*) AS times, min(depth) AS depth, min(n) AS n FROM d WHERE NOT closes GROUP BY page_id, tag)
               SELECT page_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY times DESC, depth, n) AS place FROM c) WHERE place = 1"""
query("html_auto_tag", _AUTO_TAG)(
    lambda spark, sf: spread(
        table(spark, sf, "pages").select("page_id", "html"), "page_id",
    ).select("page_id", html_auto_tag(F.col("html")).alias("tag")),
)
# Every object of this table fits one chunk.
query("json_split", "SELECT event_id, 0 AS chunk_index, props AS chunk FROM events WHERE props IS NOT NULL")(
    lambda spark, sf: chunks(table(spark, sf, "events").where("props IS NOT NULL"), RecursiveJSONSplitter(100, 20), text="props", key="event_id"),
)


@query("json_split_nested")
def json_split_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one JSON document."""
    order = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(order)).alias("orders"))).alias("text"))
    return chunks(docs, RecursiveJSONSplitter(300, 100), key="o_custkey")


@query(
    "sql_table_function",
    _character_sql(500, 450),
)
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character splitter as a table function in SQL."""
    from ..functions.sql import register

    register(spark)
    spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").createOrReplaceTempView("chunkspark_documents")
    return spark.sql("SELECT doc_id, s.chunk_index, s.chunk FROM chunkspark_documents, LATERAL char_split(text, 500, 50) s")
