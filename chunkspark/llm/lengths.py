"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit.

Documents are encoded by a byte-level BPE vocabulary, whose file is a parameter. A text is cut after each run of
non-space characters, where the vocabulary's pattern always cuts, and equal parts are counted once, so a part's
tokens are found once a task. One row a distinct length leaves each task; with suffix sums over the
lengths a row says, for the limit L equal to its length, how many documents and tokens are above it, what is left
after truncation to L, and where in the order of lengths it stands; a limit between two lengths follows from the
next greater row (`totals_at`).

Null text is empty, of length 0. Repeated ids count each time. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import release, session_ready, steps, text_buffer, text_groups

#: White space of the vocabulary's pattern: Python's, without U+001C to U+001F.
PARTS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Where a text can be cut: after a character that is no white space, before one that is.
CUT = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
#: Parts kept between calls, and the characters that such a part has at most; characters of texts that are cut at once.
KEPT, SHORT = 200_000, 64
SLICE = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Counter:
    """Numbers of tokens of whole texts; the numbers of at most about KEPT short parts are kept between calls."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for i, j in text_groups(texts, SLICE):
            if j > i + 1:
                out += self._count([t or "" for t in texts[i:j]])
            else:
                out.append(sum(self._count([piece])[0] for piece in _slices(texts[i] or "")))
        return out

    def _count(self, texts: list[str]) -> list[int]:
        cut = [PARTS.findall(t) for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = set().union(*cut) - self.kept.keys()
        numbers = {p: len(self.encoding.encode_ordinary(p)) for p in new}
        self.kept.update((p, n) for p, n in numbers.items() if len(p) <= SHORT)
        return [sum([(numbers if len(p) > SHORT else self.kept)[p] for p in parts]) for parts in cut]


def _slices(text: str) -> Iterator[str]:
    i = 0
    while i < len(text):
        m = CUT.search(text, i + SLICE)
        j = m.start() if m else len(text)
        yield text[i:j]
        i = j


def token_lengths(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and n_tokens of each row."""
    session_ready(docs.sparkSession)
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    # Bounded by the vocabulary file.
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        for batch in batches:
            column = batch.column(1)
            _, offsets = text_buffer(column)
            for i, j in steps(offsets, 2 * SLICE):
                numbers = counter.count(column.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(numbers, pa.int64())], names=[id_col, "n_tokens"])
        counter.kept.clear()
        release()

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row a distinct length (column n_tokens): limit, n_docs, n_tokens, docs_within, docs_above, tokens_above,
    truncated_total, quantile (share of documents of at most this length)."""
    counted = lengths.groupBy(F.col("n_tokens").alias("limit")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).checkpoint()
    # Suffix sums in two steps: over the blocks of lengths, then within each block. A block holds the lengths with one whole
    # square root, so blocks are as many as lengths in the largest, and short lengths, which are most, are spread out.
    counted = counted.withColumn("block", F.floor(F.sqrt("limit")))
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("bd"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("bt"),
        F.sum("bd").over(whole).alias("all_docs"),
        F.sum("bt").over(whole).alias("all_tokens"),
    )
    above = Window.partitionBy("block").orderBy(F.desc("limit")).rowsBetween(Window.unboundedPreceding, -1)
    h = counted.join(blocks, "block")
    h = h.withColumn("docs_above", F.col("bd") + F.coalesce(F.sum("n_docs").over(above), F.lit(0)))
    h = h.withColumn("tokens_above", F.col("bt") + F.coalesce(F.sum("n_tokens").over(above), F.lit(0)))
    within = F.col("all_docs") - F.col("docs_above")
    return h.select(
        "limit",
        "n_docs",
        "n_tokens",
        within.alias("docs_within"),
        "docs_above",
        "tokens_above",
        (F.col("all_tokens") - F.col("tokens_above") + F.col("docs_above") * F.col("limit")).alias("truncated_total"),
        (within / F.col("all_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limit: int) -> DataFrame:
    """docs_above, tokens_above, truncated_total for any limit: one row."""
    over = F.col("limit") > limit
    return histogram.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum(F.when(over, F.col("n_tokens"))), F.lit(0)).alias("tokens_above"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs") * limit).otherwise(F.col("n_tokens"))), F.lit(0)).alias("truncated_total"),
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least `share` of the documents do not exceed: one row, null without documents."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("limit").alias("length"))


def length_report(docs: DataFrame) -> DataFrame:
    return length_histogram(token_lengths(docs))
