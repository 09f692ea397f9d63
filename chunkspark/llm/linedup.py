"""Line dedup by pairwise alignment.

Documents with equal sequences of lines collapse into their first; the others are deleted whole. For the rest, the evidence
is each run of adjacent lines that just reaches `min_block` words, counted from its first line on or from its last line back:
a line alone where it is long, a frequent short line with its neighbours, which is rare. A run's owner is the smallest
document that has it, and each later document with the run is paired with that owner. Every line of a block that two
documents share, of `min_block` words or more, lies in such a run of the block, however short its lines are, so the later
document meets an earlier holder of each part. A run in n documents makes n - 1 pairs, not n squared, and none is too
frequent to be used.

A pair's documents are aligned by patience diff over the runs that they share, each with its place (runs that are there once
in both and in order, then what is equal around them, then the gaps between in the same way); what only one of them has is
in no common block and does not travel. So a document ships its shared runs once each, whatever its length and the number
of its owners. The lines of aligned runs are deleted from the later document. An exact check follows: a run that the
alignment leaves, since it is there twice or in another order, is in the earlier document as well, and goes too.

Pairs are grouped by (document, owner), and a document's parts are united by a sum, so a document with many owners or an owner
of many documents is spread over tasks. Equal runs and sequences are told by 96 and 128 bits of hashes.

Null text has no lines and stays null. Lines without words never match. Repeated ids: rows of one id are told
apart by a hash of the row. A document that loses all its words is dropped by `dedup_lines`.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE, LOWER, mix, powers, release, session_ready, steps, text_buffer, word_hashes

#: Makes a second hash of a first.
OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tails: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = tops[k - 1] if k else -1
        tails[k : k + 1] = [v]
        tops[k : k + 1] = [i]
    out = []
    i = tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal values in a and b, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once: dict[int, int] = {}
        for k in range(i, m):
            once[a[k]] = -1 if a[k] in once else k
        other: dict[int, int] = {}
        for k in range(j, n):
            other[b[k]] = -1 if b[k] in other else k
        shared = sorted((k, other[v]) for v, k in once.items() if k >= 0 and other.get(v, -1) >= 0)
        anchors = [shared[k] for k in increasing([y for _, y in shared])]
        if not anchors:
            continue
        for x, y in anchors:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, m, j, n))
    return sorted(out)


def runs(n: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of lines with n words each that have `least` words, but not without their last or not
    without their first line; a run lies in one of the documents that begin at the lines `at` (one entry more at the end)."""
    total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    line, sizes = np.arange(len(n)), np.diff(at)
    first, last = np.repeat(at[:-1], sizes), np.repeat(at[1:], sizes)
    end = np.searchsorted(total, total[:-1] + least)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    ahead, back = end <= last, begin >= first
    back[back] = end[begin[back]] != line[back] + 1  # the same run as one ahead
    return np.concatenate([line[ahead], begin[back]]), np.concatenate([end[ahead], line[back] + 1])


def aligned(theirs: set[tuple[int, int]], own: set[tuple[int, int, int]]) -> tuple[set[int], set[int]]:
    """Lines of the later document that go: those of aligned runs, and others of runs that the earlier document has too.

    theirs: (place, run) of the earlier document, each run once; own: (place, run, lines) of the later one.
    """
    places = sorted(own)
    met = {j for _, j in patience([run for _, run in sorted(theirs)], [run for _, run, _ in places])}
    lines = lambda chosen: {x for j in chosen for x in range(places[j][0], places[j][0] + places[j][2])}
    in_order = lines(met)
    return in_order, lines(set(range(len(own))) - met) - in_order


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """row, doc_id, text -> row, doc_id, whole (hash of the sequence of lines), and of the lines that have words: n (words),
    place (number among all lines); runs: hash, more bits of it, first line and number of lines of each run."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for i, j in steps(offsets):
            part, own = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            hashed, starts, _ = word_hashes(part, own)
            # A line's hash takes its words in order, so white space does not matter.
            new = np.flatnonzero(part == 10) + 1
            bounds = np.unique(np.concatenate([own, new]))
            first = np.searchsorted(starts, bounds)
            n_words = np.diff(first)
            have = n_words > 0
            rank = np.arange(len(hashed), dtype=np.uint64) - np.repeat(first[:-1], n_words).astype(np.uint64)
            line = np.add.reduceat(mix(hashed + rank * BASE), first[:-1][have]) if have.any() else np.zeros(0, np.uint64)
            line = mix(line + n_words[have].astype(np.uint64))
            at = np.searchsorted(bounds[:-1][have], own).astype(np.int32)
            n = n_words[have].astype(np.int32)
            number = np.arange(len(bounds) - 1) - np.repeat(np.searchsorted(bounds, own[:-1]), np.diff(np.searchsorted(bounds, own)))
            begin, end = runs(n, at, least)
            by = np.argsort(begin, kind="stable")
            begin, end = begin[by], end[by]
            whole, run, more = sequence_names(line, at), *(spans_of(x, begin, end) for x in (line, mix(line ^ OTHER)))
            shared = pa.StructArray.from_arrays(
                [
                    pa.array(run.view(np.int64)),
                    pa.array(more.astype(np.uint32).view(np.int32)),
                    pa.array((begin - np.repeat(at[:-1], np.diff(np.searchsorted(begin, at)))).astype(np.int32)),
                    pa.array((end - begin).astype(np.int32)),
                ],
                names=["run", "more", "at", "size"],
            )
            lists = lambda values, where=at: pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    whole,
                    lists(pa.array(n)),
                    lists(pa.array(number[have].astype(np.int32))),
                    lists(shared, np.searchsorted(begin, at)),
                ],
                names=["row", "doc_id", "whole", "n", "place", "runs"],
            )
    release()


def spans_of(line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the lines from begin to end, in order."""
    p, inverse = powers(len(line) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * p[:-1], dtype=np.uint64)])
    return mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def sequence_names(line: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits for the lines of each document, null where there are none."""
    begin, end = at[:-1].astype(np.int64), at[1:].astype(np.int64)
    pairs = np.column_stack([spans_of(line, begin, end), spans_of(mix(line ^ OTHER), begin, end)])
    return pa.array([pair.tobytes() if j > i else None for pair, i, j in zip(pairs, begin.tolist(), end.tolist(), strict=True)], pa.binary())


def duplicate_lines(docs: DataFrame, min_block: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_lines, n_words, gone array<int>, n_words_gone, n_moved for each row of `docs`.

    row: a hash of id and text; gone: numbers, from 0, of the lines to delete, in order; lines without words stay.
    n_moved: those of them that no alignment holds, as the passage is there twice or in another order.
    """
    session_ready(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    least = max(1, min_block)
    source = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lined = source.mapInArrow(
        lambda batches: _lines(batches, least),
        f"row long, doc_id {id_type}, whole binary, n array<int>, place array<int>, runs array<struct<run:long,more:int,at:int,size:int>>",
    )
    # What is found for a hash is written before it is joined: the sums then begin in each task, and Spark can split a
    # hash that many rows share.
    # Order: by id, then by row for repeated ids; the smallest of equal sequences is the one that stays.
    lined = lined.withColumn("key", F.struct(F.col("doc_id"), F.col("row"))).checkpoint()
    firsts = lined.where("whole IS NOT NULL").groupBy("whole").agg(F.min("key").alias("first")).checkpoint()
    judged = lined.drop("runs").join(firsts, "whole", "left").withColumn("copy", F.coalesce(F.col("key") != F.col("first"), F.lit(False)))
    alone = lined.join(firsts, "whole").where(F.col("key") == F.col("first")).select("key", F.inline("runs"))
    owner = (
        alone.groupBy("run", "more")
        .agg(F.min(F.struct("key", "at")).alias("o"), F.count("*").alias("times"))
        .where("times > 1")
        .select("run", "more", F.col("o.key").alias("owner"), F.col("o.at").alias("owner_at"))
        .checkpoint()
    )
    common = alone.join(owner, ["run", "more"]).where("key > owner")
    met = common.groupBy("key", "owner").agg(F.collect_list(F.struct("run", "at", "size", "owner_at")).alias("common"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for common in batch.column(1).to_pylist():
                in_order, other = aligned({(x["owner_at"], x["run"]) for x in common}, {(x["at"], x["run"], x["size"]) for x in common})
                found.append([{"g": g, "m": False} for g in in_order] + [{"g": g, "m": True} for g in other])
            kind = pa.list_(pa.struct([("g", pa.int32()), ("m", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["key", "lines"])
        release()

    cut = met.select("key", "common").mapInArrow(align, f"key struct<doc_id:{id_type},row:bigint>, lines array<struct<g:int,m:boolean>>")
    # A line is moved if no pair aligns it.
    cut = (
        cut.select("key", F.inline("lines"))
        .groupBy("key", "g")
        .agg(F.min("m").alias("m"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("g")).alias("gone"), F.count(F.when(F.col("m"), 1)).alias("n_moved"))
    )
    out = judged.join(cut, "key", "left")
    out = out.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    out = out.withColumn("n_words", total(F.col("n"))).withColumn(
        "n_words_gone", F.when(F.col("copy"), F.col("n_words")).otherwise(total(F.transform("gone", lambda g: F.get("n", g)))),
    )
    gone = F.when(F.col("copy"), F.col("place")).otherwise(F.transform("gone", lambda g: F.get("place", g)))
    return out.select(
        "row",
        "doc_id",
        F.size("n").cast("long").alias("n_lines"),
        "n_words",
        gone.alias("gone"),
        "n_words_gone",
        F.coalesce("n_moved", F.lit(0)).cast("long").alias("n_moved"),
    )


#: The report for DuckDB, over the table `documents`: copies of whole sequences of lines, and runs of lines that just reach
#: ten words and that a document with a smaller id has.
SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
                  list_filter(list_transform(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)),
                                             lambda x: regexp_extract_all(x, '[^\x20\x09-\x0D]+')), lambda x: len(x) > 0) AS lines FROM documents),
w AS (SELECT *, min(r) OVER (PARTITION BY lines) < r AND len(lines) > 0 AS copied FROM d),
l AS (SELECT r, unnest(range(1, len(lines) + 1)) AS k, unnest(list_transform(lines, lambda x: len(x))) AS n FROM w WHERE NOT copied),
c AS (SELECT r, k, n, sum(n) OVER (PARTITION BY r ORDER BY k) AS upto FROM l),
runs AS (SELECT a.r, a.k AS i, b.k AS j FROM c a JOIN c b ON a.r = b.r AND b.k BETWEEN a.k AND a.k + 9
         WHERE b.upto - a.upto + a.n >= 10 AND (b.upto - a.upto + a.n - b.n < 10 OR b.upto - a.upto < 10)),
named AS (SELECT runs.r, i, j, list_transform(lines[i : j], lambda x: array_to_string(x, ' ')) AS run FROM runs JOIN w USING (r)),
later AS (SELECT r, i, j FROM (SELECT r, i, j, min(r) OVER (PARTITION BY run) AS owner FROM named) WHERE owner < r),
gone AS (SELECT DISTINCT r, unnest(range(i, j + 1)) AS k FROM later),
lost AS (SELECT r, count(*) AS m, sum(n) AS words FROM gone JOIN l USING (r, k) GROUP BY r),
t AS (SELECT doc_id, len(lines) AS n_lines, len(flatten(lines)) AS n_words, copied, coalesce(m, 0) AS m, coalesce(words, 0) AS words FROM w LEFT JOIN lost USING (r)),
u AS (SELECT doc_id, n_lines, CASE WHEN copied THEN n_lines ELSE m END AS n_lines_gone, n_words, CASE WHEN copied THEN n_words ELSE words END AS n_words_gone FROM t)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines_gone AS BIGINT) AS n_lines_gone, CAST(n_words AS BIGINT) AS n_words,
       CAST(n_words_gone AS BIGINT) AS n_words_gone, n_words = 0 OR n_words_gone < n_words AS kept FROM u
"""


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_lines_gone, n_words, n_words_gone, kept (words are left, or there were none)."""
    d = duplicate_lines(docs)
    return d.select(
        "doc_id",
        "n_lines",
        F.size("gone").cast("long").alias("n_lines_gone"),
        "n_words",
        "n_words_gone",
        ((F.col("n_words") == 0) | (F.col("n_words_gone") < F.col("n_words"))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, without the deleted lines, and without documents that lost all words."""
    found = duplicate_lines(docs, id_col=id_col, text_col=text_col, **options)
    lost = (
        found.where(F.size("gone") > 0)
        .select(
            F.col("row").alias("__linedup_row"),
            F.col("doc_id").alias("__linedup_id"),
            F.col("gone").alias("__linedup_gone"),
            (F.col("n_words_gone") >= F.col("n_words")).alias("__linedup_all"),
        )
        .dropDuplicates(["__linedup_row", "__linedup_id"])
    )
    same = (F.col("__linedup_key") == F.col("__linedup_row")) & F.col(id_col).eqNullSafe(F.col("__linedup_id"))
    d = (
        docs.withColumn("__linedup_key", F.xxhash64(id_col, text_col))
        .join(lost.hint("shuffle_hash"), same, "left")
        .where("__linedup_all IS NULL OR NOT __linedup_all")
    )
    split = F.split(text_col, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "__linedup_gone"), lambda i: F.get(split, i))
    return d.withColumn(
        text_col, F.when(F.col("__linedup_gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col)),
    ).select(*[f"`{c}`" for c in docs.columns])
