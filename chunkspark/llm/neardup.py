"""MinHash near-duplicates by a multi-index Hamming join.

1. Every document gets the set of its distinct word shingles (64-bit hashes) and a signature of SLOTS minima of
   16 bits. Documents with equal sets form a class with one representative, so copies of a text meet once.
2. Two signatures at distance T or less in slots agree, by pigeonhole, in one of the CHUNKS chunks up to
   T // CHUNKS errors. A chunk is entered under a key for each way of leaving so many of its slots out; so every
   pair under the threshold shares a key. T is chosen so that a pair at the wanted similarity is beyond it with
   a chance below 1e-4.
3. In each key's rows the signatures are compared, and only a forest of the pairs within T leaves the task. A key
   with more than KEY_BLOCK rows is cut into blocks that meet pairwise. Connected components of these give coarse groups.
4. The sets of a coarse group meet, and the pairs within T are confirmed on the full sets, nearest first; pairs that are
   connected already are skipped. A group of BLOCK members or less meets in one task. In a larger one each block of members
   meets the same PIVOTS members of the group, which connects most of it: copies of a page are near to some pivot. What is
   not connected with the group's largest part then, the rest, meets that part and itself in blocks. So texts travel
   1 + PIVOTS / BLOCK times, and once more for each block of the rest; no task holds an unbounded group and no pair is lost.

A document with fewer words than a shingle has its whole sequence as one shingle; null, empty and blank texts
have no shingle and link with nothing. Each row counts, also where ids or whole rows repeat. A row with a null id is linked
as any other and gets its component's smallest id; where no row of a component has an id, that is null, and the row with
the least hash is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER, connected, mix, release, session_ready, steps, text_buffer, word_hashes, written

SLOTS, CHUNKS = 32, 8
#: Members of a coarse group, and rows of a key, that meet in one task; larger ones meet in pairs of such blocks.
BLOCK = 512
PIVOTS = 64
KEY_BLOCK = 4096
_ODD = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, SLOTS + 1001, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, with A-Z as a-z."""
    own, _, first = word_hashes(LOWER[data], offsets)
    if not len(own):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    grams = np.zeros(len(own), np.uint64)
    for k in range(width):  # a shingle's hash takes its words in order
        part = own[k : len(own) - width + 1 + k]
        grams[: len(part)] = mix(grams[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(grams[i : j - width + 1]))
        elif j > i:
            h = np.uint64(j - i)
            for w in own[i:j]:
                h = mix(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SLOTS minima of each set (none empty), 16 bits each."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), SLOTS), np.uint16)
    for k in range(SLOTS):
        x = flat * _ODD[k] + _ADD[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (mix(np.minimum.reduceat(x, at)) >> np.uint64(48)).astype(np.uint16)
    return out


def threshold(similarity: float, slots: int = SLOTS, chunks: int = CHUNKS) -> int:
    """The greatest signature distance that the keys guarantee: one error less than two in every chunk."""
    limit = 2 * chunks - 1
    p = 1 - similarity
    beyond = sum(math.comb(slots, k) * p**k * (1 - p) ** (slots - k) for k in range(limit + 1, slots + 1))
    if beyond > 1e-3:
        raise ValueError(f"similarity {similarity} is too low for signatures of {slots} slots")
    return limit


def keys(signs: np.ndarray) -> np.ndarray:
    """(n, SLOTS): for each slot the hash of the rest of its chunk, which leaves that slot's error out."""
    n, width = len(signs), SLOTS // CHUNKS
    wide = signs.astype(np.uint64).reshape(n, CHUNKS, width)
    out = np.empty((n, CHUNKS, width), np.uint64)
    for left in range(width):
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64)[None] * np.uint64(width) + np.uint64(left + 1), (n, CHUNKS)).copy()
        for k in range(width):
            if k != left:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
        out[:, :, left] = h
    return out.reshape(n, SLOTS)


def set_name(s: np.ndarray) -> bytes:
    """Two 64-bit sums over the mixed members, and the size, name a set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


def forest(signs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that connect, within the rows, what pairs within the limit connect."""
    left = np.arange(len(signs))
    out: list[tuple[int, int]] = []
    while len(left) > 1:  # grow one component at a time: each row becomes the pivot once
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            near = (signs[left] != signs[p := todo.pop()]).sum(axis=1) <= limit
            out += [(p, int(x)) for x in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return out


def linked(sets: list[np.ndarray], signs: np.ndarray, limit: int, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs within the limit whose full sets are similar; rows of equal labels are connected already."""
    n = len(sets)
    own = [set(s.tolist()) for s in sets]
    label = np.arange(n) if label is None else label.copy()
    out: list[tuple[int, int]] = []
    # Documents near to many others first: they connect a group with the fewest comparisons.
    sizes = np.array([len(s) for s in sets])
    close = [((signs[max(0, i - 64) : i + 64] != signs[i]).sum(axis=1) <= limit // 2).sum() for i in range(n)]
    order = np.argsort(-np.array(close), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for i in order.tolist():
        rest = np.flatnonzero((rank > rank[i]) & (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        if not len(rest):
            continue
        far = (signs[rest] != signs[i]).sum(axis=1)
        rest = rest[far <= limit][np.argsort(far[far <= limit], kind="stable")]
        a = own[i]
        for j in rest.tolist():
            if label[j] == label[i]:
                continue
            both = len(a & own[j])
            if 100 * both >= percent * (len(a) + len(own[j]) - both):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


#: The same for DuckDB at a similarity of 0.85, over the table `documents`: all pairs of texts that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT r, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r)
          JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS x FROM w UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.x = edges.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN w ON reach.x = w.r GROUP BY reach.r) USING (r)
"""


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; a component's smallest id is kept."""
    return near_rows(docs, similarity, width, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: the first of each component, and those without shingles."""
    found = written(near_rows(docs, similarity, width, id_col, text_col))
    gone = found.where("NOT first").select(F.col("doc_id").alias("__near_id"), F.col("row").alias("__near_row")).distinct()
    keyed = docs.withColumn("__near_key", F.xxhash64(id_col, text_col))
    same = lambda other: (F.col("__near_key") == other["__near_row"]) & F.col(id_col).eqNullSafe(other["__near_id"])
    left = keyed.join(gone.hint("shuffle_hash"), same(gone), "left_anti")
    # Whole rows that repeat are equal firsts; only where there are some, one of each is picked.
    again = found.where("first AND n_shingles > 0").groupBy(F.col("doc_id").alias("__near_id"), F.col("row").alias("__near_row")).count().where("count > 1")
    if not again.isEmpty():
        once = Window.partitionBy("__near_key", id_col).orderBy(F.lit(1))
        left = left.withColumn("__near_n", F.row_number().over(once)).join(again, same(again), "left").where("count IS NULL OR __near_n = 1")
    return left.select(*[f"`{c}`" for c in docs.columns])


def near_rows(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, component_id, kept, first for each row. first: the one row of its
    component that stays if there is to be one."""
    spark = docs.sparkSession
    session_ready(spark)
    percent, limit = round(100 * similarity), threshold(similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                have = [k for k, s in enumerate(sets) if len(s)]
                marks: list = [None] * len(sets)
                names: list = [None] * len(sets)
                if have:
                    for k, s in zip(have, signatures([sets[k] for k in have]), strict=True):
                        marks[k] = s.tobytes()
                        names[k] = set_name(sets[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array(marks, pa.binary()),
                    ],
                    names=["doc_id", "row", "n_shingles", "name", "sign"],
                )
        release()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    signed = written(source.mapInArrow(sign, "doc_id long, row long, n_shingles long, name binary, sign binary"))
    # A class is named by a number, `rep`, which is written here once; least: its smallest id; some row stands for it.
    classes = (
        signed.where("name IS NOT NULL")
        .groupBy("name")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row")).alias("at"), F.first("sign").alias("sign"))
    )
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), SLOTS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys(signs).reshape(-1).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)],
                names=["key", "rep", "sign"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b) of the keys' forests; or, for a key with too many rows, its rows with their blocks."""
        held: list[tuple[int, int, bytes]] = []
        found: set[tuple[int, int]] = set()
        passed: list[tuple[int, int, bytes, int]] = []
        block = 0

        def close() -> None:
            """The end of a key."""
            nonlocal block
            if block:
                passed.extend((*row, block) for row in held)
            elif len(held) > 1:
                signs = np.frombuffer(b"".join(s for _, _, s in held), np.uint16).reshape(-1, SLOTS)
                found.update((held[b][1], held[a][1]) for a, b in forest(signs, limit))
            held.clear()
            block = 0

        def out() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            key, rep, sign, at = zip(*passed, strict=True) if passed else ((), (), (), ())
            none = [None] * len(key)
            columns = [
                pa.array([*a, *rep], pa.int64()),
                pa.array([*b, *none], pa.int64()),
                pa.array([*[None] * len(a), *key], pa.int64()),
                pa.array([*[None] * len(a), *sign], pa.binary()),
                pa.array([*[None] * len(a), *at], pa.int32()),
            ]
            found.clear()
            passed.clear()
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "sign", "block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = np.zeros(len(key), bool)  # rows whose neighbour has the same key
            same[1:] = key[1:] == key[:-1]
            alike = same.copy()
            alike[:-1] |= same[1:]
            alike[[0, -1]] = True  # a key may go on in the next batch
            where = np.flatnonzero(alike)
            reps, signs = batch.column(1).take(pa.array(where)).to_pylist(), batch.column(2).take(pa.array(where)).to_pylist()
            for row in zip(key[where].tolist(), reps, signs, strict=True):
                if held and held[-1][0] != row[0]:
                    close()
                elif len(held) == KEY_BLOCK:
                    passed.extend((*x, block) for x in held)
                    held = held[-1:]  # the key stays known; this row is in two blocks, which does no harm
                    block += 1
                held.append(row)
            if len(found) + len(passed) > 50_000:
                yield out()
        close()
        if found or passed:
            yield out()

    def meet_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(rows["sign"]), np.uint16).reshape(-1, SLOTS)
        reps = rows["a"].to_numpy()
        return pd.DataFrame([(reps[j], reps[i]) for i, j in forest(signs, limit)], columns=["a", "b"], dtype="int64")

    entered = classes.select("rep", "sign").mapInArrow(enter, "key long, rep long, sign binary")
    met = entered.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, key long, sign binary, block int")
    met = written(met)
    crowded = met.where("key IS NOT NULL")
    last = crowded.groupBy("key").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0), "last")).alias("other")
    pairs = crowded.join(last, "key").select("a", "sign", "key", "block", other).where("block <> other")
    pairs = pairs.select("a", "sign", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    near = (
        met.where("b IS NOT NULL")
        .select("a", "b")
        .unionByName(pairs.groupBy("key", "x", "y").applyInPandas(lambda key, rows: meet_blocks(rows), "a long, b long"))
        .distinct()
    )
    groups = connected(near).withColumnsRenamed({"node": "rep", "root": "grp"})

    # The members' sets meet by coarse group.
    count = groups.groupBy("grp").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        groups.join(count, "grp")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        .join(classes.select("rep", "name", "at"), "rep")
    )
    placed = written(placed)

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        # A row of a class for each text that has its place; one is enough, and pivots are in their own block anyway.
        rows = rows.drop_duplicates("rep").sort_values("rep", kind="stable")
        data, offsets = text_buffer(pa.array(rows["text"], pa.large_string()))
        sets: list[np.ndarray] = []
        for i, j in steps(offsets):
            sets += shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        keep = [k for k, (s, name) in enumerate(zip(sets, rows["name"], strict=True)) if len(s) and set_name(s) == name]
        ids, sets = rows["rep"].to_numpy()[keep], [sets[k] for k in keep]
        if not keep:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        label = np.unique(rows["label"].to_numpy()[keep], return_inverse=True)[1].reshape(-1)
        edges = linked(sets, signatures(sets), limit, percent, label)
        return pd.DataFrame({"a": [ids[i] for i, _ in edges], "b": [ids[j] for _, j in edges]}, dtype="int64")

    def meet_texts(members: DataFrame) -> DataFrame:
        """Edges among the members (rep, name, at, label) that have equal grp, x and y."""
        at = members.select("grp", "x", "y", "rep", "name", "label", F.col("at.doc_id").alias("at_id"), F.col("at.row").alias("at_row"))
        texts = source.join(
            at, (F.col("row") == F.col("at_row")) & F.col("doc_id").eqNullSafe(F.col("at_id")),
        ).select("grp", "x", "y", "rep", "name", "label", "text")
        # A fixed number of partitions: these tasks compute more than they read, and should not be put together.
        texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp", "x", "y")
        return texts.groupBy("grp", "x", "y").applyInPandas(confirm, "a long, b long")

    own = placed.withColumn("x", F.col("part")).withColumn("y", F.lit(0))
    is_pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("rep", F.lit(1)), "n") < PIVOTS)
    pivots = placed.where(is_pivot).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("y", F.lit(0))
    links = written(meet_texts(own.unionByName(pivots).withColumn("label", F.col("rep"))))
    large = placed.where("parts > 1")
    if not large.isEmpty():
        labelled = large.join(
            connected(links).withColumnsRenamed({"node": "rep", "root": "label"}), "rep", "left",
        ).withColumn("label", F.coalesce("label", "rep"))
        size = labelled.groupBy("grp", "label").agg(F.count("*").alias("m"))
        most = size.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("m"))
        labelled = labelled.join(most, "grp").withColumn("rests", F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int")).where("rests > 0")
        # Blocks of the rest, x from 0 on, meet blocks of the main part, y from 0 on, and one another, y below 0.
        rest = labelled.where("label <> main").withColumn("x", F.pmod(F.xxhash64("rep", F.lit(2)), "rests").cast("int"))
        every = lambda low, high: F.explode(F.sequence(low, high))
        rest_main = rest.withColumn("y", every(F.lit(0), F.col("parts") - 1))
        main = labelled.where("label = main").withColumn("y", F.col("part")).withColumn("x", every(F.lit(0), F.col("rests") - 1))
        other = (
            rest.withColumn("z", every(F.lit(0), F.col("rests") - 1))
            .withColumn("y", -1 - F.greatest("x", "z"))
            .withColumn("x", F.least("x", "z"))
            .drop("z")
        )
        links = written(links.unionByName(meet_texts(rest_main.unionByName(main, allowMissingColumns=True).unionByName(other))))
    # Each class gets its component: the number of a class of it, its smallest id, and the row that comes first in it.
    member = (
        classes.join(connected(links).withColumnsRenamed({"node": "rep"}), "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
        .select("name", "root")
    )
    rows = signed.where("name IS NOT NULL").select("doc_id", "row", "n_shingles", "name").join(member, "name").drop("name")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = rows.groupBy("root").agg(F.min(place).alias("head")).select(F.col("root").alias("component"), "head")
    heads = written(heads)
    rows = rows.join(heads, F.col("root") == F.col("component"))
    rows = rows.select("doc_id", "row", "n_shingles", F.col("head.doc_id").alias("component_id"), (place == F.col("head")).alias("first"))
    alone = signed.where("name IS NULL").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("first")))
