"""Helpers shared by the training-data operators: Arrow text buffers, word tables, hashing, checkpoints, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The class of a word character in Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that one numpy step handles; a longer document is one step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_ready(spark: SparkSession) -> None:
    """Small Arrow batches, as texts can be long, unless the session sets their size itself; and a checkpoint folder, where
    the cluster names none."""
    given = spark.conf.getAll
    for key, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}.items():
        if key not in given:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chunkspark-"))


def written(df: DataFrame) -> DataFrame:
    """The rows from a table that is written now, beside the checkpoints in the shared folder. Other than a checkpoint, which
    keeps the estimates of the plan it cuts, the table has its true size, so estimates do not multiply from round to round."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of `written`, once nothing reads it any more."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(df.written_to)
    folder.getFileSystem(context).delete(folder, True)


def release() -> None:
    """Give memory that a task has freed back to the system, so that workers that wait for the next task hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_groups(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts that have at most `limit` characters together, or of one longer text."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `limit` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one entry more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = IS_SPACE[data]
    inside = ~space
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        m = max(n, STEP_BYTES + 1)
        for k, base in enumerate((BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in BASE; span_hash() takes any span's hash from them."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); they depend on the bytes alone, not on where they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Edges of a task that are united at once; a graph of no more is settled by one task.
UNITED = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their component in the graph of the edges (u, v), for all but the smallest."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _united(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars around the smallest nodes."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            yield out()
    if held:
        yield out()


def connected(edges: DataFrame, rounds: int = 60, most: int = UNITED) -> DataFrame:
    """Connected components by alternating large-star and small-star steps; between them each task unites its own edges.

    `edges`: long columns a, b. Returns (node, root) with the smallest node of each component as root, for every
    node of an edge between two different nodes. Each round ends in a written table, so a lost executor costs one
    round, and the tables of the round before are deleted; the driver only learns whether there is more to do.
    """

    def united(pairs: DataFrame) -> tuple[DataFrame, bool]:
        """The edges after each task has united its own, and whether that was one task."""
        once = written(pairs.where("u <> v").distinct())
        tasks = max(1, -(-once.count() // most))
        out = written(once.coalesce(tasks).mapInArrow(lambda batches: _united(batches, most), "u long, v long"))
        forget(once)
        return out, tasks == 1

    e, settled = united(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(rounds):
        if settled:
            break
        # Done when each node has one edge, and a node that others lead to has none.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leads"), F.lit(0).alias("led")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("leads").alias("leads"), F.max("led").alias("led")).where("leads + led > 1").isEmpty():
            break
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written before they are joined, so Spark can split the rows of a node with many neighbours.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old = (e, low, large, least)
        e, settled = united(small)
        for table_ in old:
            forget(table_)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stretches(data: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end after white space, so no word is cut; a longer word stays whole."""
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + limit)
        while j < n and not IS_SPACE[data[j - 1]]:
            near = np.flatnonzero(IS_SPACE[data[j : j + 65536]])
            j = j + int(near[0]) + 1 if len(near) else min(n, j + 65536)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, their starts, and each row's first word (one entry more at the end).

    A long text is hashed stretch by stretch, so what is held besides does not grow with it.
    """
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in stretches(data):
        inner = offsets[np.searchsorted(offsets, i, "right") : np.searchsorted(offsets, j)]
        a, b, _ = words(data[i:j], np.concatenate([[0], inner - i, [j - i]]))
        hashes.append(span_hash(prefix_hash(data[i:j]), a, b))
        starts.append(a + i)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.searchsorted(starts, offsets)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
