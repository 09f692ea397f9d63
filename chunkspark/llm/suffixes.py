"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same document. Nothing is sampled; equal strings are brought together by what they contain.

1. Each LENGTH-byte window has an anchor: the least hash among its K-byte pieces, the leftmost of equals. Equal windows
   have equal anchors. Neighbouring windows with one anchor form a segment. The hashes of segments are dealt out by
   those of their anchors. An anchor that occurs once can't be in a repeated window. Of equal segments all but the
   earliest are repeats as a whole; these are told by their hashes, without a transform.
2. Only the earliest segments of anchors with different segments are left to compare. Their bytes are dealt out.
3. The different segments of an anchor are the strings of a collection, cut into shards. The alphabet is the
   STRIDE-byte blocks of the text, so a suffix steps by one block and LENGTH bytes are DEPTH symbols. Symbols are ranks of
   the blocks' hashes: it is an order of suffixes, but not the alphabetical one of their bytes, which equality of
   substrings does not need. Each shard gets its Burrows-Wheeler transform by prefix doubling. The transforms are merged
   by refining their interleave: from the order of all suffixes by h symbols, each transform's next symbols give the
   order by h + 1, with no suffix sorted again; a border that is new between neighbours says that their common prefix is h.
   The repeated intervals are the maximal runs of neighbours whose common prefix is DEPTH symbols; all but the earliest of
   an interval are repeats.
4. A document's repeated windows are united to removed runs.

A collection of everything in one order would bring no more to light: strings of different anchors differ. So each group of
anchors is merged for itself, and the groups are dealt out.

Hot groups: equal segments collapse in each task before anything is sent. A first pass finds the anchors with more
than HOT different segments (and more than a 100,000th of all, so there are 100,000 at most); their windows are dealt
out one by one by the hash of the whole window, so a passage that a third of all documents share, with different text
around it, is spread over all tasks. Segments travel in rows of a bucket, gathered over HELD of them in a task.
Comparison is by 64-bit hashes: four blocks, or an anchor and its segment.

Null text is empty. Rows of one id are ordered by a hash of the text; equal rows get the same result, as one
document. A null id comes before all others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, prefix_hash, release, session_ready, span_hash, steps, text_buffer

LENGTH = 100
STRIDE = 25
DEPTH = LENGTH // STRIDE
K = 28
HOT = 1 << 16
STEP = 2 << 20
#: Segments, and bytes of segments, that a task gathers before it deals them out.
HELD, HELD_BYTES = 500_000, 8 << 20
#: Suffixes of a shard, and shards that are merged at once.
SHARD, SHARDS = 1 << 17, 8
SALT = np.uint64(0xD6E8FEB86659FD93)


def segments(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """hash of the anchor, row, start in the row and number of windows of each segment."""
    n = len(data)
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(3)))
    if n < LENGTH:
        return none
    at = np.arange(n - K + 1)
    hashes = span_hash(prefix, at, at + K)
    low = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    wide = LENGTH - K + 1  # pieces in a window
    size = 1
    while 2 * size <= wide:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for each window start
    lengths = np.diff(offsets)
    end = np.repeat(offsets[1:], lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= end
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return none
    # A run ends before the next one, or where windows leave the row.
    row = np.searchsorted(offsets, starts, "right") - 1
    last = np.append(starts[1:], len(anchor))
    last = np.minimum(last, offsets[row + 1] - LENGTH + 1)
    return hashes[anchor[starts]], row.astype(np.int32), (starts - offsets[row]).astype(np.int32), (last - starts).astype(np.int32)


def parts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, where the first row's bytes begin): steps of rows, a long row in several parts that
    overlap, so each window begins in one of them."""
    for i, j in steps(offsets, STEP):
        for base in range(0, max(1, int(offsets[j] - offsets[i])), STEP) if j == i + 1 else (0,):
            lo = offsets[i] + base
            hi = min(offsets[j], lo + STEP + LENGTH - 1) if j == i + 1 else offsets[j]
            yield i, data[lo:hi], offsets[i : j + 1] - lo if j > i + 1 else np.array([0, hi - lo]), base


def dealt(
    bucket: np.ndarray,
    ids: np.ndarray,
    rows: np.ndarray,
    columns: dict[str, np.ndarray],
    data: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> pa.RecordBatch:
    """One row a bucket: the ids and rows of its documents, each entry's document among them (local), the entries' columns,
    and with `data` (bytes, begin, size) the bytes of each."""
    by = np.lexsort((rows, ids, bucket))
    bucket, ids, rows = bucket[by], ids[by], rows[by]
    new = np.append(True, bucket[1:] != bucket[:-1])
    pair = new | np.append(True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]))
    number = np.cumsum(pair) - 1
    local = number - np.repeat(number[new], np.diff(np.append(np.flatnonzero(new), len(by))))
    ends = np.append(np.flatnonzero(new)[1:], len(by))
    pair_ends = number[ends - 1] + 1
    out = {
        "bucket": pa.array(bucket[new].astype(np.int32)),
        "ids": _binary(ids[pair], pair_ends),
        "rows": _binary(rows[pair], pair_ends),
        "local": _binary(local.astype(np.int32), ends),
    }
    out |= {name: _binary(values[by], ends) for name, values in columns.items()}
    if data:
        text, begin, size = data[0], data[1][by], data[2][by]
        total = np.cumsum(size)
        out["bytes"] = _binary(text[np.repeat(begin - (total - size), size) + np.arange(total[-1])], total[ends - 1])
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


class Transform:
    """The Burrows-Wheeler transform of a shard: suffixes in order, the symbol before each, 0 where there is none."""

    def __init__(self, symbol: np.ndarray, follow: np.ndarray):
        """symbol: above 0, for each suffix; follow: the suffix one symbol on, -1 at the end of a string."""
        n = len(symbol)
        ends = np.flatnonzero(follow < 0)
        m = len(ends)
        rank = np.concatenate([np.arange(m), symbol.astype(np.int64) + m])  # the ends' own suffixes come first
        step = np.concatenate([np.arange(m), np.where(follow < 0, 0, follow + m)])
        step[m + ends] = np.arange(m)
        has = np.ones(n + m, bool)
        has[:m] = False
        _, rank = np.unique(rank, return_inverse=True)
        while True:  # prefix doubling
            key = rank.astype(np.int64) * (n + m + 1) + np.where(has, rank[step] + 1, 0)
            _, finer = np.unique(key, return_inverse=True)
            if finer.max(initial=0) == rank.max(initial=0):
                break
            rank, has, step = finer, has & has[step], step[step]
        self.order = np.argsort(rank, kind="stable")  # places in the ends, then in the suffixes
        before = np.zeros(n + m, np.int64)
        before[m + follow[follow >= 0]] = symbol[follow >= 0]
        before[:m] = symbol[ends]
        self.before = before[self.order]
        self.ends = m


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards by `depth` symbols: for each rank its shard and block; and the common prefixes.

    Blocks hold suffixes with equal first `depth` symbols. common[r]: symbols that rank r shares with rank r - 1, at
    most `depth`. A suffix at the shard's place k is the k-th of its shard in the interleave.
    """
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), [t.ends for t in shards])
    ends = len(which)
    rest = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(t.order) - t.ends for t in shards])
    total = ends + len(rest)
    which = np.concatenate([which, rest])
    # No symbol: all are one block. From then on each end, a symbol of its own, has its block.
    block = np.zeros(total, np.int64)
    common = np.full(total, depth, np.int8)
    common[: ends + 1] = 0
    before = np.concatenate([t.before for t in shards]) if shards else np.zeros(0, np.int64)
    for h in range(depth):
        place = np.argsort(which, kind="stable")  # the ranks of shard 0 in order, then those of shard 1
        symbol = np.empty(total, np.int64)
        symbol[place] = before
        real = np.flatnonzero(symbol)
        order = real[np.argsort(symbol[real], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[order[1:]] != symbol[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        which = np.concatenate([which[:ends], which[order]])
        block = np.concatenate([np.arange(ends), ends + np.cumsum(new) - 1])
        fresh = np.concatenate([np.zeros(ends, bool), new]) & (common == depth)
        common[fresh] = h
    return which, block, common


def repeated_windows(pieces: np.ndarray, lengths: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For strings of bytes, one after another: the interval of equal LENGTH-byte windows of every place, -1 where no
    window begins or it is found once."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = len(pieces)
    out = np.full(n, -1, np.int64)
    left = np.repeat(starts[1:], lengths) - np.arange(n)
    at = np.flatnonzero(left >= STRIDE)
    if not len(at):
        return out
    number = np.full(n, -1, np.int64)
    number[at] = np.arange(len(at))
    _, symbol = np.unique(span_hash(prefix_hash(pieces), at, at + STRIDE), return_inverse=True)
    symbol = symbol.reshape(-1) + 1
    follow = np.where(left[at] >= 2 * STRIDE, number[np.minimum(at + STRIDE, n - 1)], -1)
    # Shards end between strings.
    string = np.repeat(np.arange(len(lengths)), lengths)[at]
    cut = np.searchsorted(string, string[np.arange(0, len(at), shard)])
    cut = np.append(np.unique(cut), len(at))
    transforms = [Transform(symbol[i:j], np.where(follow[i:j] < 0, -1, follow[i:j] - i)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    which, _, common = merge(transforms, DEPTH)
    # Intervals of neighbours that share DEPTH symbols, numbered in order.
    interval = np.cumsum(common < DEPTH)
    blocks = interval[np.argsort(which, kind="stable")]  # by shard, then by place in it
    done = 0
    for t, i in zip(transforms, cut[:-1].tolist(), strict=True):
        own = t.order - t.ends
        real = own >= 0
        out[at[i + own[real]]] = blocks[done : done + len(own)][real]
        done += len(own)
    out[left < LENGTH] = -1
    have = np.flatnonzero(out >= 0)
    _, back, times = np.unique(out[have], return_inverse=True, return_counts=True)
    out[have[times[back] < 2]] = -1
    return out


def _as_first(first: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """For rows sorted by group: whether each equals its group's first in all columns, as a row and its own copy do."""
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    out = np.ones(len(first), bool)
    for c in columns:
        out &= c == c[lead]
    return out


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose rows are the parts of `values` that end at `ends`."""
    values = np.ascontiguousarray(values)
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _concat(rows: list, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> list[np.ndarray]:
    """The rows of a bucket: each entry's document, the documents' ids and rows, then the other columns."""
    held: list[list[bytes]] = [[] for _ in range(3 + len(kinds))]
    for batch in batches:
        for k, column in enumerate(held):
            column += batch.column(k + 1).to_pylist()
    sizes = np.array([len(x) // 8 for x in held[0]], np.int64)
    many = np.array([len(x) // 4 for x in held[2]], np.int64)
    doc = _concat(held[2], np.int32) + np.repeat(np.cumsum(sizes) - sizes, many)
    out = [doc, _concat(held[0], np.int64), _concat(held[1], np.int64)]
    for k, kind in enumerate(kinds):
        out.append(_concat(held[3 + k], kind))
        held[3 + k] = []
    return out


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row a document, with its runs united: pairs of start and end."""
    _, number = np.unique(np.column_stack([ids, rows]), axis=0, return_inverse=True)
    named = number.reshape(-1)[doc].astype(np.int64)
    order = np.lexsort((start, named))
    doc, start, end, named = doc[order], start[order], end[order], named[order]
    far = np.maximum.accumulate(end + named * (1 << 40)) - named * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (named[1:] != named[:-1]) | (start[1:] > far[:-1])
    run = np.flatnonzero(new)
    pairs = np.column_stack([start[run], far[np.append(run[1:], len(doc)) - 1]]).astype(np.int64).reshape(-1)
    _, first = np.unique(named[run], return_index=True)
    at = doc[run[first]]
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(rows[at]), _binary(pairs, 2 * np.append(first[1:], len(run)))], names=["id", "row", "runs"])


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def heavy_anchors(source: DataFrame, local: int = 16) -> np.ndarray:
    """Sorted hashes of the anchors with more than HOT different segments, and more than a 100,000th of all segments.

    A task names those with `local` or more different segments among its rows; what is rarer in every task is too
    little for a hot group.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = total = 0

        def named() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.uint64)
            hashes, n = np.unique(pairs[:, 0], return_counts=True)
            often = n >= local
            return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for _, part, own, _ in parts_of(data, offsets):
                prefix = prefix_hash(part)
                hashes, row, start, windows = segments(part, own, prefix)
                begin = own[row] + start
                # Only anchors that come twice in this step can be frequent in the task.
                _, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
                pick = np.flatnonzero(n[back] > 1)
                whole = span_hash(prefix, begin[pick], begin[pick] + windows[pick] + LENGTH - 1)
                held.append(np.column_stack([hashes[pick], whole]))
                size, total = size + len(pick), total + len(hashes)
                if size > 2_000_000:
                    yield named()
                    held.clear()
                    size = 0
        yield named()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["hash", "n"])

    counted = source.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).checkpoint()
    total = counted.where("hash IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.where(F.col("hash").isNotNull() & (F.col("n") > max(HOT, total // 100_000))).select("hash").toArrow()
    return np.sort(often.column("hash").to_numpy().astype(np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_bytes (what is left), n_bytes, n_removed, spans array<struct<start,end>> of the removed runs."""
    spark = docs.sparkSession
    session_ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    hot = spark.sparkContext.broadcast(heavy_anchors(source))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def given() -> pa.RecordBatch:
            hashes, whole, id_, row, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = hashes % np.uint64(parts)
            # Of equal segments of these only the earliest goes on; the others are repeats, with a count below 0.
            at = np.lexsort((start, row, id_, whole, hashes))
            lead = np.append(True, (hashes[at[1:]] != hashes[at[:-1]]) | (whole[at[1:]] != whole[at[:-1]]))
            mine = _as_first(lead, id_[at], row[at], start[at])
            gone = at[~lead & ~mine]
            count[gone] *= -1
            hashes[gone] = whole[gone] = 0
            keep = np.sort(at[lead | ~mine])
            columns = {"hash": hashes, "whole": whole, "start": start.astype(np.int32), "count": count.astype(np.int8)}
            return dealt(bucket[keep], id_[keep], row[keep], {name: x[keep] for name, x in columns.items()})

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, part, own, base in parts_of(data, offsets):
                prefix = prefix_hash(part)
                hashes, row, start, count = segments(part, own, prefix)
                alone = _among(hashes, hot.value)
                if alone.any():
                    spread = np.repeat(np.flatnonzero(alone), count[alone])
                    more = np.arange(len(spread)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
                    begin = own[row[spread]] + start[spread] + more
                    single = mix(span_hash(prefix, begin, begin + LENGTH) ^ SALT)
                    split = ((hashes, single), (row, row[spread]), (start, start[spread] + more), (count, np.ones(len(spread), np.int32)))
                    hashes, row, start, count = (np.concatenate([x[~alone], y]) for x, y in split)
                begin = own[row] + start
                whole = span_hash(prefix, begin, begin + count + LENGTH - 1)
                held.append((hashes, whole, ids[i + row], rows[i + row], start + base, count))
                if sum(len(x[0]) for x in held) > HELD:
                    yield given()
        if any(len(x[0]) for x in held):
            yield given()
        release()

    def collapse(gone: bool):
        """Repeats as runs of documents, or the segments that are left to compare."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            doc, ids, rows, hashes, whole, start, count = _gathered(batches, (np.uint64, np.uint64, np.int32, np.int8))
            if not len(doc):
                return
            start, count = start.astype(np.int64), count.astype(np.int64)
            known = count < 0
            far = (doc[known], start[known], -count[known])
            doc, hashes, whole, start, count = (x[~known] for x in (doc, hashes, whole, start, count))
            # Only anchors that occur twice or more; then their segments by content, the earliest first.
            _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
            pick = np.flatnonzero(times[back] > 1)
            doc, hashes, whole, start, count = (x[pick] for x in (doc, hashes, whole, start, count))
            at = np.lexsort((start, rows[doc], ids[doc], whole, hashes))
            doc, hashes, whole, start, count = (x[at] for x in (doc, hashes, whole, start, count))
            lead = np.ones(len(doc), bool)
            lead[1:] = (hashes[1:] != hashes[:-1]) | (whole[1:] != whole[:-1])
            if gone:
                again = ~lead & ~_as_first(lead, ids[doc], rows[doc], start)
                d, s, c = (np.concatenate([x, y[again]]) for x, y in zip(far, (doc, start, count), strict=True))
                if len(d):
                    yield _runs(d, s, s + c + LENGTH - 1, ids, rows)
                return
            first = np.flatnonzero(lead)
            if not len(first):
                return
            _, back, kinds = np.unique(hashes[first], return_inverse=True, return_counts=True)
            first = first[kinds[back] > 1]
            if not len(first):
                return
            first = first[np.argsort(doc[first], kind="stable")]
            used, at = np.unique(doc[first], return_index=True)
            ends = np.append(at[1:], len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[used]),
                    pa.array(rows[used]),
                    _binary(hashes[first], ends),
                    _binary(start[first].astype(np.int32), ends),
                    _binary(count[first].astype(np.int8), ends),
                ],
                names=["id", "row", "hash", "start", "count"],
            )

        return run

    blobs = source.mapInArrow(
        anchors, "bucket int, ids binary, rows binary, local binary, hash binary, whole binary, start binary, count binary",
    ).repartitionById(parts, "bucket")
    copies = blobs.mapInArrow(collapse(True), "id long, row long, runs binary")
    hits = blobs.mapInArrow(collapse(False), "id long, row long, hash binary, start binary, count binary")
    hits = hits.groupBy("id", "row").agg(F.collect_list(F.struct("hash", "start", "count")).alias("hits"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def given() -> pa.RecordBatch:
            hashes, id_, row, start, count, text, length = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return dealt(
                hashes % np.uint64(parts),
                id_,
                row,
                {"hash": hashes, "start": start.astype(np.int32), "count": count.astype(np.int8)},
                (text, np.cumsum(length) - length, length),
            )

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, rows, hits_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j in steps(offsets, STEP):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                got = hits_.slice(i, j - i).to_pylist()
                many = np.array([sum(len(y["start"]) // 4 for y in x) for x in got])
                take = lambda name, dtype: _concat([y[name] for x in got for y in x], dtype)  # noqa: B023, E731
                hashes, start, count = take("hash", np.uint64), take("start", np.int32).astype(np.int64), take("count", np.int8).astype(np.int64)
                row = np.repeat(np.arange(j - i), many)
                begin, length = own[row] + start, count + LENGTH - 1
                # Some segments at a time, as those of a text overlap.
                cuts = np.searchsorted(np.cumsum(length), np.arange(0, length.sum(), HELD_BYTES))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(length)), strict=True):
                    b, n = begin[lo:hi], length[lo:hi]
                    text = part[np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    held.append((hashes[lo:hi], ids[i + row[lo:hi]], rows[i + row[lo:hi]], start[lo:hi], count[lo:hi], text, n))
                    size += len(text)
                    if size >= HELD_BYTES:
                        yield given()
                        size = 0
        if size:
            yield given()
        release()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, ids, rows, hashes, start, count, data = _gathered(batches, (np.uint64, np.int32, np.int8, np.uint8))
        if not len(doc):
            return
        start, size = start.astype(np.int64), count.astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        found: list[tuple[np.ndarray, np.ndarray]] = []  # document and first byte of windows that are repeats
        lead = np.argsort(hashes, kind="stable")
        # Whole groups at a time, as many as SHARDS shards hold.
        total = np.cumsum(size[lead])
        lo = 0
        while lo < len(lead):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SHARD * SHARDS))
            while lo < hi < len(lead) and hashes[lead[hi]] == hashes[lead[hi - 1]]:
                hi -= 1
            if hi <= lo:  # one group fills it
                hi = lo + 1
                while hi < len(lead) and hashes[lead[hi]] == hashes[lead[lo]]:
                    hi += 1
            own = lead[lo:hi]
            lo = hi
            lengths = size[own]
            where = np.repeat(begin[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            block = repeated_windows(data[where], lengths)
            window = np.flatnonzero(block >= 0)
            segment = own[np.repeat(np.arange(len(own)), lengths)[window]]
            position = start[segment] + where[window] - begin[segment]
            at = np.lexsort((position, rows[doc[segment]], ids[doc[segment]], block[window]))
            first = np.ones(len(at), bool)
            first[1:] = block[window[at[1:]]] != block[window[at[:-1]]]
            again = at[~first & ~_as_first(first, ids[doc[segment]][at], rows[doc[segment]][at], position[at])]
            found.append((doc[segment[again]], position[again]))
        d, s = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(d):
            yield _runs(d, s, s + LENGTH, ids, rows)

    met = source.join(hits, ["id", "row"]).select("id", "row", "text", "hits")
    sent = met.mapInArrow(send, "bucket int, ids binary, rows binary, local binary, hash binary, start binary, count binary, bytes binary")
    judged = sent.repartitionById(parts, "bucket").mapInArrow(judge, "id long, row long, runs binary")
    runs = judged.unionByName(copies).groupBy("id", "row").agg(F.collect_list("runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            left, removed, spans = [], [], []
            for k, blob in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[k] : offsets[k + 1]]
                if not blob:
                    left.append(own.tobytes())
                    removed.append(0)
                    spans.append([])
                    continue
                pairs = _concat(blob, np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                far = np.maximum.accumulate(pairs[:, 1])
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:, 0] > far[:-1]
                run = np.flatnonzero(new)
                begins, ends = pairs[run, 0].tolist(), far[np.append(run[1:], len(pairs)) - 1].tolist()
                left.append(b"".join(own[a:b].tobytes() for a, b in zip([0, *ends], [*begins, len(own)], strict=True)))
                removed.append(sum(ends) - sum(begins))
                spans.append([{"start": a, "end": b} for a, b in zip(begins, ends, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(left, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, span)],
                names=["id", "text_bytes", "n_bytes", "n_removed", "spans"],
            )

    out = (
        source.join(runs, ["id", "row"], "left")
        .select("id", "text", "runs")
        .mapInArrow(cut, "id long, text_bytes binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")
    )
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "text_bytes", "n_bytes", "n_removed", "spans")


#: The same for DuckDB, over the table `documents`: every window by its hash, the later ones united to runs.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, md5_number(CAST(array_slice(b, i + 1, i + 100) AS VARCHAR)) AS g FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z
         FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
               FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY doc_id, run),
s AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS begins, list(z ORDER BY a) AS ends FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         CASE WHEN s.doc_id IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda k: hex(array_slice(b, CASE WHEN k = 0 THEN 1 ELSE ends[k] + 1 END, CASE WHEN k = n_spans THEN octet_length(b) ELSE begins[k + 1] END))), '') END AS kept
         FROM d LEFT JOIN s USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM kept
"""


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text_bytes", 256).alias("kept_sha256"),
    )
