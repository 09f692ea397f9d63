"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file (a serialized model; its path is a parameter) gives pieces, types and scores. A vocabulary of
merge ranks has no log-probabilities; its pieces get log scores by Zipf's law over their ranks. A text gets the
dummy prefix and the marker U+2581 for each space; the best segmentation maximises the sum of scores; a character
that is no piece takes the unknown penalty and becomes the pieces of its UTF-8 bytes. Decoding joins pieces, bytes
and spaces again; what is no UTF-8 there becomes U+FFFD.

No piece has the marker after another character, and some characters (the line feed) are in no piece, so texts are
cut there without changing the result; each distinct part is segmented once a task, all parts of equal length in
one array step per place and piece length. Parts kept for the next texts are bounded in number and in length; a longer part
(text without spaces) is segmented place by place over arrays and not kept.

Null text is empty and has no pieces. U+2581 in a text decodes to a space, as in the original method; every other
text decodes to itself. Repeated ids are separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, session_ready, steps, text_buffer, text_groups

MARK = "▁"
#: Fixed values of the model format: types of pieces, and what an unknown character costs beyond the worst piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0
#: Characters of a part that is segmented in array steps; longer parts go place by place.
LONG = 48
#: Parts kept between calls, each of LONG characters at most; characters of texts that are cut into parts at once; places
#: of a long part that are matched at once.
KEPT = 200_000
SLICE = 1 << 20
STRETCH = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    is_unigram: bool
    dummy_prefix: bool = True
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces)}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        pieces, scores, types, unigram, dummy = [], [], [], True, True
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                got = dict(_fields(value))
                pieces.append(got[1].decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                types.append(got.get(3, NORMAL))
            elif number == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                dummy = bool(dict(_fields(value)).get(3, 1))
        v = cls(pieces, np.array(scores), np.array(types), unigram, dummy)
        return v if unigram else v.with_zipf_scores()

    def with_zipf_scores(self, shift: float = 2.7) -> Vocabulary:
        """Log scores -ln(rank + shift) - ln(sum) for normal pieces, ranked by their scores, the greatest first."""
        normal = np.flatnonzero(self.types == NORMAL)
        rank = np.empty(len(normal))
        rank[np.argsort(-self.scores[normal], kind="stable")] = np.arange(1, len(normal) + 1)
        weight = 1 / (rank + shift)
        scores = np.zeros(len(self.pieces))
        scores[normal] = np.log(weight / weight.sum())
        return Vocabulary(self.pieces, scores.astype(np.float32).astype(float), self.types, True, self.dummy_prefix)


class Segmenter:
    """Double-array trie: a node's child by character class c is node base[node] + c if check[...] is the node."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        use = [i for i in range(len(vocabulary.pieces)) if vocabulary.types[i] in (NORMAL, USER, UNUSED)]
        by_use: dict[str, int] = {}
        for i in use:  # frequent characters get the small classes, which packs the arrays
            for c in vocabulary.pieces[i]:
                by_use[c] = by_use.get(c, 0) + 1
        self.classes = {c: k + 1 for k, c in enumerate(sorted(by_use, key=lambda c: (-by_use[c], c)))}
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in self.classes]] = list(self.classes.values())
        self.longest = max((len(vocabulary.pieces[i]) for i in use), default=1)
        self.unknown = float(min((vocabulary.scores[i] for i in use), default=0.0)) - PENALTY
        self._build({vocabulary.pieces[i]: i for i in use})
        self.bytes_ = np.array([vocabulary.ids.get(f"<0x{b:02X}>", -1) for b in range(256)], np.int32)
        unknowns = np.flatnonzero(vocabulary.types == UNKNOWN)
        self.unknown_id = int(unknowns[0]) if len(unknowns) else 0
        self.inner = any(MARK in p.lstrip(MARK) for p in (vocabulary.pieces[i] for i in use))
        known = "".join(map(re.escape, sorted(self.classes)))
        # Parts: a character in no piece alone; else marks and what follows up to the next mark.
        self.parts = re.compile(f"[^{known}]|[{known}]+" if self.inner else f"[^{known}]|{MARK}*[{known.replace(MARK, '')}]+|{MARK}+")
        self.kept: dict[str, tuple[bytes, float]] = {}
        self.plain = [bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"" if t == CONTROL else p.encode() for p, t in zip(vocabulary.pieces, vocabulary.types.tolist(), strict=True)]

    def _build(self, pieces: dict[str, int]) -> None:
        children: list[dict[int, int]] = [{}]
        value = {}
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                k = self.classes[c]
                if k not in children[node]:
                    children.append({})
                    children[node][k] = len(children) - 1
                node = children[node][k]
            value[node] = i
        # Offsets first, for the nodes with most children first; then places, from the root down.
        free = np.ones(2 * len(children) + 2 * len(self.classes) + 8192, bool)
        free[0] = False
        offset = np.zeros(len(children), np.int64)
        cursor, last = 1, 0
        for node in sorted(range(len(children)), key=lambda x: -len(children[x])):
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                break
            if len(kids) != last and len(kids) <= 2:
                cursor = 1  # the holes that larger nodes left
            last = len(kids)
            while True:
                if cursor + 4096 + kids[-1] >= len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = np.logical_and.reduce([free[cursor + k : cursor + k + 4096] for k in kids[:64].tolist()])
                spots = [int(x) for x in np.flatnonzero(fits)[:64] if len(kids) <= 64 or free[cursor + x + kids].all()]
                if spots:
                    break
                cursor += 4096 if not fits.any() else 64
            offset[node] = at = cursor + spots[0]
            free[at + kids] = False
            cursor += max(0, spots[0] - 32 * (len(kids) > 1))
        size = int(offset.max()) + len(self.classes) + 2 if len(children) > 1 else len(self.classes) + 2
        size = max(size, int(np.flatnonzero(~free).max()) + len(self.classes) + 2)
        self.base, self.check, self.piece_of = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        place = [0] * len(children)
        for node, kids in enumerate(children):  # parents are numbered before their children
            self.base[place[node]] = offset[node]
            for k, child in kids.items():
                place[child] = to = int(offset[node]) + k
                self.check[to] = place[node]
                self.piece_of[to] = value.get(child, -1)

    def _equal_lengths(self, parts: list[str], n: int) -> list[tuple[bytes, float]]:
        """Viterbi over the rows of a (parts, n) array of character classes."""
        codes = self.class_of[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)].reshape(len(parts), n)
        scores = np.append(self.vocabulary.scores, 0.0)
        rows = len(parts)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, rows), np.int32)
        took = np.full((n + 1, rows), -1, np.int32)
        for i in range(n):
            node = np.zeros(rows, np.int32)
            alive = np.arange(rows)
            single = np.zeros(rows, bool)
            for j in range(i, min(n, i + self.longest)):
                c = codes[alive, j]
                to = self.base[node] + c
                ok = (self.check[to] == node) & (c > 0)
                alive, node = alive[ok], to[ok]
                if not len(alive):
                    break
                piece = self.piece_of[node]
                has = piece >= 0
                rows_, p = alive[has], piece[has]
                if j == i:
                    single[rows_] = True
                total = best[i, rows_] + scores[p]
                better = total > best[j + 1, rows_]
                rows_, p = rows_[better], p[better]
                best[j + 1, rows_], back[j + 1, rows_], took[j + 1, rows_] = total[better], i, p
            lone = np.flatnonzero(~single)
            total = best[i, lone] + self.unknown
            lone = lone[better := total > best[i + 1, lone]]
            best[i + 1, lone], back[i + 1, lone], took[i + 1, lone] = total[better], i, -1
        # Back from the ends, all rows at once; rows with unknown characters, few, get their bytes one by one.
        path = np.full((n, rows), -2, np.int32)
        at, row = np.full(rows, n), np.arange(rows)
        for step in range(n - 1, -1, -1):
            open_ = at > 0
            if not open_.any():
                break
            path[step, open_] = took[at[open_], row[open_]]
            at[open_] = back[at[open_], row[open_]]
        path = path.T
        unknown = (path == -1).any(axis=1)
        known = path >= 0
        ends = np.cumsum(known.sum(axis=1)) * 4
        blob = path[known].astype(np.int32).tobytes()
        out = [blob[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for r in np.flatnonzero(unknown).tolist():
            ids, place = [], 0
            for t in path[r][path[r] > -2].tolist():
                ids += [t] if t >= 0 else self._fallback(parts[r][place])
                place += len(self.vocabulary.pieces[t]) if t >= 0 else 1
            out[r] = np.array(ids, np.int32).tobytes()
        return list(zip(out, best[n].tolist(), strict=True))

    def _fallback(self, c: str) -> list[int]:
        ids = self.bytes_[list(c.encode())].tolist()
        return ids if min(ids) >= 0 else [self.unknown_id]

    def _matches(self, codes: np.ndarray, n: int) -> tuple[list[int], list[int], list[int], list[float]]:
        """Begin, end, piece and score of all pieces that begin at the first n places of `codes`, by begin, then end; a place
        where no piece of one character begins has a piece -1 there."""
        found = []
        where, node = np.arange(n), np.zeros(n, np.int32)
        single = np.zeros(n, bool)
        for k in range(self.longest):
            inside = where + k < len(codes)
            where, node = where[inside], node[inside]
            c = codes[where + k]
            to = self.base[node] + c
            ok = (self.check[to] == node) & (c > 0)
            where, node = where[ok], to[ok]
            if not len(where):
                break
            piece = self.piece_of[node]
            has = piece >= 0
            found.append((where[has], np.full(has.sum(), k + 1), piece[has]))
            if not k:
                single[where[has]] = True
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1, np.int32)))
        begin, size, piece = (np.concatenate([x[k] for x in found]) for k in range(3))
        by = np.lexsort((size, begin))
        begin, size, piece = begin[by], size[by], piece[by]
        score = np.where(piece >= 0, self.vocabulary.scores[piece], self.unknown)
        return begin.tolist(), (begin + size).tolist(), piece.tolist(), score.tolist()

    def _long(self, text: str) -> tuple[bytes, float]:
        """Viterbi over one long part, a stretch of places at a time: what is held grows by 12 bytes a character."""
        codes = self.class_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        n = len(codes)
        took = np.full(n + 1, -1, np.int32)
        best = [0.0]
        for lo in range(0, n, STRETCH):
            hi = min(n, lo + STRETCH)
            part = codes[lo : hi + self.longest - 1]
            best += [-math.inf] * (len(part) + 1 - len(best))
            here = took[lo : lo + len(part) + 1].tolist()
            for i, j, piece, score in zip(*self._matches(part, hi - lo), strict=True):
                if (total := best[i] + score) > best[j]:
                    best[j], here[j] = total, piece
            took[lo : lo + len(part) + 1] = here
            best = best[hi - lo :]
        ids = array("i")
        j = n
        while j:
            if (piece := int(took[j])) >= 0:
                ids.append(piece)
                j -= len(self.vocabulary.pieces[piece])
            else:
                j -= 1
                ids.extend(self._fallback(text[j])[::-1])
        return np.frombuffer(ids, np.int32)[::-1].tobytes() if ids else b"", best[0]

    def learn(self, parts: set[str]) -> dict[str, tuple[bytes, float]]:
        """Segment the parts that are not kept yet; long ones are given back and not kept."""
        by_length: dict[int, list[str]] = {}
        long: dict[str, tuple[bytes, float]] = {}
        for p in parts - self.kept.keys():
            if len(p) > LONG:
                long[p] = self._long(p)
            else:
                by_length.setdefault(len(p), []).append(p)
        for n, own in sorted(by_length.items()):
            for lo in range(0, len(own), 20_000):
                some = own[lo : lo + 20_000]
                self.kept.update(zip(some, self._equal_lengths(some, n), strict=True))
        return long

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, float]]:
        """The ids of each text as little-endian 32-bit integers, and the sum of its scores."""
        out: list[tuple[bytes, float]] = []
        for i, j in text_groups(texts, SLICE):
            marked = [(MARK if self.vocabulary.dummy_prefix else "") + t.replace(" ", MARK) if t else "" for t in texts[i:j]]
            if j > i + 1:
                out += self._encode(marked)
            else:
                coded = [self._encode([piece])[0] for piece in self._slices(marked[0])]
                out.append((b"".join(ids for ids, _ in coded), math.fsum(score for _, score in coded)))
        return out

    def _slices(self, text: str) -> Iterator[str]:
        """Cuts before a mark that follows another character, as the parts are cut."""
        i = 0
        while i < len(text):
            j = text.find(MARK, i + SLICE) if not self.inner else -1
            while 0 < j and text[j - 1] == MARK:
                j = text.find(MARK, j + 1)
            j = len(text) if j < 0 else j
            yield text[i:j]
            i = j

    def _encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        cut = [self.parts.findall(t) for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        long = self.learn(set().union(*cut))
        out = []
        for parts in cut:
            got = [(long if len(p) > LONG else self.kept)[p] for p in parts]
            out.append((b"".join([ids for ids, _ in got]), math.fsum([score for _, score in got])))
        return out

    def decode(self, ids: bytes) -> str:
        numbers, plain = np.frombuffer(ids, np.int32), self.plain.__getitem__
        out = b"".join([b"".join(map(plain, numbers[i : i + SLICE].tolist())) for i in range(0, len(numbers), SLICE)])
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


def _segmented(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    session_ready(docs.sparkSession)
    # Bounded by the vocabulary file, which does not grow with the data.
    shared = docs.sparkSession.sparkContext.broadcast(Segmenter(vocabulary))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = shared.value
        for batch in batches:
            column = batch.column(1)
            _, offsets = text_buffer(column)
            for i, j in steps(offsets, 2 * SLICE):
                texts = column.slice(i, j - i).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *make(segmenter, texts, segmenter.encode(texts))], names=[id_col, *names])
        segmenter.kept.clear()
        release()

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {schema}")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ids array<int> and score of each document."""

    def make(_, __, coded):
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x, _ in coded])]).astype(np.int32)
        values = np.frombuffer(b"".join(x for x, _ in coded), np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([s for _, s in coded], pa.float64())]

    return _segmented(docs, vocabulary or Vocabulary.load(default_vocabulary()), id_col, text_col, make, "ids array<int>, score double")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and text of each row of ids; null ids give null."""
    session_ready(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Segmenter(vocabulary or Vocabulary.load(default_vocabulary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(np.array(x, np.int32).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def piece_report(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, score, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip:
    whether decoding gives the text back."""
    import hashlib

    def make(segmenter, texts, coded):
        is_byte = segmenter.vocabulary.types == BYTE
        ids = [x for x, _ in coded]
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([int(is_byte[np.frombuffer(x, np.int32)].sum()) for x in ids], pa.int64()),
            pa.array([s for _, s in coded], pa.float64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([segmenter.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
        ]

    return _segmented(
        docs,
        vocabulary or Vocabulary.load(default_vocabulary()),
        "doc_id",
        "text",
        make,
        "n_pieces long, n_byte_pieces long, score double, ids_sha256 string, round_trip boolean",
    )
