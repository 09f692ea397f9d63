"""Mixing, search, encoding, language scores and length counts: exact parts against brute force, models by properties."""

import collections
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chunkspark.llm import common, graph_search, lengths, mixing, pieces, ppm
from chunkspark.llm.common import connected, text_buffer, words
from chunkspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, "", "h"),
    (2, None, "h"),
    (3, " \n\t ", None),
    (4, "one two", "g"),
    (5, "word " * 20_000, "g"),
    (6, "x" * 50_000, "h"),
    (7, "é\U0001f600 ü" * 50, None),
    (None, "a b c", "h"),
    (9, "a b", "h"),
    (9, "a b", "h"),
]
SCHEMA = "doc_id long, text string, source string, size string, row string, ids string"


def frame(spark, rows=EDGES):
    return spark.createDataFrame([(*r, "e", "e", "e") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


OPERATORS = {"op1": mixing.mix_sources, "op3": pieces.piece_report, "op4": ppm.language_scores}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_empty_table(spark, name):
    got = OPERATORS[name](frame(spark))
    assert got.count() == len(EDGES)
    assert OPERATORS[name](frame(spark, [])).count() == 0


# ---- Helpers ----


def test_words_and_buffers():
    texts = ["a\x1cb  c", None, "", "\té x\x0b", "z"]
    data, offsets = text_buffer(pa.array(["skip", *texts], pa.string())[1:])
    starts, ends, first = words(data, offsets)
    got = [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]


def test_word_hashes_by_stretches(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab \n", k=rng.randint(0, 50))) for _ in range(60)] + ["x" * 300, "", " "]
    data, offsets = text_buffer(pa.array(texts))
    whole, _, first = common.word_hashes(data, offsets)
    monkeypatch.setattr(common.stretches, "__defaults__", (7,))
    parts, _, again = common.word_hashes(data, offsets)
    assert whole.tolist() == parts.tolist() and first.tolist() == again.tolist()
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]


@pytest.mark.parametrize("order", [1, 3, 5])
def test_scores_by_chunks(monkeypatch, order):
    texts = ["the cat sat on the mat", "", "a hat", "the the the cat"]
    data, offsets = text_buffer(pa.array(texts))
    sym, begin = ppm.symbols(data, offsets, order)
    codes, n = ppm.gram_counts(sym, len(texts), order)
    want = trie_of(texts, order).score(sym, begin)
    monkeypatch.setattr(ppm, "CHUNK", 8)
    monkeypatch.setattr(ppm, "SCORED", 8)
    again, m = ppm.gram_counts(sym, len(texts), order)
    assert codes.tolist() == again.tolist() and n.tolist() == m.tolist()
    assert np.allclose(trie_of(texts, order).score(sym, begin), want)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_components(spark, most):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    want = {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), most=most).collect()}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Mixing ----


def brute_targets(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        left = total - sum(target[s] for s in names if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        for s in over or free:
            target[s] = cap * sizes[s] if over else share[s]
        free = free - over if over else set()
    return target


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = {rng.choice(["a", "b", "é", "z", "Z", "aa", "10"]) + str(k): rng.choice([0, 1, 5, 100, 3000]) for k in range(rng.randint(1, 9))} | {None: 7}
        rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_docs long, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, documents):
    got = QUERIES["op1_mix_sources"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op1_mix_sources"](spark, SF).collect()))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        text, source = documents[r.doc_id]
        assert r.size == len(text.encode().split()) and r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
    want = brute_targets(dict(sizes))
    longest = {s: max(r.size for r in got if documents[r.doc_id][1] == s) for s in sizes}
    for r in got:
        s = documents[r.doc_id][1]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 2 * longest[s] for s in sizes)


def test_balance_on_a_large_source(spark, monkeypatch):
    """Many blocks and levels: totals of documents and words stay at their targets up to the landing."""
    monkeypatch.setattr(mixing, "BLOCK", 32)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 60), "a" if i % 4 else "b") for i in range(2000)]
    got = mixing.mix_sources(frame(spark, rows)).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 60
        assert abs(own["copies"].sum() - len(own) * own["target"].iloc[0] / own["source_size"].iloc[0]) <= 3


def test_flight_keeps_probabilities():
    """Inclusion frequencies over many seeds are the given probabilities; balancing sums stay until the landing."""
    size = [1.0, 5, 3, 8, 2, 2, 9, 4, 4, 4]
    prob = [0.2, 0.5, 0.9, 0.4, 0.3, 0.7, 0.6, 0.5, 0.1, 0.8]
    total = np.zeros(len(prob))
    for seed in range(3000):
        chance = np.random.Generator(np.random.PCG64(seed))
        out = mixing.flight(prob, size, chance)
        assert sum(0 < p < 1 for p in out) <= 2
        assert abs(sum(out) - sum(prob)) < 1e-6 and abs(np.dot(out, size) - np.dot(prob, size)) < 1e-6
        total += mixing.flight(out, size, chance, land=True)
    assert np.abs(total / 3000 - prob).max() < 0.04


def test_mixed_documents(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i % 9 else "b") for i in range(60)] + [(3, "other words here", "a")] + [(7, "w w w", "a")] * 4 + [(None, f"n {i % 3}", "b") for i in range(12)]
    docs = frame(spark, rows)
    copies = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        copies[r.doc_id, r.size] += r.copies
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, len(r.text.split())) for r in got.collect()) == +copies


# ---- Search ----


def brute_nearest(ids, x, k=10):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(ids[j], d[j]) for j in order]
    return out


def test_recall(spark):
    t = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").toPandas()
    want = brute_nearest(t["vec_id"].to_numpy(), np.array(t["embedding"].tolist(), float))
    got = collections.defaultdict(list)
    for r in QUERIES["op2_nearest_neighbours"](spark, SF.replace("0.001", "0.1")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 10 * len(want)


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "LEAST", 16)
    monkeypatch.setattr(graph_search, "QUERIES", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x[20:50] = x[0]  # ties: the smaller ids win
    rows = [(100 * i if i < 5 else 1000 + i, v.tolist()) for i, v in enumerate(x)]
    bad = [
        (700, None),
        (800, [0.0] * 4),
        (900, [float("nan"), 1.0, 1.0, 1.0]),
        (1100, [None, 1.0, 1.0, 1.0]),
        (None, [1.0] * 4),
        (1200, [float("inf"), 0.0, 0.0, 1.0]),
        (1300, [1.0]),
    ]
    table = spark.createDataFrame([(*r, "e", 1) for r in rows + bad], "vec_id long, embedding array<float>, id string, shard int")
    got = collections.defaultdict(list)
    for r in graph_search.nearest_of_hundredths(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(np.array([i for i, _ in rows]), x.astype(float))
    assert dict(got) == want
    few = table.where("vec_id IN (0, 100, 1010)")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in graph_search.nearest_of_hundredths(few).collect())[0][:2] == (0, 1) and graph_search.nearest_of_hundredths(few).count() == 4
    assert graph_search.nearest_of_hundredths(table.limit(0)).count() == 0


def test_graph_packs():
    v = np.random.default_rng(6).normal(size=(700, 8))
    g = graph_search.Graph(v)
    again = graph_search.Graph.unpack(g.pack())
    found = g.search(v[:300], 20)
    assert len(g.counts) > 1 and (found == again.search(v[:300], 20)).all() and found[:, 0].tolist() == list(range(300))
    assert [x.shape[1] for x in g.links] == [32] + [16] * (len(g.counts) - 1)


@pytest.mark.parametrize("inserted", [8, 256])
def test_graph_by_insertion(monkeypatch, inserted):
    """Links found by search lead to the nearest nodes; each node has links, none to itself, none twice."""
    monkeypatch.setattr(graph_search, "INSERTED", inserted)
    v = np.random.default_rng(7).normal(size=(1500, 16))
    g = graph_search.Graph(v)
    for level, links in enumerate(g.links):
        for node, row in enumerate(links.tolist()):
            own = [x for x in row if x >= 0]
            assert node not in own and len(set(own)) == len(own) and all(x < g.counts[level] for x in own) and (own or len(links) == 1)
    q = np.random.default_rng(8).normal(size=(100, 16))
    want = np.argsort(((q[:, None] - v[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(want.tolist(), g.search(q, 96).tolist(), strict=True)]) > 0.97
    small = graph_search.Graph(v[:3])
    assert sorted(small.search(q[:1], 5)[0].tolist()) == [-1, -1, 0, 1, 2] and graph_search.Graph(v[:0]).search(q, 4).tolist() == [[-1] * 4] * 100


def test_shards_grow_to_a_fixed_size():
    assert [graph_search.shard_number(n) for n in (0, 1, 4097, 4096 * 64, 1 << 22, 10 << 22)] == [1, 1, 2, 64, 64, 640]


# ---- Pieces ----


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def unigram_model(vocabulary):
    """The vocabulary with the scores used here, as a unigram model for the public library."""
    field = lambda number, body: varint(number << 3 | 2) + varint(len(body)) + body
    out = b""
    for p, s, t in zip(vocabulary.pieces, vocabulary.scores.tolist(), vocabulary.types.tolist(), strict=True):
        out += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(t))
    flags = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    return out + field(2, flags) + field(3, field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))


TEXTS = [
    " a  b",
    "a\nb",
    "\n",
    "  ",
    "é中\U0001f600 x",
    "a" * 300,
    "ab " * 60,
    "x ",
    "tab\there",
    "Hello, world! 12345",
    "<0x0A> </s> <unk>",
    "\u0000\u0007",
    "naïve café—“quoted”",
]


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(pieces.Vocabulary.load(pieces.default_vocabulary()))


def test_pieces_equal_library(segmenter, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(segmenter.vocabulary))
    texts = TEXTS + [t for t, _ in list(documents.values())[:60]]
    differ = 0
    for text, (ids, score) in zip(texts, segmenter.encode(texts), strict=True):
        own, theirs = np.frombuffer(ids, np.int32).tolist(), library.encode(text)
        if own != theirs:  # segmentations of equal score: the library's sums are rounded to 32 bits
            differ += 1
            total = lambda x: sum(segmenter.vocabulary.scores[i] for i in x)
            assert abs(total(own) - total(theirs)) < 1e-3 * max(1, abs(score)) / 10
        assert library.decode(theirs) == segmenter.decode(ids)
    assert differ < 10


def test_round_trip(segmenter):
    for text, (ids, _) in zip(TEXTS, segmenter.encode(TEXTS), strict=True):
        assert segmenter.decode(ids) == text
    assert segmenter.decode(segmenter.encode(["a▁b"])[0][0]) == "a b"
    assert segmenter.encode([None, ""]) == [(b"", 0.0)] * 2
    assert segmenter.decode(np.array([segmenter.bytes_[0xC3]], np.int32).tobytes()) == "�"


def test_long_parts_equal_short_ones(segmenter, monkeypatch):
    parts = ["▁" + "".join(random.Random(k).choices("abcdeé中#ing", k=30)) for k in range(40)]
    short = segmenter._equal_lengths(parts, 31)
    for p, (ids, score) in zip(parts, short, strict=True):
        slow, total = segmenter._long(p)
        assert slow == ids and abs(total - score) < 1e-6


def test_long_texts_in_slices(segmenter, monkeypatch):
    import public_tokenizers

    texts = [t for t in TEXTS if len(t) > 5] + ["a  b   c d e\n\n f", "▁▁x▁ y"]
    counter = lengths.Counter(lengths.load_ranks(lengths.default_vocabulary()), public_tokenizers.PATTERN)
    whole, counts = segmenter.encode(texts), counter.count(texts)
    monkeypatch.setattr(pieces, "SLICE", 3)
    monkeypatch.setattr(lengths, "SLICE", 3)
    assert [ids for ids, _ in segmenter.encode(texts)] == [ids for ids, _ in whole]
    assert counter.count(texts) == counts


def test_trie_holds_all_pieces(segmenter):
    for i in range(0, len(segmenter.vocabulary.pieces), 37):
        if segmenter.vocabulary.types[i] != pieces.NORMAL:
            continue
        node = 0
        for c in segmenter.vocabulary.pieces[i]:
            to = segmenter.base[node] + segmenter.classes[c]
            assert segmenter.check[to] == node
            node = to
        assert segmenter.piece_of[node] == i


def test_encode_and_decode_documents(spark):
    docs = frame(spark)
    coded = pieces.encode_documents(docs)
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode_documents(coded).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in EDGES)
    assert all(r.round_trip for r in QUERIES["op3_piece_encoding"](spark, SF).collect())


# ---- Language scores ----


def slow_log10(counts, order, text):
    """The trie's model by plain counts of context and symbol."""
    past, total = [ppm.START] * order, 0.0
    for s in [*text.encode().translate(bytes(ppm.LOWER)), ppm.END]:
        out = set()
        for k in range(order, -1, -1):
            seen = {x: n for x, n in counts.get(tuple(past[len(past) - k :]), {}).items() if x not in out}
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if s in seen:
                total += math.log10(seen[s] / size)
                break
            total += math.log10(len(seen) / size)
            out |= seen.keys()
        else:
            total -= math.log10(ppm.SYMBOLS - len(out))
        past = [*past[1:], s]
    return total


def trie_of(texts, order, least=1):
    data, offsets = text_buffer(pa.array(texts))
    codes, n = ppm.gram_counts(ppm.symbols(data, offsets, order)[0], len(texts), order)
    return ppm.Trie(ppm.shorter_grams(codes, n, order, least))


@pytest.mark.parametrize("order", [1, 2, 5])
def test_trie_equals_plain_counts(order):
    texts = ["abracadabra", "Abba cab", "", "zé bad cab", "aaaa"]
    counts = {}
    for t in texts:
        past = [ppm.START] * order
        for s in [*t.encode().translate(bytes(ppm.LOWER)), ppm.END]:
            for k in range(order + 1):
                own = counts.setdefault(tuple(past[len(past) - k :]), {})
                own[s] = own.get(s, 0) + 1
            past = [*past[1:], s]
    probe = ["abra", "xyz", "", "cab bad", "\U0001f600q", "ABBA"]
    data, offsets = text_buffer(pa.array(probe))
    got = trie_of(texts, order).score(*ppm.symbols(data, offsets, order))
    assert np.allclose(got, [slow_log10(counts, order, t) for t in probe], atol=1e-4)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_probabilities_sum_to_one(least):
    """Over all next symbols of some contexts, also where rare grams are pruned."""
    trie = trie_of(["the cat sat on the mat", "the bat", "a hat"] * 3 + ["once"], 3, least)
    for context in ([], list(b"the"), list(b"q"), list(b"at")):
        total = 0.0
        for s in range(ppm.SYMBOLS):
            sym = np.array([ppm.START] * 3 + context + [s], np.uint16)
            with_s = trie.score(sym, np.array([3]))[0]
            without = trie.score(sym[:-1], np.array([3]))[0] if context else 0.0
            total += 10 ** (with_s - without)
        assert abs(total - 1) < 1e-3


def test_adaptive(spark):
    rows = [(1, "abab", "s"), (2, None, "s"), (3, "ABAB", "s")]
    got = {r.doc_id: r.score for r in ppm.adaptive_scores(frame(spark, rows)).collect()}
    assert got == {1: ppm.adaptive_log10("abab"), 2: ppm.adaptive_log10(""), 3: got[1]}
    assert ppm.adaptive_log10("") < 0
    assert ppm.adaptive_log10("abcabcabcabcabc" * 4) / 60 > ppm.adaptive_log10("q8z!kfw0xm")/10
    assert ppm.adaptive_log10("ABC") == ppm.adaptive_log10("abc")


@pytest.mark.parametrize("hot_share", [1e-6, 1e-3, 0.2])
def test_base_scores(spark, documents, hot_share):
    got = {r.doc_id: r for r in ppm.language_scores(spark.read.parquet(f"{SF}/documents.parquet"), hot_share=hot_share).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    tokens = {i: [*t.encode().lower().split(), b"\0"] for i, (t, _) in documents.items()}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, len(ws))
        assert r.score < 0


def test_scores_tell_text_from_noise(spark):
    """Held-out prose is likelier, a byte, than shuffled prose."""
    rng = random.Random(9)
    docs = [(r.doc_id, r.text, "s") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2]
    shuffled = [(i, "".join(rng.sample(t, len(t))), s) if i in held[::2] else (i, t, s) for i, t, s in docs]
    got = {r.doc_id: r.score for r in ppm.language_scores(frame(spark, shuffled)).collect()}
    rate = {i: got[i] / (len(t.encode()) + 1) for i, t, _ in shuffled if len(t) > 200}
    noise, prose = [rate[i] for i in held[::2] if i in rate], [rate[i] for i in held[1::2] if i in rate]
    assert np.mean(prose) > 1.5 * np.mean(noise)


@pytest.mark.parametrize("max_grams", [0, 1000, 1 << 20])
def test_no_gram_is_cut(spark, documents, max_grams):
    """Scores are those of the trie of all training texts, however few grams the workers get."""
    got = {r.doc_id: r for r in ppm.language_scores(spark.read.parquet(f"{SF}/documents.parquet"), max_grams=max_grams).collect()}
    texts = {i: t for i, (t, _) in documents.items()}
    trie = trie_of([t for i, t in texts.items() if not got[i].held_out], ppm.ORDER)
    want = trie.score(*ppm.symbols(*text_buffer(pa.array(list(texts.values())))))
    assert any(r.held_out for r in got.values())
    assert np.allclose([got[i].score for i in texts], want, rtol=1e-5, atol=1e-3)


def test_scores_equal_plain_counts(spark, documents):
    """The whole table against counts of contexts and symbols in dictionaries."""
    got = {r.doc_id: r for r in ppm.language_scores(spark.read.parquet(f"{SF}/documents.parquet"), max_grams=5000).collect()}
    counts: dict[tuple, dict[int, int]] = {}
    for i, (t, _) in documents.items():
        if got[i].held_out:
            continue
        past = [ppm.START] * ppm.ORDER
        for s in [*t.encode().translate(bytes(ppm.LOWER)), ppm.END]:
            for k in range(ppm.ORDER + 1):
                seen = counts.setdefault(tuple(past[len(past) - k :]), {})
                seen[s] = seen.get(s, 0) + 1
            past = [*past[1:], s]
    for i, (t, _) in documents.items():
        assert abs(got[i].score - slow_log10(counts, ppm.ORDER, t)) < 1e-4 * max(1, len(t))


# ---- Lengths ----


def test_lengths_equal_tokenizer(spark, documents):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=lengths.load_ranks(lengths.default_vocabulary()), special_tokens={})
    texts = TEXTS + ["a \x1c!b", "x\x1d\x1e y", "!\x1f!", "don't  stop\n\n\n  now ", " a b", "\n \n"] + [t for t, _ in documents.values()]
    got = lengths.Counter(lengths.load_ranks(lengths.default_vocabulary()), public_tokenizers.PATTERN).count([*texts, None])
    assert got == [*(len(encoding.encode_ordinary(t)) for t in texts), 0]


def test_histogram(spark):
    rng = random.Random(10)
    sizes = [rng.choice([0, 1, 5, 1023, 1024, 1025, 5000]) + rng.randint(0, 3) for _ in range(300)]
    histogram = lengths.length_histogram(spark.createDataFrame([(x,) for x in sizes], "n_tokens long")).cache()
    for r in histogram.collect():
        above = [x for x in sizes if x > r.limit]
        assert (r.n_docs, r.n_tokens) == (sizes.count(r.limit), sizes.count(r.limit) * r.limit)
        assert (r.docs_above, r.tokens_above, r.docs_within) == (len(above), sum(above), len(sizes) - len(above))
        assert r.truncated_total == sum(min(x, r.limit) for x in sizes) and r["quantile"] == (len(sizes) - len(above)) / len(sizes)
    for limit in (0, 3, 1024, 4000, 9999):
        t = lengths.totals_at(histogram, limit).first()
        assert t.truncated_total == sum(min(x, limit) for x in sizes) and t.docs_above == sum(x > limit for x in sizes)
    assert lengths.quantile_length(histogram, 0.5).first()[0] == sorted(sizes)[149]
    assert lengths.length_report(frame(spark, [])).count() == 0
    assert lengths.length_report(frame(spark)).agg({"n_docs": "sum"}).first()[0] == len(EDGES)


# ---- Pipeline ----


def materialized(spark, frame):
    return spark.createDataFrame(frame.collect(), frame.schema)


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its own input, against the operators' brute-force forms."""
    import corpus_pipeline
    from test_text_operators import brute_blocks, brute_near, words as words_of

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, all_ = docs.columns, {r.doc_id: r.text for r in docs.collect()}

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({ORACLES['op5_quality_rules']})").fetchall() if k}
    one = materialized(spark, stages["quality_rules"](spark, docs, SF))
    rows = {r.doc_id: r for r in one.collect()}
    assert one.columns == columns and rows.keys() == kept and 0.7 * len(all_) < len(kept)
    assert all(r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(all_[i].split("\n")) for i, r in rows.items())

    two = materialized(spark, stages["line_dedup"](spark, one, SF))
    gone = brute_blocks([(i, r.text) for i, r in rows.items()])
    want = {i: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[i]) for i, r in rows.items()}
    assert {r.doc_id: r.text for r in two.collect()} == {i: t for i, t in want.items() if words_of(t)}

    three = materialized(spark, stages["near_dedup"](spark, two, SF))
    near = brute_near([(r.doc_id, r.text) for r in two.collect()], 80)
    assert {r.doc_id for r in three.collect()} == {i for i, (_, _, k) in near.items() if k} and three.columns == columns

    four = materialized(spark, stages["source_mix"](spark, three, SF))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(three).collect()}
    assert collections.Counter(r.doc_id for r in four.collect()) == +collections.Counter(copies) and four.columns == columns

    five = materialized(spark, stages["encode"](spark, four, SF))
    texts = {r.doc_id: r.text for r in four.collect()}
    assert five.columns == ["doc_id", "ids", "score"] and five.count() == four.count()
    assert all(r.text == texts[r.doc_id] for r in pieces.decode_documents(five).collect())
    assert corpus_pipeline.run(spark, SF).count() == five.count()


CLASHES = [
    "host",
    "row",
    "bad",
    "same",
    "line",
    "whole",
    "lines",
    "key",
    "owner",
    "gone",
    "grp",
    "rep",
    "sign",
    "size",
    "copies",
    "ids",
    "score",
    "__row",
    "__key",
    "__text",
    "__words",
    "__chunks",
]


@pytest.mark.parametrize("rows", [EDGES, []])
def test_pipeline_edges(spark, rows):
    """Nulls, repeated rows, empty and long texts, empty tables, and columns named like those that stages use."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, None, s, None, *["x"] * len(CLASHES)) for i, t, s in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "encode" or out.columns == docs.columns
        got = out.collect()
        assert len(got) <= 3 * len(rows)
        docs = docs if name == "quality_rules" else spark.createDataFrame(got, out.schema)  # the rules would leave one text
