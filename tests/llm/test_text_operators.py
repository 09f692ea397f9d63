"""Quality rules, line dedup, near-duplicates, repeated strings and secrets against brute force, and their edges."""

import hashlib
import random
import re
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chunkspark.llm import linedup, neardup, rules, secrets, suffixes
from chunkspark.llm.common import text_buffer
from chunkspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, "", "h"),
    (2, None, "h"),
    (3, " \n\t ", None),
    (4, "one two", "h"),
    (5, "one two", "h"),
    (6, "word " * 30_000, "g"),
    (7, "x" * 200_000, "g"),
    (8, "é\U0001f600 ü" * 50, None),
    (None, "a b c d e f g h", "h"),
    (9, "a b c d e f g h\na b c d e f g h\n", "h"),
    (9, "a b c d e f g h", "h"),
    (9, "a b c d e f g h", "h"),
]
SCHEMA = "doc_id long, text string, source string, row string, __words string, hash string, key string"


def frame(spark, rows=EDGES):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "e", "e", "e", "e") for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


OPERATORS = {
    "op5": rules.quality_rules,
    "op7": suffixes.repeat_report,
    "op8": neardup.near_duplicates,
    "op9": linedup.line_report,
    "op10": secrets.secret_report,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_empty_table(spark, name):
    got = OPERATORS[name](frame(spark))
    assert got.count() == len(EDGES)
    assert OPERATORS[name](frame(spark, [])).count() == 0
    again = OPERATORS[name](frame(spark).repartition(3))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


# ---- Quality rules ----


@pytest.mark.parametrize("name", ORACLES)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    key = lambda f: sorted(tuple(x) for x in f[columns].astype(str).itertuples(index=False))
    assert key(got) == key(want)


def repeat_words(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 8)})


def test_repeated_windows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(60)] + ["a " * 9, "a " * 8]
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == repeat_words(t) and got[i].n_words == len(words(t))


def test_boilerplate(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    shop = "buy  NOW  " + " ".join(f"Shop{k}" for k in range(40)) + " "
    rows = [(i, f"{body(i)}\n{shop if i < 12 else 'line ' + str(i)}", "a") for i in range(30)]
    rows += [(100 + i, f"{shop}\n{shop.lower()}\nown {i}", "a") for i in range(3)] + [(200, f"{body(200)}\n{shop}", "b")]
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows), min_docs=5, min_left=0.3).collect()}
    assert all(got[i].kept and got[i].n_words_left == 30 for i in range(12))
    assert not any(got[100 + i].kept for i in range(3)) and got[200].n_words_left == got[200].n_words
    left = {r.doc_id: r for r in rules.clean_documents(frame(spark, rows), min_docs=5, min_left=0.3).collect()}
    assert left[0].text == body(0) and 100 not in left and left[200].text == rows[-1][1] and left[0]["__words"] == "e"


def test_limits_of_lines(spark):
    """Copies are documents; the share guards small hosts, the absolute limit does not rise with the host."""
    text = " ".join(f"w{k}" for k in range(40))
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(40))
    rows = [(i, text, "a") for i in range(12)] + [(100 + i, f"{body(i)}\n{text}", "b") for i in range(12)] + [(200 + i, body(200 + i), "b") for i in range(188)]
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(12))  # 12 of the 12 documents of their host
    assert all(got[100 + i].n_words_left == 80 for i in range(12))  # 12 of 200
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows), max_docs=12, min_left=0.4).collect()}
    assert all(got[100 + i].n_words_left == 40 and got[100 + i].kept for i in range(12))


def test_rules_on_long_texts(spark):
    """Texts of 10 MB: one line of distinct words, many lines, and one repeated line."""
    texts = [" ".join(f"w{k}" for k in range(1_300_000)), "\n".join(f"l{k} a b" for k in range(900_000)), "one two three four\n" * 550_000]
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect()}
    assert [got[i].n_words for i in range(3)] == [1_300_000, 2_700_000, 2_200_000]
    assert [got[i].n_dup_lines for i in range(3)] == [0, 0, 549_999]
    assert [got[i].n_repeat_words for i in range(3)] == [0, 0, 2_200_000]
    assert [got[i].kept for i in range(3)] == [True, True, False]


def test_rules_run_without_python(spark):
    plan = QUERIES["op5_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---- Line dedup ----


def test_patience_is_an_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = rng.choices(range(8), k=rng.randint(0, 15)), rng.choices(range(8), k=rng.randint(0, 15))
        pairs = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert linedup.patience(a, a) == [(i, i) for i in range(len(a))]
    assert linedup.patience([1, 2, 3], [0, 1, 2, 9, 3]) == [(0, 1), (1, 2), (2, 4)]


def test_lines_equal_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: set(r.gone) for r in linedup.duplicate_lines(docs).collect()}
    want = brute_blocks(list(documents.items()))
    assert got == want and any(want.values())
    left = {r.doc_id: r.text for r in linedup.dedup_lines(docs).collect()}
    for i, t in documents.items():
        rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert left.get(i, None) == (rest if words(rest) or not words(t) else None)


def test_line_edges(spark):
    long = "a b c d e f g h i j k l"
    rows = [(1, f"{long}\n\nshort\n{long}", "s"), (2, f"new line\n{long.upper()}", "s"), (3, f"{long}\n\nshort\n{long}", "s"), (4, None, None), (5, "", "s")]
    got = {r.doc_id: (list(r.gone), r.n_words_gone) for r in linedup.duplicate_lines(frame(spark, rows)).collect()}
    assert got == {1: ([], 0), 2: ([1], 12), 3: ([0, 2, 3], 25), 4: ([], 0), 5: ([], 0)}
    kept = {r.doc_id: r.text for r in linedup.dedup_lines(frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "new line", 4: None, 5: ""}


def line_rows(*texts):
    return [(i, t, "s") for i, t in enumerate(texts)]


def gone_lines(spark, *texts):
    return [list(r.gone) for r in sorted(linedup.duplicate_lines(frame(spark, line_rows(*texts))).collect(), key=lambda r: r.doc_id)]


def test_lines_meet_a_holder_of_the_block(spark):
    """Each line of a block also occurs alone in an earlier document of its own."""
    block = [f"l{k} a b c d e f" for k in range(9)]
    alone = [f"own{k} text\n{x}\nmore{k}" for k, x in enumerate(block)]
    got = gone_lines(spark, *alone, "\n".join(["first x", *block, "first y"]), "\n".join(["second x", *block]))
    assert got == [[]] * 10 + [list(range(1, 10))]


def brute_blocks(rows, least=10):
    """Every later document against all earlier ones: the lines of all blocks of `least` words or more that both have."""
    gone, where, wholes = {}, {}, set()
    for i, t in sorted(rows):
        lines = [(k, tuple(w.lower() for w in words(x))) for k, x in enumerate((t or "").split("\n")) if words(x)]
        key, gone[i] = tuple(x for _, x in lines), set()
        if key in wholes:
            gone[i] = {k for k, _ in lines}
            continue
        for m, x in enumerate(key):
            for other, j in where.get(x, ()):
                if m and j and other[j - 1] == key[m - 1]:
                    continue  # in the block that began before
                n = 0
                while m + n < len(key) and j + n < len(other) and key[m + n] == other[j + n]:
                    n += 1
                if sum(map(len, key[m : m + n])) >= least:
                    gone[i] |= {k for k, _ in lines[m : m + n]}
        for m, x in enumerate(key):
            where.setdefault(x, []).append((key, m))
        wholes |= {key} if key else set()
    return gone


def test_an_earlier_document_hides_no_block(spark):
    """A has both lines apart, B and C have them together: C loses them to B."""
    l1, l2, junk = "l1 a b c d e", "l2 a b c d e", "{} f g h i j k"
    a, b, c = f"{l1}\n{junk.format('x')}\n{l2}", f"{junk.format('y')}\n{l1}\n{l2}", f"{junk.format('z')}\n{l1}\n{l2}"
    assert gone_lines(spark, a, b, c) == [[], [], [1, 2]] and gone_lines(spark, b, c) == [[], [1, 2]]


def test_alignment_and_the_check_after_it(spark):
    """Passages in order are aligned; one that stands elsewhere, or a second time, goes by the check."""
    p, q = "p1 a b c d e\np2 a b c d e\np3 a b c d e", "q1 a b c d e\nq2 a b c d e"
    texts = [f"i0\n{p}\nm\n{q}", f"x\n{p}\ny\n{q}", f"u\n{q}\nv\n{p}", f"{p}\nw\n{p}"]
    got = sorted(linedup.duplicate_lines(frame(spark, line_rows(*texts))).collect(), key=lambda r: r.doc_id)
    assert [(len(r.gone), r.n_moved) for r in got] == [(0, 0), (5, 0), (5, 2), (6, 3)]


def test_pairs_carry_shared_runs_only(spark):
    """A long document with an owner for each of its lines: its rows in the join are its runs, once each."""
    lines = [f"line{k} a b c d e f g h i j" for k in range(300)]
    rows = line_rows(*[f"own {k}\n{x}" for k, x in enumerate(lines)], "\n".join(lines))
    got = {r.doc_id: list(r.gone) for r in linedup.duplicate_lines(frame(spark, rows)).collect()}
    assert got[300] == list(range(300)) and not any(got[k] for k in range(300))


def test_passages_that_are_there_twice_or_in_another_order(spark):
    p, q = "p1 a b c d e\np2 a b c d e\np3 a b c d e", "q1 a b c d e\nq2 a b c d e"
    assert gone_lines(spark, f"i1\n{p}\nm\n{p}\ne", f"x\n{p}\ny") == [[], [1, 2, 3]]
    assert gone_lines(spark, f"i1\n{p}\ne", f"x\n{p}\ny\n{p}\nz") == [[], [1, 2, 3, 5, 6, 7]]
    assert gone_lines(spark, f"{p}\n{q}\ni1", f"{q}\nx\n{p}") == [[], [0, 1, 3, 4, 5]]


def test_lines_equal_all_pairs(spark, documents):
    rng = random.Random(5)
    made = [(10_000 + i, "\n".join(" ".join([f"w{rng.randrange(4)}"] * rng.randint(0, 7)) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    for rows in (list(documents.items()), made):
        got = {r.doc_id: set(r.gone) for r in linedup.duplicate_lines(frame(spark, [(*r, "s") for r in rows])).collect()}
        assert got == brute_blocks(rows)


def test_blocks_of_short_lines(spark):
    poem = "\n".join(f"v{k} a b c" for k in range(20))
    assert gone_lines(spark, f"one\n{poem}\ntwo", f"three\n{poem}") == [[], list(range(1, 21))]


# ---- Near-duplicates ----


def brute_near(rows, percent, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(n, seed=3):
    """Copies, near copies around the limit, and one large group of near copies of a document."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, first = [], [word() for _ in range(120)]
    for i in range(n):
        base = first if i % 3 == 0 or not rows else words(rows[rng.randrange(len(rows))][1])
        w = list(base) if rng.random() < 0.8 and base else [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("similarity", [0.8, 0.85])
@pytest.mark.parametrize(("block", "key_block", "pivots"), [(512, 4096, 64), (16, 4, 3), (8, 4, 0)])
def test_near_equal_brute_force(spark, monkeypatch, similarity, block, key_block, pivots):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    monkeypatch.setattr(neardup, "KEY_BLOCK", key_block)
    rows = near_rows(150)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), similarity).collect()}
    assert got == brute_near([(i, t) for i, t, _ in rows], round(100 * similarity))


def test_near_rows_without_ids_and_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [
        (None, a, "s"),
        (7, a + " end", "s"),
        (3, a, "s"),
        (None, b, "s"),
        (None, b + " end", "s"),
        (9, c, "s"),
        (9, c, "s"),
        (9, "other words", "s"),
        (None, None, "s"),
    ]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert {x for x in got if x[2] == 3} == {(None, 56, 3, False), (7, 57, 3, False), (3, 56, 3, True)}
    assert sum(x[3] for x in got if x[1] in (56, 57) and x[2] is None) == 1 and (None, 0, None, True) in got
    assert got.count((9, 56, 9, True)) == 2 and (9, 1, 9, True) in got
    left = sorted((r.doc_id or 0, r.text or "") for r in neardup.without_near_duplicates(frame(spark, rows)).collect())
    assert len(left) == 5 and (3, a) in left and left.count((9, c)) == 1 and (9, "other words") in left and (0, "") in left


def test_near_on_documents(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op8_near_duplicates"](spark, SF).collect()}
    assert got == brute_near(list(documents.items()), 85)


def test_keys_guarantee_all_pairs_within_the_limit():
    rng = np.random.default_rng(4)
    limit = neardup.threshold(0.8)
    a = rng.integers(0, 1 << 16, (400, neardup.SLOTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.SLOTS, limit, replace=False)
        row[at] ^= 1
    assert (neardup.keys(a) == neardup.keys(b)).any(axis=1).all()
    with pytest.raises(ValueError):
        neardup.threshold(0.5)


# ---- Repeated strings ----


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "step"), [(1 << 16, 2 << 20), (1, 2 << 20), (1 << 16, 150)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, step):
    monkeypatch.setattr(suffixes, "STEP", step)
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "heavy_anchors", partial(suffixes.heavy_anchors, local=2))
    rng = random.Random(5)
    passage = "".join(rng.choices("abcd ", k=260))
    rows = []
    for i in range(40):
        t = "".join(rng.choices("abcd ", k=rng.randint(0, 400)))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, 120)
            t = t[: rng.randint(0, len(t))] + passage[cut : cut + rng.randint(80, 260)] + t[rng.randint(0, len(t)) :]
        rows.append((i, t, "s"))
    rows += [
        (100, "ab" * 200, "s"),
        (101, "q" + "ab" * 90, "s"),
        (102, "z" * 350, "s"),
        (103, "z" * 99, "s"),
        (104, "é" * 120, "s"),
        (105, "xé" + "é" * 60, "s"),
        (106, None, "s"),
    ]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeat_report(frame(spark, rows)).collect()}
    assert got == brute_repeats([(i, t) for i, t, _ in rows])


def test_repeats_on_documents(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_repeated_strings"](spark, SF).collect()}
    assert got == brute_repeats(list(documents.items()))


@pytest.mark.parametrize("shard", [60, 500, 1 << 17])
def test_merged_transforms(shard):
    """Equal windows share a block, others do not, for any cut into shards."""
    rng = np.random.default_rng(6)
    base = rng.integers(97, 99, 300).astype(np.uint8)
    strings = []
    for _ in range(25):
        a = int(rng.integers(0, 150))
        s = base[a : a + int(rng.integers(90, 150))].copy()
        if rng.random() < 0.5:
            s[int(rng.integers(0, len(s)))] = 99
        strings.append(s)
    lengths = np.array([len(s) for s in strings])
    data = np.concatenate(strings)
    got = suffixes.repeated_windows(data, lengths, shard)
    places: dict[bytes, list[int]] = {}
    at = np.concatenate([[0], np.cumsum(lengths)])
    for k, n in enumerate(lengths):
        for i in range(n - 99):
            places.setdefault(data[at[k] + i : at[k] + i + 100].tobytes(), []).append(at[k] + i)
    want = np.full(len(data), False)
    blocks = set()
    for own in places.values():
        if len(own) > 1:
            want[own] = True
            assert len(set(got[own])) == 1
            blocks.add(got[own[0]])
    assert ((got >= 0) == want).all() and len(blocks) == sum(len(v) > 1 for v in places.values())


def test_merge_gives_common_prefixes():
    symbols = [np.array([1, 2, 1, 2, 3]), np.array([1, 2, 1, 2, 1])]
    shards = [suffixes.Transform(s, np.array([1, 2, 3, 4, -1])) for s in symbols]
    which, block, common = suffixes.merge(shards, 3)
    taken = [iter(t.order.tolist()) for t in shards]
    merged = [tuple(symbols[w][i - 1 :].tolist()) if (i := next(taken[w])) else () for w in which.tolist()]
    # In order by three symbols, ends first; blocks are what is equal there.
    assert [t[:3] for t in merged] == sorted(t[:3] for t in merged)
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common[1:].tolist() == [min(3, prefix(a, b)) for a, b in zip(merged, merged[1:], strict=False)]
    assert [x == y for x, y in zip(block[2:], block[3:], strict=False)] == [len(a) > 2 and a[:3] == b[:3] for a, b in zip(merged[2:], merged[3:], strict=False)]


# ---- Secrets ----


def brute_secrets(text):
    out = []
    for k, (pattern, flags, group, least) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), (r"AKIA[A-Z0-9]+", re.A, 0, 16), (r"[0-9a-f]+", re.A, 0, 32)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(f"{secrets.BASE_KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


PARTS = (
    [
        "password",
        "TOKEN",
        "api_key",
        "apikey",
        "secret",
        "passwd",
        "AKIA",
        "ABCDEFGH1234",
        "=",
        " : ",
        '"',
        "'",
        " ",
        "\n",
        "é\U0001f600",
        "0123456789abcdef" * 2,
        "dead",
        "x9/+_.-",
    ]
    + [
        "ghp_" + "a" * 36,
        "K",
        "ſecret=12345678",
        "eyJ",
        "eyJab",
        ".",
        "-",
        "_",
        "://",
        "user",
        ":",
        "@",
        "host.org",
        "Bearer  ",
        "-----BEGIN ",
        "RSA ",
        "PRIVATE KEY-----",
        "/",
        "a" * 21,
    ]
    + ["token=abc", "secret: token"] + [re.sub(r"[\\^$()?*+]|x20|\[[^]]*\]|\|.*", "", rule.prefix) for rule in secrets.MORE_RULES]
)


def secret_rows():
    rng = random.Random(7)
    return [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 40))), "s") for i in range(400)] + [
        (900, "f" * 100_000, "s"), (901, "password=" + "a" * 5000, "s"), (902, None, "s"),
    ]


def all_spans(text, rules=secrets.RULES):
    """Every rule's expression by the regular expression engine, then the tails that are long enough."""
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.A | (re.I if rule.any_case else 0)):
            if len(m[m.re.groups]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in spans)


def test_secrets_equal_brute_force(spark, documents):
    rows = secret_rows()
    texts = {i: t for i, t, _ in rows}
    for r in secrets.secret_report(frame(spark, rows)).collect():
        want = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in secrets.BASE_KINDS)
        assert r.spans == joined(all_spans(texts[r.doc_id]))
    for r in QUERIES["op10_secret_scan"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(brute_secrets(documents[r.doc_id]).encode()).hexdigest()
        assert r.spans == joined(all_spans(documents[r.doc_id]))


def scanned(scanner, texts):
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in coded])]).astype(np.int64)
    found = dict(scanner.spans(data, offsets))
    return [secrets.code_points(data[i:j], found[r]) if r in found else [] for r, (i, j) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]


def test_every_kind_is_exact():
    scanner = secrets.Scanner()
    rng = random.Random(11)
    samples = {}
    for rule in secrets.RULES:
        prefix = {
            "assign": "Api_Key' : \"",
            "private_key": "-----BEGIN RSA PRIVATE KEY----",
            "jwt": "eyJhbGc.eyJ",
            "bearer": "BEARER ",
            "url_login": "https://me:pw%20@",
            "aws_session": "ASIA",
            "github": "gho_",
            "slack": "xoxp-",
            "slack_hook": "hooks.slack.com/services/",
            "stripe": "rk_live_",
            "square": "sq0csp-",
            "shopify": "shppa_",
            "telegram": "12345678:AA",
            "digitalocean": "doo_v1_",
            "google_token": "ya29.",
            "sendgrid": "SG.",
        }.get(rule.kind, rule.prefix)
        tail = next(c for c in "A-a0" if re.fullmatch(rule.tail, c))
        samples[rule.kind] = prefix + tail * rule.least
        for text, times in ((f"é {samples[rule.kind]} x", 1), (f"é {samples[rule.kind][:-1]} x", 0)):
            assert sum(scanned(scanner, [text])[0].count(x) for x in all_spans(text)) == len(all_spans(text))
            assert sum(rule.kind == secrets.RULES[k].kind for _, k, _ in scanned(scanner, [text])[0]) == (times if rule.least > 1 or times else 0)
    texts = ["".join(rng.choices([*PARTS, *samples.values()], k=rng.randint(0, 50))) for _ in range(1500)]
    assert scanned(scanner, texts) == [all_spans(t) for t in texts]


@pytest.mark.parametrize("lane", [7, 64, 512])
def test_states_are_those_of_one_pass(lane):
    a = secrets.Scanner().forward
    texts = [t.encode() for _, t, _ in secret_rows()[:200] if t] + [b"token" + b" " * 3000 + b"=x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    after, row = secrets.states(a, data, offsets, lane)
    want = []
    for t in texts:
        now = 0
        for b in t:
            now = int(a.step[now * a.n_classes + int(a.classes[b])])
            want.append(now)
    assert after.tolist() == want and row.tolist() == [k for k, t in enumerate(texts) for _ in t]


def test_long_text_in_stretches(monkeypatch):
    scanner = secrets.Scanner()
    rng = random.Random(12)
    texts = ["".join(rng.choices(PARTS, k=300)) for _ in range(6)] + ["f" * 1000, "é" * 400 + "0" * 33]
    monkeypatch.setattr(secrets, "STEP_BYTES", 41)
    assert scanned(scanner, texts) == [all_spans(t) for t in texts]


def test_texts_that_are_hard_to_scan():
    """Long runs of what a rule repeats, and starts at every few bytes: linear, and exact."""
    scanner = secrets.Scanner()
    texts = [
        "token: a " * 20_000,
        "eyJ" * 2_000,
        "sk-" * 5_000,
        "token" + " " * 200_000 + "= abcdefghijk",
        "eyJa." * 2_000,
        "://a:" * 2_000,
        "secret: token: " * 10_000,
    ]
    assert scanned(scanner, texts) == [all_spans(t) for t in texts]


def test_automaton_is_minimal():
    a = secrets.automaton([secrets.parsed("ab|cb")], True)
    assert len(a.accepts) == 3 and a.accepts.tolist().count(1) == 1
    with pytest.raises(ValueError):
        secrets.parsed(r"\d")
