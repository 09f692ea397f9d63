"""Language-model scores by prediction by partial matching over bytes.

Model: a trie of byte contexts up to ORDER, learned from counts of the training documents. A symbol is coded in the
longest context that the trie has; a context of T counts over d symbols leaves d / (T + d) to the escape to the next
shorter one (method C), where the symbols of the longer context are excluded. After the empty context all symbols
not seen there are alike. A text ends in a symbol of its own, so the code lengths are those of whole texts.

Pretrained: counts of all (ORDER + 1)-grams of the corpus are summed by Spark, and none is cut, so the model grows with
the corpus. What a symbol costs depends on its gram alone: `gram_costs` gives that of every gram of the table, level by
level in joins by suffix and sums by context, where a key has at most SYMBOLS rows. The most frequent grams (`max_grams`
at most) go to the workers with their costs; the rest of a text's grams meet theirs in a join, as rare words do. `Trie`
is the same model in the memory of one process.
Adaptive: `adaptive_log10` learns from the text itself while it codes it.

Base: add-one word counts over the whole corpus. Words with a share of 1e-6 of all tokens or more (a million at
most) go to the workers; the rest of a text's words meet their counts in a join.

Null text is empty. Repeated ids are separate rows. A null id is learned from. An empty training set leaves the
uniform model. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER, mix, session_ready, steps, text_buffer, word_hashes

ORDER = 5
BITS = 9
END, START = 256, 257
SYMBOLS = 257
#: Symbols that one step of arrays handles, in counting and in scoring; a longer text takes several.
CHUNK = 1 << 21
SCORED = 1 << 18
#: The end of a text among the words' hashes.
END_WORD = np.int64(-7046029254386353131)
#: The kind of a text's own row, beside words (0) and grams (1).
OWN = -1


def symbols(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one row of symbols, each with `order` starts before it and an end after it; each text's begin."""
    extra = order + 1
    out = np.full(len(data) + (len(offsets) - 1) * extra, START, np.uint16)
    begin = offsets[:-1] + np.arange(len(offsets) - 1) * extra + order
    for i, j, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), begin.tolist(), strict=True):
        out[at : at + j - i] = LOWER[data[i:j]]
        out[at + j - i] = END
    return out, begin


def gram_codes(sym: np.ndarray, i: int, j: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-grams that end at the symbols i to j that are no starts, the last symbol in the lowest bits; their places."""
    before = min(i, order)
    wide = sym[i - before : j].astype(np.uint64)
    code = wide.copy()
    for k in range(1, order + 1):
        code[k:] |= wide[:-k] << np.uint64(BITS * k)
    real = np.flatnonzero(sym[i:j] != START)
    return code[before:][real], real + i


def gram_counts(sym: np.ndarray, texts: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (order + 1)-grams, the last symbol in the lowest bits, and their counts; one gram of starts a text."""
    found = []
    for i in range(0, len(sym), CHUNK):
        found.append(np.unique(gram_codes(sym, i, i + CHUNK, order)[0], return_counts=True))
    code, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n = np.zeros(len(code), np.int64)
    np.add.at(n, back, np.concatenate([m for _, m in found]) if found else np.zeros(0, np.int64))
    start = np.uint64(sum(START << BITS * k for k in range(order + 1)))
    return np.append(code, start), np.append(n, texts)


class Trie:
    """The context trie as arrays: for each gram length a table (context, symbol) -> gram, and costs by context."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        """grams[k]: sorted codes of k + 1 symbols and their counts; suffixes and prefixes of a gram are in the others."""
        seen = np.unique(np.concatenate([c & np.uint64((1 << BITS) - 1) for c, _ in grams[:1]])).astype(np.int64) if grams else np.zeros(0, np.int64)
        self.index = np.full(START + 1, len(seen), np.uint16)
        self.index[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        self.next: list[np.ndarray] = []
        self.row: list[np.ndarray] = []
        self.log_count: list[np.ndarray] = []
        self.log_total: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        self.log_rest: list[np.ndarray] = []
        self.escape_rest: list[np.ndarray] = []
        totals = kinds = looses = None
        for k, (codes, counts) in enumerate(grams):
            last = (codes & np.uint64((1 << BITS) - 1)).astype(np.int64)
            before = np.searchsorted(grams[k - 1][0], codes >> np.uint64(BITS)) if k else np.zeros(len(codes), np.int64)
            contexts = len(grams[k - 1][0]) if k else 1
            real = last != START
            # A context's count also holds the symbols that were too rare to be kept; they go to its escape.
            total = np.asarray(grams[k - 1][1], float) if k else np.array([counts[real].sum()], float)
            kept = np.bincount(before[real], counts[real], contexts)
            total = np.maximum(total, kept)
            kind = np.bincount(before[real], minlength=contexts)
            # Only contexts with a symbol get a row in the table; row 0 has none.
            row = np.zeros(contexts + 1, np.int32)
            has = np.bincount(before, minlength=contexts) > 0
            row[:-1][has] = np.arange(1, has.sum() + 1)
            table = np.full((int(has.sum()) + 1) * self.width, len(codes), np.int32)
            table[row[before].astype(np.int64) * self.width + self.index[last]] = np.arange(len(codes))
            self.row.append(row)
            self.next.append(table)
            self.log_count.append(np.append(np.log10(counts), 0).astype(np.float32))
            with np.errstate(divide="ignore", invalid="ignore"):
                self.log_total.append(np.append(np.where(kind, np.log10(total + kind), -1), -1).astype(np.float32))
                loose = total - kept + kind
                self.escape.append(np.append(np.where((kind > 0) & (kind < SYMBOLS), np.log10((total + kind) / loose), 0), 0).astype(np.float32))
                if k:
                    # What the shorter context has besides the symbols of the longer one.
                    mask = np.uint64((1 << BITS * (k - 1)) - 1)
                    shorter = np.searchsorted(grams[k - 2][0], grams[k - 1][0] & mask) if k > 1 else np.zeros(contexts, np.int64)
                    own = np.searchsorted(grams[k - 1][0], codes & np.uint64((1 << BITS * k) - 1))
                    shared = np.bincount(before[real], grams[k - 1][1][own][real], contexts)
                    rest_total, rest_kinds = totals[shorter] - shared, kinds[shorter] - kind
                    rest = rest_total + rest_kinds
                    rest_loose = looses[shorter] - kind
                    self.log_rest.append(np.append(np.where(rest > 0, np.log10(np.maximum(rest, 1e-9)), 0), 0).astype(np.float32))
                    self.escape_rest.append(
                        np.append(np.where(rest_loose > 0, np.log10(np.maximum(rest, 1e-9) / np.maximum(rest_loose, 1e-9)), 0), 0).astype(np.float32),
                    )
            totals, kinds, looses = total, kind, loose
        self.uniform = math.log10(max(1, SYMBOLS - int(kinds_0(grams))))

    def score(self, sym: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        out = np.zeros(len(begin))
        reach = len(self.next) + 1  # a gram's chain begins so many symbols before its end
        for i in range(0, len(sym), SCORED):
            before = min(i, reach)
            at, cost = self._costs(sym[i - before : i + SCORED], before)
            out -= np.bincount(np.searchsorted(begin, at + i - before, "right") - 1, cost, len(begin))
        return out

    def _costs(self, sym: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Places, from `skip` on, of the symbols that are no starts, and the code length of each."""
        levels = len(self.next)
        at = skip + np.flatnonzero(sym[skip:] != START)
        cost = np.zeros(len(at), np.float64)
        if not levels:
            return at, cost + math.log10(SYMBOLS)
        code = self.index[sym].astype(np.int64)
        nodes = [np.zeros(len(sym), np.int32)]
        for k in range(levels):
            before = np.empty(len(sym), np.int64)
            before[0] = self.row[k][-1] if k else self.row[0][0]
            before[1:] = self.row[k][nodes[k][:-1]]
            before *= self.width
            before += code
            nodes.append(self.next[k][before])
        todo, begun = np.arange(len(at)), np.zeros(len(at), bool)
        for k in range(levels - 1, -1, -1):
            where = at[todo]
            context = nodes[k][where - 1] if k else np.zeros(len(where), np.int32)
            gram = nodes[k + 1][where]
            found = gram < len(self.log_count[k]) - 1
            total = self.log_total[k][context]
            fresh = ~begun & (total >= 0)
            if k < levels - 1:
                longer = nodes[k + 1][where - 1]
                add = np.where(begun, np.where(found, self.log_rest[k][longer], self.escape_rest[k][longer]), 0)
            else:
                add = np.zeros(len(where), np.float32)
            add = np.where(fresh, np.where(found, total, self.escape[k][context]), add)
            cost[todo] += np.where(found, add - self.log_count[k][gram], add)
            begun |= fresh
            todo, begun = todo[~found], begun[~found]
        cost[todo] += self.uniform
        return at, cost


class Costs:
    """Costs by gram in an open-addressed table of arrays."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, codes: np.ndarray, costs: np.ndarray):
        bits = max(4, (4 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY, np.uint64)
        self.costs = np.zeros(1 << bits, np.float32)
        codes, todo = codes.astype(np.uint64), np.arange(len(codes))
        at = self._first(codes)
        while len(todo):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = codes[todo[free]]
            put = self.keys[at] == codes[todo]
            self.costs[at[put]] = costs[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & self.mask

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return (mix(codes) >> self.shift).astype(np.int64)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each gram, 0 for those that are not here; and which are here."""
        at = self._first(codes)
        keys = self.keys[at]
        here = keys == codes
        cost = np.where(here, self.costs[at], np.float32(0))
        todo = np.flatnonzero(~here & (keys != self.EMPTY))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            keys = self.keys[at]
            hit = keys == codes[todo]
            here[todo[hit]], cost[todo[hit]] = True, self.costs[at[hit]]
            more = ~hit & (keys != self.EMPTY)
            todo, at = todo[more], at[more]
        return cost, here

    def score(self, sym: np.ndarray, begin: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log10 probability as far as its grams are here; text, gram and number of those that are not."""
        out = np.zeros(len(begin))
        loose: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(sym), SCORED):
            code, at = gram_codes(sym, i, i + SCORED, order)
            doc = np.searchsorted(begin, at, "right") - 1
            cost, here = self.of(code)
            out -= np.bincount(doc, cost, len(begin))
            if not here.all():
                doc, code = doc[~here], code[~here]
                by = np.lexsort((code, doc))
                doc, code = doc[by], code[by]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]))
                loose.append((doc[first], code[first], np.diff(np.append(first, len(doc)))))
        doc, code, times = (np.concatenate([x[k] for x in loose]) if loose else np.zeros(0, np.int64) for k in range(3))
        return out, doc, code.astype(np.int64), times


class Model:
    """What scoring needs, sent to each worker once; the table of costs is built there at first use and kept."""

    def __init__(self, hot_codes: np.ndarray, hot_counts: np.ndarray, grams: np.ndarray, costs: np.ndarray):
        self.hot_codes, self.hot_counts, self.grams = hot_codes, hot_counts, (grams, costs)
        self._costs: Costs | None = None

    def costs(self) -> Costs:
        if self._costs is None:
            self._costs, self.grams = Costs(*self.grams), ()
        return self._costs


def kinds_0(grams: list[tuple[np.ndarray, np.ndarray]]) -> int:
    return int((grams[0][0] != START).sum()) if grams else 0


def shorter_grams(codes: np.ndarray, counts: np.ndarray, order: int = ORDER, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of 1 to order + 1 symbols from those of order + 1, as far as they occur `least` times."""
    out = []
    for k in range(order + 1):
        short, place = np.unique(codes & np.uint64((1 << BITS * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(place, counts, len(short))
        out.append((short[n >= least], n[n >= least]))
    return out


def adaptive_log10(text: str, order: int = ORDER) -> float:
    """log10 probability of a text by a model that starts empty and learns each symbol after coding it."""
    table: dict[tuple[int, ...], dict[int, int]] = {}
    past: list[int] = [START] * order
    total = 0.0
    for s in [*text.encode().translate(bytes(LOWER)), END]:
        out: set[int] = set()
        for k in range(order, -1, -1):
            seen = {x: n for x, n in table.get(tuple(past[len(past) - k :]), {}).items() if x not in out}
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if s in seen:
                total += math.log10(seen[s] / size)
                break
            total += math.log10(len(seen) / size)
            out |= seen.keys()
        else:
            total -= math.log10(SYMBOLS - len(out))
        for k in range(order + 1):
            counts = table.setdefault(tuple(past[len(past) - k :]), {})
            counts[s] = counts.get(s, 0) + 1
        past = [*past[1:], s] if order else past
    return total


def held_out(id_col: str = "doc_id"):
    """Documents whose crc32 of the id as text is 2 modulo 7; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and each text's first word (one entry more at the end); without the ends."""
    hashes, _, first = word_hashes(LOWER[data], offsets)
    return hashes.view(np.int64), first


def corpus_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """kind, code, n, held: the counts of all words (kind 0, by hash, ends too) and of all byte grams (kind 1) of `texts`
    (text, held_out) that are not held out; held: the counts of grams in those that are, whose words are not counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By kind, parts of codes and counts that are summed when they grow large, and given out when that is not enough.
        # Kind 2: grams of texts that are held out.
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]
        size = [0, 0, 0]

        def summed(kind: int) -> None:
            codes, n = (np.concatenate([part[x] for part in held[kind]]) for x in (0, 1))
            held[kind].clear()
            order = np.argsort(codes)
            codes = codes[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            held[kind].append((codes[first], np.add.reduceat(n[order], first)))
            size[kind] = len(first)

        def out(kind: int) -> pa.RecordBatch:
            codes, n = held[kind].pop()
            size[kind] = 0
            learned, other = (np.zeros_like(n), n) if kind == 2 else (n, np.zeros_like(n))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), min(kind, 1), np.int8)), pa.array(codes), pa.array(learned), pa.array(other)],
                names=["kind", "code", "n", "held"],
            )

        for batch in batches:
            for out_of in (False, True):
                data, offsets = text_buffer(batch.column(0).filter(pc.equal(batch.column(1), out_of)))
                for i, j in steps(offsets):
                    part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    kinds = (2,) if out_of else (0, 1)
                    if not out_of:
                        tokens, n_words = np.unique(text_tokens(part, own)[0], return_counts=True)
                        held[0].append((np.append(tokens, END_WORD), np.append(n_words, j - i)))
                    grams, n_grams = gram_counts(symbols(part, own, order)[0], j - i, order)
                    held[kinds[-1]].append((grams.view(np.int64), n_grams))
                    for kind in kinds:
                        size[kind] += len(held[kind][-1][0])
                        if size[kind] > 1_500_000:
                            summed(kind)
                            if size[kind] > 1_000_000:
                                yield out(kind)
        for kind in range(3):
            if held[kind]:
                summed(kind)
                yield out(kind)

    return texts.mapInArrow(count, "kind byte, code long, n long, held long").groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def gram_costs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """code, times (in all texts), cost (-log10 of the probability of its last symbol after the others) of every gram of
    order + 1 symbols in `counts`, also of those that only texts held out have.

    By levels k: a gram of k + 1 symbols has its `cost` and, if it was never seen, what the levels below add after an
    escape from its context (`rest`). Both need the gram without its first symbol, at level k - 1, and sums over the
    grams of its context.
    """
    grams = counts.where((F.col("kind") == 1) & (F.col("code").bitwiseAND(F.lit((1 << BITS) - 1)) != START)).select("code", "n", "held")
    log, seen = F.log10, F.col("n") > 0
    zero = F.lit(0.0)
    below = None
    for k in range(order + 1):
        mask = F.lit((1 << BITS * (k + 1)) - 1)
        now = grams.groupBy(F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("n").alias("n"), F.sum("held").alias("held")) if k < order else grams
        if below is None:
            # Level 0 has at most SYMBOLS rows.
            own = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.when(seen, 1)).alias("kinds")).first()
            now = now.withColumn("total", F.lit(own["total"]).cast("long")).withColumn("kinds", F.lit(own["kinds"]).cast("long"))
            now = now.withColumn("rest", F.lit(math.log10(max(1, SYMBOLS - own["kinds"])))).withColumn("without", F.col("rest"))
        else:
            short = F.lit((1 << BITS * k) - 1)
            below = below.select(
                F.col("code").alias("suffix"),
                F.col("n").alias("n1"),
                F.col("total").alias("total1"),
                F.col("kinds").alias("kinds1"),
                F.col("rest").alias("rest1"),
                F.col("cost").alias("without"),
            )
            now = now.withColumn("suffix", F.col("code").bitwiseAND(short)).join(below, "suffix")
            context = Window.partitionBy(F.shiftright("code", BITS))
            now = (
                now.withColumn("total", F.sum("n").over(context))
                .withColumn("kinds", F.count(F.when(seen, 1)).over(context))
                .withColumn("shared", F.sum(F.when(seen, F.col("n1")).otherwise(0)).over(context))
            )
            # What the shorter context has besides the symbols of this one.
            kinds = F.col("kinds1") - F.col("kinds")
            size = F.col("total1") - F.col("shared") + kinds
            now = now.withColumn(
                "rest",
                F.when(seen, zero).when(F.col("n1") > 0, log(size) - log("n1")).otherwise(F.when(kinds > 0, log(size / kinds)).otherwise(zero) + F.col("rest1")),
            )
        whole = F.col("total") + F.col("kinds")
        escape = F.when(F.col("kinds") < SYMBOLS, log(whole / F.col("kinds"))).otherwise(zero) + F.col("rest")
        # A context that was never seen leaves the symbol to the shorter one.
        now = now.withColumn("cost", F.when(F.col("kinds") == 0, F.col("without")).when(seen, log(whole) - log("n")).otherwise(escape))
        below = now.select("code", "n", "held", "total", "kinds", "rest", "cost")
    return below.select("code", (F.col("n") + F.col("held")).alias("times"), "cost")


def least_times(grams: DataFrame, max_grams: int) -> int:
    """The least power of two that at most `max_grams` grams reach; the driver sees 64 rows at most."""
    reach = {r["p"]: r["m"] for r in grams.groupBy(F.floor(F.log2("times")).alias("p")).agg(F.count("*").alias("m")).collect()}
    power, total = 0, sum(reach.values())
    while total > max_grams:
        total -= reach.get(power, 0)
        power += 1
    return 1 << power


def language_scores(
    docs: DataFrame, order: int = ORDER, max_grams: int = 1 << 20, hot_share: float = 1e-6, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns from what is not held out."""
    spark = docs.sparkSession
    session_ready(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out())
    counts = corpus_counts(source.select("text", "held_out"), order).checkpoint()
    total = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = total["n"], total["v"]
    least = max(1, math.ceil(n_all * hot_share))
    hot = counts.where((F.col("kind") == 0) & (F.col("n") >= least)).select("code", "n").toArrow()
    codes, ns = hot.column("code").to_numpy(), hot.column("n").to_numpy()
    at = np.argsort(codes)
    grams = gram_costs(counts, order).checkpoint()
    often = least_times(grams, max_grams)
    first = grams.where(F.col("times") >= often).select("code", "cost").toArrow()
    # Proven bounds: 1 / hot_share words and max_grams grams; what is beyond them is joined.
    model = spark.sparkContext.broadcast(Model(codes[at], ns[at], first.column("code").to_numpy(), first.column("cost").to_numpy().astype(np.float32)))
    whole = math.log10(n_all + distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_codes, hot_counts, costs = model.value.hot_codes, model.value.hot_counts, model.value.costs()
        logs = np.log10(np.append(hot_counts, 0) + 1.0)
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            for i, j in steps(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                rows = j - i
                tokens, first = text_tokens(part, own)
                n_words = np.diff(first)
                doc = np.repeat(np.arange(rows), n_words)
                uniq, place = np.unique(tokens, return_inverse=True)
                spot = np.searchsorted(hot_codes, uniq)
                known = np.zeros(len(uniq), bool)
                if len(hot_codes):
                    known = hot_codes[np.minimum(spot, len(hot_codes) - 1)] == uniq
                gain = np.where(known, logs[np.where(known, spot, len(hot_codes))], 0)
                sums = np.bincount(doc, gain[place], rows).astype(float)
                n_known = np.bincount(doc, known[place], rows).astype(np.int64)
                end = np.searchsorted(hot_codes, END_WORD)
                end_hot = end < len(hot_codes) and hot_codes[end] == END_WORD
                sums += logs[end] if end_hot else 0
                n_known += int(end_hot)
                bytes_cost, gram_doc, gram, gram_times = costs.score(*symbols(part, own, order), order)
                loose = ~known[place]
                pair, times = np.unique(doc[loose] * len(uniq) + place[loose], return_counts=True)
                pair = np.column_stack(np.divmod(pair, max(1, len(uniq))))
                if not end_hot:  # the end is as rare as any word where texts are long
                    pair = np.concatenate([pair, np.column_stack([np.arange(rows), np.full(rows, len(uniq))])])
                    times = np.concatenate([times, np.ones(rows, np.int64)])
                    uniq = np.append(uniq, END_WORD)
                m = len(pair) + len(gram)
                take = pa.array(np.concatenate([np.arange(rows), pair[:, 0], gram_doc]))
                pad = lambda x, kind: pa.array(np.concatenate([x, np.zeros(m, x.dtype)]), kind)  # noqa: B023, E731
                # A text's own row has its name in the place of a word, so these rows spread evenly.
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, rows).take(take), batch.column(1).slice(i, rows).take(take), batch.column(2).slice(i, rows).take(take),
                    pa.array(np.repeat(np.array([OWN, 0, 1], np.int8), [rows, len(pair), len(gram)])),
                    pa.array(np.concatenate([batch.column(0).slice(i, rows).to_numpy(), uniq[pair[:, 1]], gram])),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), times, gram_times])),
                    pad(n_words + 1, pa.int64()), pad(n_known, pa.int64()), pad(sums, pa.float64()), pad(bytes_cost, pa.float64()),
                ], names=["row", "doc_id", "held_out", "kind", "code", "times", "n_tokens", "n_known", "gain", "score"])

    schema = f"row long, doc_id {id_type}, held_out boolean, kind byte, code long, times long, n_tokens long, n_known long, gain double, score double"
    # A row is named by what it holds, so a task that runs again gives the same names. Equal rows have equal sums: these
    # are divided by the rows' number, and each gets its own.
    parts = source.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "held_out", "text").mapInArrow(score, schema)
    rare = counts.where((F.col("kind") == 0) & (F.col("n") < least)).select(
        F.col("kind").alias("rare_kind"), F.col("code").alias("rare_code"), F.log10(F.col("n") + 1).alias("value"),
    )
    rest = grams.where(F.col("times") < often).select(F.lit(1).cast("byte").alias("rare_kind"), F.col("code").alias("rare_code"), F.col("cost").alias("value"))
    met = parts.join(rare.unionByName(rest), (F.col("kind") == F.col("rare_kind")) & (F.col("code") == F.col("rare_code")), "left")
    of_word = (F.col("kind") == 0) & F.col("value").isNotNull()
    out = met.groupBy("doc_id", "row").agg(
        F.first("held_out").alias("held_out"),
        F.sum((F.col("kind") == OWN).cast("long")).alias("m"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(of_word, F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("gain") + F.sum(F.when(of_word, F.col("times") * F.col("value")).otherwise(0.0))).alias("gain"),
        (F.sum("score") - F.sum(F.when(F.col("kind") == 1, F.col("times") * F.col("value")).otherwise(0.0))).alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    n_tokens = F.expr("n_tokens DIV m")
    return out.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        F.expr("n_known DIV m").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("gain") / F.col("m") - n_tokens * F.lit(whole)).alias("base_score"),
        (F.col("score") / F.col("m")).alias("score"),
    )


def adaptive_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the adaptive model's log10 probability of each text: no corpus, one pass, symbol by symbol."""
    session_ready(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [adaptive_log10(t or "", order) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double")
