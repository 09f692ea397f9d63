"""Secret scan: all rules compiled into one deterministic automaton that reads each byte once.

A rule is a prefix and a tail: the prefix is an expression, the tail a class of characters that repeats, `least` times or
more in a span that is kept. The rules' expressions become a Thompson automaton, subset construction makes it deterministic,
partition refinement makes it minimal, and the result is one transition array over classes of bytes. It holds each rule up to
the first character of its tail: from there on a rule stays in one state for as long as the class goes on, and to hold that
for all rules at once would multiply the states, so tails are kept apart, as one class a rule.

Spans come from arrays alone. Where the automaton accepts a rule, its tail begins, and it ends where its class ends. The
rule's own automaton for the reversed expression, run back from there, gives the leftmost start. Of a rule's spans in a text
the leftmost are taken and none that overlaps one taken before, as a search for the rule's expression does; then spans with
too short a tail are dropped. (Rules have to be such that a longer prefix is no other reading of the same text, as here.)

A batch of texts is cut into lanes that step through the array together. A lane begins in the state that the end of the
lane before it leads to; the few for which that is not enough are run again, so the states are those of a single pass. A
long text is read in stretches.

Null text is empty. Repeated ids each give a row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import STEP_BYTES, session_ready, steps, text_buffer


@dataclass(frozen=True)
class Rule:
    """prefix: an expression, or nothing; tail: a class; least: characters of the tail in a span that is kept."""

    kind: str
    prefix: str
    tail: str
    least: int = 1
    any_case: bool = False

    @property
    def pattern(self) -> str:
        """The whole rule as one expression, whose last group is the tail."""
        return f"{self.prefix}({self.tail}+)"


#: The three base kinds, in the order in which they are listed.
BASE_KINDS = ("assign", "access", "hex")
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 8, True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 12),
    Rule("hex", r"", r"[0-9a-f]", 32),
)
#: Further kinds of secret, by the formats that their issuers publish.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?----", r"-"),
    Rule("age_key", r"AGE-SECRET-KEY-1", r"[A-Z0-9]", 58),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", r"[A-Za-z0-9_.-]", 20),
    Rule("bearer", r"Bearer\x20+", r"[A-Za-z0-9._~+/=-]", 20, True),
    Rule("url_login", r"://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%!$&*+=-]+@", r"[A-Za-z0-9.-]"),
    Rule("aws_session", r"(ASIA|AROA|AIDA)", r"[A-Z0-9]", 16),
    Rule("azure_account", r"AccountKey=", r"[A-Za-z0-9+/=]", 40),
    Rule("google_key", r"AIza", r"[A-Za-z0-9_-]", 35),
    Rule("google_token", r"ya29\.", r"[A-Za-z0-9_-]", 20),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    Rule("github_pat", r"github_pat_", r"[A-Za-z0-9_]", 22),
    Rule("gitlab", r"glpat-", r"[A-Za-z0-9_-]", 20),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 10),
    Rule("slack_hook", r"hooks\.slack\.com/services/", r"[A-Za-z0-9/]", 20),
    Rule("stripe", r"[rs]k_(live|test)_", r"[A-Za-z0-9]", 16),
    Rule("square", r"sq0(atp|csp)-", r"[A-Za-z0-9_-]", 22),
    Rule("shopify", r"shp(at|ca|pa|ss)_", r"[A-Fa-f0-9]", 32),
    Rule("model_key", r"sk-", r"[A-Za-z0-9_-]", 20),
    Rule("hugging_face", r"hf_", r"[A-Za-z0-9]", 30),
    Rule("npm", r"npm_", r"[A-Za-z0-9]", 36),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc", r"[A-Za-z0-9_-]", 50),
    Rule("sendgrid", r"SG\.", r"[A-Za-z0-9_.-]", 60),
    Rule("mailgun", r"key-", r"[0-9a-z]", 32),
    Rule("telegram", r"[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9]:AA", r"[A-Za-z0-9_-]", 33),
    Rule("digitalocean", r"do[oprt]_v1_", r"[0-9a-f]", 64),
    Rule("databricks", r"dapi", r"[0-9a-f]", 32),
    Rule("newrelic", r"NRAK-", r"[A-Z0-9]", 27),
    Rule("postman", r"PMAK-", r"[0-9a-f-]", 34),
)
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Expressions of literals, escapes, classes, groups, alternation and ? * + {n} {n,} {n,m}, over ASCII."""

    def __init__(self, text: str, any_case: bool):
        self.text, self.at, self.any_case = text, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.either()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return tree

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                low, comma, high = self.text[self.at : (end := self.text.index("}", self.at))].partition(",")
                self.at = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def code(self) -> int:
        if (c := self.take()) != "\\":
            return ord(c)
        if (c := self.take()) == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} is not supported")
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.either()
            if self.take() != ")":
                raise ValueError("unbalanced group")
            return node
        codes: set[int] = set()
        if self.peek() == "[":
            self.take()
            while self.peek() != "]":
                low = high = self.code()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.code()
                codes.update(range(low, high + 1))
            self.take()
        else:
            codes.add(self.code())
        if self.any_case:
            codes |= {ord(chr(c).swapcase()) for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return ("set", frozenset(codes))


@dataclass
class Automaton:
    """classes: byte to class, the class after the last parts rows; step[state * n_classes + class]; accepts: rules as bits.
    State 0 is the start."""

    classes: np.ndarray
    n_classes: int
    step: np.ndarray
    accepts: np.ndarray

    @cached_property
    def plain(self) -> list[int]:
        """The transitions for steps one by one."""
        return self.step.tolist()


def parsed(text: str, any_case: bool = False):
    return _Parser(text, any_case).parse()


def reversed_tree(tree):
    """The tree of the same texts read backwards."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return (kind, reversed_tree(tree[1]), *tree[2:])
    parts = [reversed_tree(part) for part in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Thompson:
    """States with empty moves and moves by sets of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree from `start` on and returns its end."""
        kind = tree[0]
        if kind == "set":
            self.moves[start].append((tree[1], end := self.state()))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[start].append(first := self.state())
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            self.empty[start].append(loop := self.state())
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end := self.state())
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closures(self) -> list[int]:
        out = []
        for s in range(len(self.empty)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            out.append(sum(1 << t for t in seen))
        return out


def automaton(trees: list, anywhere: bool) -> Automaton:
    """The minimal deterministic automaton of all trees. anywhere: a match may begin at each byte, else only at the first."""
    nfa = _Thompson()
    root = nfa.state()
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    finals: dict[int, int] = {}
    for k, tree in enumerate(trees):
        nfa.empty[root].append(first := nfa.state())
        finals[nfa.add(tree, first)] = 1 << k

    # Bytes that no move tells apart are one class.
    signature = [tuple(b in s for row in nfa.moves for s, _ in row) for b in range(256)]
    number = {s: k for k, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([number[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in number]

    closure = nfa.closures()
    reach = [[0] * len(sample) for _ in nfa.moves]
    for s, row in enumerate(nfa.moves):
        for codes, target in row:
            for c, byte in enumerate(sample):
                if byte in codes:
                    reach[s][c] |= closure[target]
    active = sum(1 << s for s, row in enumerate(nfa.moves) if row)
    lasting = active | sum(1 << s for s in finals)

    # Subset construction; a set of states is an integer's bits.
    found = {closure[root] & lasting: 0}
    todo, table = [closure[root] & lasting], []
    for now in todo:
        targets, rest = [0] * len(sample), now & active
        while rest:
            row = reach[(rest & -rest).bit_length() - 1]
            rest &= rest - 1
            for c, mask in enumerate(row):
                targets[c] |= mask
        targets = [t & lasting for t in targets]
        for t in targets:
            if t not in found:
                found[t] = len(found)
                todo.append(t)
        table.append([found[t] for t in targets])
    step = np.array(table, np.int64)
    accepts = np.array([sum(bit for s, bit in finals.items() if now >> s & 1) for now in todo], np.int64)

    # Partition refinement until no class of states splits.
    _, label = np.unique(accepts, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([label, label[step]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    # The start gets number 0.
    rank = np.argsort(np.argsort(np.where(np.arange(len(first)) == finer[0], -1, np.arange(len(first)))))
    small = np.zeros((len(first), len(sample) + 1), np.uint32)
    small[rank, :-1] = rank[finer[step[first]]]
    kept = np.zeros(len(first), np.int64)
    kept[rank] = accepts[first]
    return Automaton(classes, len(sample) + 1, small.reshape(-1), kept)


#: Bytes of a lane, and those before it that lead to the state in which it begins; lanes that are too few for array steps.
LANE, LEAD, FEW = 512, 48, 16


def states(a: Automaton, data: np.ndarray, offsets: np.ndarray, lane: int = LANE, carried: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The automaton's state after every byte, and each byte's row; before a row it starts anew. carried: the state in
    which the first row goes on, if it began before these bytes."""
    n, rows = len(data), len(offsets) - 1
    width = a.n_classes
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    lead = int(carried is None)
    at = np.arange(lead, n + lead) + row
    lanes = -(-(n + rows) // lane)
    padded = np.full(lanes * lane, width - 1, np.uint8)
    padded[at] = a.classes[data]
    columns = np.ascontiguousarray(padded.reshape(lanes, lane).T)
    out = np.empty((lane, lanes), np.uint32)
    begin = np.zeros(lanes, np.uint32)
    for t in range(max(0, lane - LEAD), lane):
        begin[1:] = a.step[begin[1:].astype(np.int64) * width + columns[t, :-1]]
    begin[0] = carried or 0
    which = np.arange(lanes)
    unseen = set(range(lanes))
    while len(which):
        if len(which) > FEW:
            now = begin[which].astype(np.int64)
            for t in range(lane):
                now = a.step[now * width + columns[t, which]].astype(np.int64)
                out[t, which] = now
        else:
            for w in which.tolist():  # as far as the states differ from those found before
                old, new, now = out[:, w].tolist(), [], int(begin[w])
                for before, c in zip(old, columns[:, w].tolist(), strict=True):
                    now = a.plain[now * width + c]
                    if now == before and w not in unseen:
                        break
                    new.append(now)
                out[: len(new), w] = new
        unseen.difference_update(which.tolist())
        due = np.empty(lanes, np.uint32)
        due[0] = begin[0]
        due[1:] = out[-1, :-1]
        which = np.flatnonzero(due != begin)
        begin = due
    return np.ascontiguousarray(out.T).reshape(-1)[at], row


class Scanner:
    """The rules' automata. Those of the reversed rules and the tails' classes are few states and 256 bits a rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [("cat", [parsed(r.prefix, r.any_case), parsed(r.tail, r.any_case)]) for r in rules]
        self.forward = automaton(trees, True)
        self.backward = [automaton([reversed_tree(t)], False) for t in trees]
        self.tails = [np.isin(np.arange(256), list(parsed(r.tail, r.any_case)[1][0][1])) for r in rules]
        #: Rules without a prefix: their spans are the runs of their class.
        self.runs = [k for k, r in enumerate(rules) if not r.prefix]
        self.runs_mask = sum(1 << k for k in self.runs)

    @cached_property
    def _tables(self) -> list[tuple[list[list[int]], list[bool], int]]:
        """For walks byte by byte: transitions by byte, whether a state accepts, and the state without a way out."""
        out = []
        for a in self.backward:
            by_byte = a.step.reshape(-1, a.n_classes)[:, a.classes]
            stuck = np.flatnonzero((by_byte == np.arange(len(by_byte))[:, None]).all(axis=1) & (a.accepts == 0))
            out.append((by_byte.tolist(), (a.accepts > 0).tolist(), int(stuck[0]) if len(stuck) else -1))
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(row, its spans as (start, rule, end) in bytes of the row, by start, then rule) for rows that have some."""
        for i, j in steps(offsets):
            found = self._step(data, offsets[i : j + 1])
            for r in sorted(found):
                yield i + r, sorted(found[r])

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        lo, hi = int(offsets[0]), int(offsets[-1])
        accepted: list[tuple[np.ndarray, np.ndarray]] = []  # places and rules, as bits, of rules with a prefix
        pieces: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in self.runs}
        state = None
        single = len(offsets) == 2
        for at in range(lo, hi, 2 * STEP_BYTES) if single else [lo]:
            end = min(hi, at + 2 * STEP_BYTES) if single else hi
            own = np.array([0, end - at]) if single else offsets - lo
            after, _ = states(self.forward, data[at:end], own, carried=state)
            state = int(after[-1]) if len(after) else state
            hits = self.forward.accepts[after]
            where = np.flatnonzero(hits & ~self.runs_mask)
            if len(where):
                accepted.append((where + at, hits[where]))
            for k in self.runs:
                inside = hits >> k & 1 > 0
                border = np.zeros(len(inside) + 1, bool)
                border[own] = True
                begin = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
                last = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]])))
                # A run that touches the stretch's ends may go on there.
                long = (last - begin + 1 >= self.rules[k].least) | ((begin == 0) | (last == len(inside) - 1) if single else False)
                pieces[k].append((begin[long] + at, last[long] + 1 + at))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, parts in pieces.items():
            begin, end = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts, strict=True))
            if single and len(begin):
                new = np.append(True, begin[1:] != end[:-1])
                begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
            rows = np.searchsorted(offsets, begin, "right") - 1
            for r, s, e in zip(rows.tolist(), begin.tolist(), end.tolist(), strict=True):
                if e - s >= self.rules[k].least:
                    found.setdefault(r, []).append((s - int(offsets[r]), k, e - int(offsets[r])))
        if accepted:
            places, bits = (np.concatenate(x) for x in zip(*accepted, strict=True))
            for k, rule in enumerate(self.rules):
                if rule.prefix and len(own := places[bits >> k & 1 > 0]):
                    self._take(k, data, offsets, own, found)
        return found

    def _take(self, k: int, data: np.ndarray, offsets: np.ndarray, entry: np.ndarray, found: dict) -> None:
        """The rule's spans from the places where its tails begin: leftmost first, none over another, long tails kept."""
        rows = np.searchsorted(offsets, entry, "right") - 1
        start = self._starts(k, data, entry, offsets[rows])
        end = self._ends(k, data, entry, offsets)
        least = self.rules[k].least
        by = np.lexsort((entry, start, rows))
        row, taken = -1, 0
        for r, s, u, e in zip(rows[by].tolist(), start[by].tolist(), entry[by].tolist(), end[by].tolist(), strict=True):
            if r != row:
                row, taken = r, 0
            if s < taken:
                # Another start of the same tail may lie behind the span that was taken.
                if u <= taken or (s := self._walk(k, data, u, taken)) < 0:
                    continue
            taken = e
            if e - u >= least:
                found.setdefault(r, []).append((s - int(offsets[r]), k, e - int(offsets[r])))

    def _starts(self, k: int, data: np.ndarray, entry: np.ndarray, floor: np.ndarray, most: int = 64) -> np.ndarray:
        """The leftmost place, `floor` or later, from which the rule reads up to each entry: all entries step back
        together; those that go further than `most` bytes go on alone."""
        a = self.backward[k]
        out = entry.copy()
        state, which = np.zeros(len(entry), np.int64), np.arange(len(entry))
        stuck = self._tables[k][2]
        for n in range(most):
            at = entry[which] - n
            inside = at >= floor[which]
            which, state, at = which[inside], state[inside], at[inside]
            if not len(which):
                return out
            state = a.step[state * a.n_classes + a.classes[data[at]]].astype(np.int64)
            good = a.accepts[state] > 0
            out[which[good]] = at[good]
            open_ = state != stuck
            which, state = which[open_], state[open_]
        for w in which.tolist():
            out[w] = self._walk(k, data, int(entry[w]), int(floor[w]))
        return out

    def _walk(self, k: int, data: np.ndarray, entry: int, floor: int) -> int:
        """The same for one entry, byte by byte; -1 if there is no start."""
        step, good, stuck = self._tables[k]
        out, state, high = -1, 0, entry + 1
        while high > floor and state != stuck:
            low = max(floor, high - 4096)
            part = data[low:high].tobytes()
            for n in range(high - low - 1, -1, -1):
                state = step[state][part[n]]
                if good[state]:
                    out = low + n
                elif state == stuck:
                    break
            high = low
        return out

    def _ends(self, k: int, data: np.ndarray, entry: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the class of the tail that begins at each entry ends: stretches of bytes from the last to the first."""
        out = np.empty(len(entry), np.int64)
        follow = int(offsets[-1])
        high = len(entry)
        for lo in range(int(offsets[-1]) - 1 - (int(offsets[-1]) - 1 - int(offsets[0])) % STEP_BYTES, int(offsets[0]) - 1, -STEP_BYTES):
            hi = min(int(offsets[-1]), lo + STEP_BYTES)
            low = int(np.searchsorted(entry, lo))
            other = np.flatnonzero(~self.tails[k][data[lo:hi]]) + lo
            if low < high:
                out[low:high] = np.append(other, follow)[np.searchsorted(other, entry[low:high])]
            follow = int(other[0]) if len(other) else follow
            high = low
        return np.minimum(out, offsets[np.searchsorted(offsets, entry, "right")])


def code_points(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in characters from spans in bytes."""
    before = np.concatenate([[0], np.cumsum(text & 0xC0 != 0x80)]) if (text > 127).any() else None
    return spans if before is None else [(int(before[s]), k, int(before[e])) for s, k, e in spans]


SCHEMA = "spans array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id and all spans by start, then rule; offsets are code points, the end exclusive."""
    session_ready(docs.sparkSession)
    scanner = Scanner(rules)
    id_type = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for r, own in scanner.spans(data, offsets):
                spans[r] = [{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in code_points(data[offsets[r] : offsets[r + 1]], own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_type.simpleString()}, {SCHEMA}")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest of the spans of each document: counts of the base kinds, the base spans' hash, all spans."""
    found = scan_secrets(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, over the table `documents`: each rule's expression by its engine. A match begins after the parts
    of the text between the matches before it, and these matches."""

    def any_case(expression: str) -> str:
        # The engine's own way to leave out the case takes in letters beyond ASCII.
        return re.sub(r"(\\x..|\[[^]]*\])|([A-Za-z])", lambda m: m[1] or f"[{m[2].lower()}{m[2].upper()}]", expression)

    def found(k: int, rule: Rule) -> str:
        pattern = f"{any_case(rule.prefix) if rule.any_case else rule.prefix}({rule.tail}+)".replace("'", "\\x27")
        group = rule.pattern.replace("\\(", "").count("(")
        return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, e - length(m) AS s, e
        FROM (SELECT r, m, tail, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e
              FROM (SELECT r, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS tail,
                           unnest(regexp_split_to_array(t, '{pattern}')) AS p, unnest(range(0, len(regexp_extract_all(t, '{pattern}', 0)))) AS i
                    FROM d WHERE regexp_matches(t, '{pattern}')) WHERE m IS NOT NULL) WHERE length(tail) >= {rule.least}"""

    every = "\n        UNION ALL ".join(found(k, rule) for k, rule in enumerate(rules))
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE_KINDS)
    shown = ", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in BASE_KINDS)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({every}),
        g AS (SELECT r, {counts}, {joined} FILTER (k < {len(BASE_KINDS)}) AS base, {joined} AS spans FROM f GROUP BY r)
        SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
