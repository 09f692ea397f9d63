"""Sentences, grouping with word or character overlap, keyword cuts and soft wrap."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import pairwise

from ..text import overlap_units

#: Fixed value: what ends a sentence, with closing quotes and brackets and the white space after it.
SENTENCE_END = r'(?:\.\.\.|…|[.!?])(?:["”’\'\)\]\}»]*)\s*'
_TAIL = r'(?:["”’\'\)\]\}»]*)\s*'


def sentence_pattern(separators: str | list[str]) -> str:
    """A regular expression as it is; a list of literals as an alternation, the ellipsis first."""
    if isinstance(separators, str):
        return separators
    ordered = sorted(separators, key=lambda s: s != "...")
    return "(?:" + "|".join(map(re.escape, ordered)) + ")" + _TAIL


def sentences(text: str | None, separators: str | list[str] = SENTENCE_END) -> list[str]:
    """Sentences with what ends them; white space before the end goes. A blank text is one empty sentence."""
    if not text or not text.strip():
        return [""]
    out, at = [], 0
    for m in re.finditer(sentence_pattern(separators), text):
        out.append((text[at : m.start()].strip() + m.group()).strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def groups(items: list[str], size: int, joint: str) -> list[str]:
    return [joint.join(items[i : i + size]) for i in range(0, len(items), size)]


def with_word_overlap(items: list[str], size: int, overlap: float | int, joint: str, before: str) -> list[str]:
    """Groups of items, each after the first preceded by the last words of the chunk given out before it."""
    k = overlap_units(overlap, max((len(x.split()) for x in items), default=0))
    out: list[str] = []
    for chunk in groups(items, size, joint):
        tail = " ".join(out[-1].split()[-k:]) if out and k > 0 else ""
        out.append(tail + before + chunk if tail else chunk)
    return out


def with_character_overlap(items: list[str], size: int, overlap: int, joint: str = "\n") -> list[str]:
    out: list[str] = []
    for chunk in groups(items, size, joint):
        out.append(out[-1][-overlap:] + chunk if out and overlap > 0 else chunk)
    return out


@dataclass
class KeywordCut:
    chunks: list[str]
    counts: dict[str, int]
    spans: dict[str, list[tuple[int, int]]]


def named_pattern(patterns: list[str] | dict[str, str]) -> tuple[str, list[str]]:
    """One alternation with a group for each pattern, and the patterns' names; without patterns it never matches."""
    named = patterns if isinstance(patterns, dict) else {f"k{i}": p for i, p in enumerate(patterns)}
    return "|".join(f"(?P<g{i}_>{p})" for i, p in enumerate(named.values())) or r"(?!)", list(named)


def keyword_cut(text: str | None, patterns: list[str] | dict[str, str], flags: int = 0, delimiters: str = "before", size: int = 100_000) -> KeywordCut:
    """Cuts at matches, leftmost first. A match goes to the end of the chunk before it, to the beginning of the next,
    to both, or is dropped; chunks are stripped, blank ones dropped, long ones wrapped."""
    text = text or ""
    pattern, names = named_pattern(patterns)
    found = [(m.start(), m.end(), names[int(m.lastgroup[1:-1])] if m.lastgroup else "") for m in _matches(pattern, text, flags)]
    spans: dict[str, list[tuple[int, int]]] = {}
    for a, b, name in found:
        spans.setdefault(name, []).append((a, b))
    edges = [(0, 0), *((a, b) for a, b, _ in found), (len(text), len(text))]
    raw = []
    for (a, b), (c, d) in pairwise(edges):
        head = text[a:b] if delimiters in ("after", "both") else ""
        tail = text[c:d] if delimiters in ("before", "both") else ""
        raw.append((head + text[b:c] + tail).strip())
    chunks = [w for chunk in raw if chunk for w in soft_wrap(chunk, size)]
    return KeywordCut(chunks or [""], {n: len(s) for n, s in spans.items()}, spans)


def _matches(pattern: str, text: str, flags: int):
    for m in re.finditer(pattern, text, flags):
        yield _Outer(m)


class _Outer:
    """A match whose lastgroup is the alternative that matched, also where that has groups of its own."""

    def __init__(self, m: re.Match):
        self.start, self.end = m.start, m.end
        self.lastgroup = next((k for k, v in m.groupdict().items() if v is not None and re.fullmatch(r"g\d+_", k)), None)


def soft_wrap(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters, stripped, blank ones dropped: a piece reaches to the last end of a word or of
    white space within `size`, or, where there is none, just so far. A size of 0 or less does not wrap."""
    if size <= 0 or len(text) <= size:
        return [text]
    edges = [m.start() for m in re.finditer(r"(?<=\S)(?=\s)|(?<=\s)(?=\S)", text)] + [len(text)]
    cuts = [0]
    while (at := cuts[-1]) < len(text):
        nearest = edges[bisect_right(edges, at + size) - 1]
        cuts.append(nearest if at < nearest <= at + size else at + size)
    return list(filter(None, (text[i:j].strip() for i, j in pairwise(cuts))))


def pages(text: str, placeholder: str) -> list[str]:
    if not placeholder or placeholder not in text:
        raise ValueError("The text has no page placeholder")
    return [p for p in (x.strip() for x in text.split(placeholder)) if p]
