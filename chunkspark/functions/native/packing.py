"""Splitting by a list of separators and packing pieces up to a size, with overlap."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable

Length = Callable[[str], int]

#: Separators in order; the empty one matches everywhere, so those after it are never reached.
DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ".", ",", "", "​", "，", "、", "．", "。"]


def pack(pieces: Iterable[str], size: int, overlap: float, joint: str = "", length: Length = len) -> list[str]:
    """Greedy chunks of joined pieces. A chunk that is full is given out, stripped; then pieces leave its front until
    what is left fits the overlap and the next piece."""
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    total, gap = 0, length(joint)

    def give() -> None:
        chunk = joint.join(p for p, _ in held).strip()
        if chunk:
            out.append(chunk)

    for piece in pieces:
        own = length(piece)
        if held and total + own + gap > size:
            give()
            while held and (total > overlap or (total > 0 and total + own + gap > size)):
                total -= held.popleft()[1] + (gap if held else 0)
        total += own + (gap if held else 0)
        held.append((piece, own))
    give()
    return out


def pieces_before(text: str, pattern: str) -> list[str]:
    """The text cut before each match of the pattern; an empty pattern gives characters."""
    if not pattern:
        return list(text)
    starts = [0, *(m.start() for m in re.finditer(pattern, text) if m.end() > m.start()), len(text)]
    return [text[a:b] for a, b in zip(starts, starts[1:]) if a < b]


def split_by_separators(text: str, size: int, overlap: float, separators: list[str], is_regex: bool = False, length: Length = len) -> list[str]:
    """Cut before the first separator that the text has, pack what is short, and cut what is long by the rest."""
    patterns = separators if is_regex else [re.escape(s) for s in separators]
    at = next((k for k, p in enumerate(patterns) if not p or re.search(p, text)), len(patterns) - 1)
    rest = separators[at + 1 :] if patterns[at] and re.search(patterns[at], text) else []
    out: list[str] = []
    short: list[str] = []
    for piece in pieces_before(text, patterns[at]):
        if length(piece) < size:
            short.append(piece)
            continue
        out += pack(short, size, overlap, "", length)
        short = []
        out += split_by_separators(piece, size, overlap, rest, is_regex, length) if rest else [piece]
    return out + pack(short, size, overlap, "", length)


#: Words that open a block, by language; a chunk may begin before a line that starts with one.
BLOCK_WORDS = {
    "cpp": "class void int float double if for while switch case",
    "go": "func var const type if for switch case",
    "java": "class public protected private static if for while switch case",
    "kotlin": "class public protected private internal companion fun val var if for while when case else",
    "js": "function const let var class if for while switch case default",
    "ts": "enum interface namespace type class function const let var if for while switch case default",
    "php": "function class if foreach while do switch case",
    "proto": "message service enum option import syntax",
    "python": "class def",
    "ruby": "def class if unless while for do begin rescue",
    "rust": "fn const let if while for loop match",
    "scala": "class object def val var if for while match case",
    "swift": "func class struct enum if for while do switch case",
    "sol": "pragma using contract interface library constructor type function event modifier error struct enum if for while do assembly",
    "csharp": "interface enum implements delegate event class abstract public protected private static return if continue for foreach while switch case break else",
    "c": "class void int float double if for while switch case",
    "lua": "local function if for while repeat",
    "perl": "sub if foreach while unless until given",
    "haskell": "main let in do where case data newtype type class instance import module",
    "elixir": "def defp defmodule defprotocol defmacro defmacrop if unless while case cond with for do",
    "powershell": "function param if foreach for while switch class try catch finally",
}
#: Separators of markup, as regular expressions.
MARKUP = {
    "rst": ["\n=+\n", "\n-+\n", "\n\\*+\n", "\n\n\\.\\. *\n\n"],
    "markdown": ["\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n"],
    "latex": [
        r"\n\\chapter\{",
        r"\n\\section\{",
        r"\n\\subsection\{",
        r"\n\\subsubsection\{",
        r"\n\\begin\{enumerate\}",
        r"\n\\begin\{itemize\}",
        r"\n\\begin\{description\}",
        r"\n\\begin\{list\}",
        r"\n\\begin\{quote\}",
        r"\n\\begin\{quotation\}",
        r"\n\\begin\{verse\}",
        r"\n\\begin\{verbatim\}",
        r"\n\\begin\{align\}",
        r"\$\$",
        r"\$",
    ],
    "html": [f"<{t}" for t in "body div p br li h1 h2 h3 h4 h5 h6 span table tr td th ul ol header footer nav head style script meta title".split()],
    "cobol": [f"\n{w}" for w in ("IDENTIFICATION DIVISION.", "ENVIRONMENT DIVISION.", "DATA DIVISION.", "PROCEDURE DIVISION.", "WORKING-STORAGE SECTION.", "LINKAGE SECTION.", "FILE SECTION.", "INPUT-OUTPUT SECTION.", "OPEN ", "CLOSE ", "READ ", "WRITE ", "IF ", "ELSE ", "MOVE ", "PERFORM ", "UNTIL ", "VARYING ", "ACCEPT ", "DISPLAY ", "STOP RUN.")],
}
LANGUAGES = sorted([*BLOCK_WORDS, *MARKUP])


def code_separators(language: str) -> list[str]:
    name = language.lower()
    if name in MARKUP:
        own = MARKUP[name]
    elif name in BLOCK_WORDS:
        own = [f"\n{w} " for w in BLOCK_WORDS[name].split()]
        if name == "python":
            own.append("\n\tdef ")
    else:
        raise ValueError(f"Unsupported language {language!r}; one of {', '.join(LANGUAGES)}")
    return [*own, "\n\n", "\n", " ", ""]
