"""Markdown headers, size-bounded JSON, tables and their Markdown."""

from __future__ import annotations

import csv
import io
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

SETEXT = [(re.compile(r"^([^\n]+)\n=+\s*$", re.M), "#"), (re.compile(r"^([^\n]+)\n-+\s*$", re.M), "##")]


def atx_headings(markdown: str) -> str:
    """Underlined headings as # and ##."""
    for pattern, mark in SETEXT:
        markdown = pattern.sub(rf"{mark} \1", markdown)
    return markdown


def header_level(name: str) -> int:
    if not (m := re.match(r"header\s*(\d+)", name.lower())):
        raise ValueError(f"Invalid header: {name}")
    return int(m[1])


def _blocks(markdown: str, levels: set[int], keep: bool) -> Iterator[tuple[tuple[tuple[int, str], ...], str]]:
    """(path of headings, content) of the stretches between headings and blank lines; fences are not looked into."""
    path: list[tuple[int, str]] = []
    open_path: tuple[tuple[int, str], ...] = ()
    held: list[str] = []
    fence = ""
    for raw in markdown.split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            fence = "" if line.startswith(fence) else fence
            inside = bool(fence)
        else:
            fence = "```" if line.startswith("```") and line.count("```") == 1 else "~~~" if line.startswith("~~~") else ""
            inside = bool(fence)
        if inside:
            held.append(line)
            continue
        mark = re.match(r"(#+)(?: |$)", line)
        if mark and len(mark[1]) in levels:
            if held:
                yield open_path, "\n".join(held)
            while path and path[-1][0] >= len(mark[1]):
                path.pop()
            path.append((len(mark[1]), line[len(mark[1]) :].strip()))
            held = [line] if keep else []
        elif line:
            held.append(line)
        elif held:
            yield open_path, "\n".join(held)
            held = []
        open_path = tuple(path)
    if held:
        yield open_path, "\n".join(held)


def split_by_headers(markdown: str, levels: set[int], keep: bool = True) -> list[str]:
    """Sections under the headings of the given levels; a heading without text of its own joins the deeper one below."""
    out: list[tuple[tuple, str]] = []
    for path, content in _blocks(markdown, levels, keep):
        if out and out[-1][0] == path:
            out[-1] = (path, out[-1][1] + "  \n" + content)
        elif keep and out and len(out[-1][0]) < len(path) and out[-1][1].rpartition("\n")[2].startswith("#"):
            out[-1] = (path, out[-1][1] + "  \n" + content)
        else:
            out.append((path, content))
    return [content for _, content in out]


def _indexed(value: Any) -> Any:
    """Lists as dicts by position."""
    if isinstance(value, list):
        return {str(i): _indexed(v) for i, v in enumerate(value)}
    return {k: _indexed(v) for k, v in value.items()} if isinstance(value, dict) else value


def split_json(data: Any, most: int, least: int) -> list[str]:
    """Objects of about `most` characters with the paths of their leaves; one below `least` is not closed. A single
    leaf is never cut, so a chunk can be longer."""
    out: list[dict] = [{}]

    def put(path: list[str], value: Any) -> None:
        at = out[-1]
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = value

    todo: list[tuple[list[str], Any]] = [([], _indexed(data))]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and (path or value):
            # An entry that fits goes in whole; else the chunk may close, and the entry's own entries are next.
            if path:
                used = len(json.dumps(out[-1]))
                if len(json.dumps({path[-1]: value})) < most - used:
                    put(path, value)
                    continue
                if used >= least:
                    out.append({})
            todo += [([*path, k], v) for k, v in reversed(value.items())]
        elif path:
            used = len(json.dumps(out[-1]))
            if len(json.dumps({path[-1]: value})) >= most - used and used >= least:
                out.append({})
            put(path, value)
    if not out[-1]:
        out.pop()
    return [json.dumps(x) for x in out]


Table = tuple[list[str], list[list[Any]]]


def _typed(cells: list[str | None]) -> list[Any]:
    """Integers if all cells are, floats if all that are not blank are numbers (blank is nan), else strings."""
    have = [c for c in cells if c not in (None, "")]
    for kind in (int, float):
        if kind is int and len(have) < len(cells):
            continue
        try:
            return [kind(c) if c not in (None, "") else math.nan for c in cells] if have or kind is float else cells
        except ValueError:
            continue
    return [math.nan if c in (None, "") else c for c in cells]


def parse_delimited(text: str, delimiter: str = ",") -> Table:
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    if not rows:
        return [], []
    header, body = rows[0], rows[1:]
    if any(len(r) > len(header) for r in body):
        raise ValueError("a row has more fields than the header")
    columns = [_typed([r[k] if k < len(r) else None for r in body]) for k in range(len(header))]
    return header, [list(r) for r in zip(*columns, strict=True)]


def parse_pipes(text: str) -> Table:
    """A Markdown pipe table up to the first blank line after it begins; lines without pipes are skipped."""
    rows, begun = [], False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("|") and line.endswith("|") and len(line) > 1:
            begun = True
            cells = [c.strip() for c in line[1:-1].split("|")]
            if not all(re.fullmatch(r"-+", c) for c in cells):
                rows.append(cells)
        elif begun and not line:
            break
    if not rows:
        return [], []
    width = len(rows[0])
    columns = [_typed([r[k] if k < len(r) else None for r in rows[1:]]) for k in range(width)]
    return rows[0], [list(r) for r in zip(*columns, strict=True)]


def parse_records(text: str) -> Table:
    """A JSON list of objects or object of lists; else CSV."""
    try:
        data = json.loads(text)
    except ValueError:
        return parse_delimited(text)
    if isinstance(data, dict):
        header = list(data)
        return header, [list(r) for r in zip(*data.values(), strict=True)]
    header = list(dict.fromkeys(k for row in data for k in row))
    return header, [[row.get(k, math.nan) for k in header] for row in data]


def parse_table(text: str | None, method: str | None) -> Table:
    if not text or not text.strip():
        return [], []
    kind = (method or "").lower()
    if kind in ("markdown", "md") and "|" in text:
        return parse_pipes(text)
    return parse_delimited(text, "\t") if kind == "tsv" else parse_delimited(text) if kind in ("csv", "txt") else parse_records(text)


def _is_number(value: Any) -> bool:
    if isinstance(value, bool) or value is None:
        return False
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return True


def _cell(value: Any, is_float: bool) -> str:
    if value is None:
        return ""
    return format(float(value), "g") if is_float else str(value)


def markdown_table(header: list[str], rows: list[list[Any]]) -> str:
    """A pipe table: numbers right with their points in line, text left, each column two wider than its name at least."""
    columns = []
    for k, name in enumerate(header):
        cells = [r[k] for r in rows]
        numeric = bool(cells) and all(_is_number(c) for c in cells)
        is_float = numeric and not all(re.fullmatch(r"[+-]?\d+", str(c)) for c in cells)
        text = [_cell(c, is_float) for c in cells]
        if numeric:
            after = [len(t) - t.rfind(".") - 1 if "." in t else -1 for t in text]
            text = [t + " " * (max(after) - a) for t, a in zip(text, after, strict=True)]
        width = max([len(str(name)) + 2, *map(len, text)])
        side = str.rjust if numeric else str.ljust
        rule = "-" * (width + 2) if not rows else "-" * (width + 1) + ":" if numeric else ":" + "-" * (width + 1)
        columns.append([side(str(name), width), rule, *(side(t, width) for t in text)])
    if not columns:
        return ""
    lines = list(zip(*columns, strict=True))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(lines[0]), "|" + "|".join(lines[1]) + "|", *map(line, lines[2:])])


def split_table_rows(table: Table, size: int, overlap: int) -> list[tuple[str, list[int]]]:
    header, rows = table
    step = max(1, size - overlap)
    return [(markdown_table(header, rows[i : i + size]), list(range(i, min(i + size, len(rows))))) for i in range(0, len(rows), step)]


def split_table_columns(table: Table, size: int, overlap: int) -> list[tuple[str, list[str]]]:
    header, rows = table
    step = max(1, size - overlap)
    return [(repr([[name, *(r[k] for r in rows)] for k, name in list(enumerate(header))[i : i + size]]), header[i : i + size]) for i in range(0, len(header), step)]


def split_table_size(table: Table, size: int, overlap: float | int, oversize: str = "emit") -> list[str]:
    """Rows under the header, as many as fit. oversize: a row that fits nowhere is a chunk of its own ('emit'), or is
    lost and leaves a chunk of the header alone ('compat'). A first row that does not fit is an error."""
    header, rows = table
    if not header or not rows:
        return []
    head = markdown_table(header, [])
    lines = [markdown_table(header, [r]).split("\n")[2] for r in rows]
    if len(head) + 1 + len(lines[0]) > size:
        raise ValueError("chunk_size is too small for the header and the first row")
    # filled[j]: what the first j rows take; a chunk from row i reaches to the last j with filled[j] - filled[i] in the room.
    filled, room = list(accumulate((len(x) + 1 for x in lines), initial=0)), size - len(head)
    share = overlap if isinstance(overlap, float) else 0.0
    out: list[str] = []
    begin = end = 0
    while end < len(rows):
        end = bisect_right(filled, filled[begin] + room) - 1
        lone = lines[begin : begin + 1] if oversize == "emit" else []
        out.append(head + "\n" + "\n".join(lines[begin:end] or lone))
        count = end - begin
        again = int(count * share) if share else int(overlap)
        begin += max(1, count - again)
        end = max(end, begin)
    return out
