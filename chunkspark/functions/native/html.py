"""HTML: a tree over the standard tokenizer, tag chunks, and Markdown."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROW_TAGS = {"tr", "thead", "tbody", "th", "td"}


@dataclass(eq=False)
class Node:
    name: str
    attributes: list[tuple[str, str | None]] = field(default_factory=list)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.elements() if n.name in names]

    def get(self, name: str, default: str = "") -> str:
        return next((v or "" for k, v in self.attributes if k == name), default)

    def above(self, name: str) -> Node | None:
        node = self.parent
        while node and node.name != name:
            node = node.parent
        return node

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if not isinstance(c, Node) or not c.name.startswith("!"))

    def html(self) -> str:
        inner = "".join(entities.escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children)
        if self.name == "!":
            return "<!--" + "".join(c for c in self.children if isinstance(c, str)) + "-->"
        if self.name.startswith("!"):
            return f"<{self.name}>"
        names = "".join(f' {k}="{entities.escape(v or "")}"' for k, v in self.attributes)
        return f"<{self.name}{names}/>" if self.name in VOID else f"<{self.name}{names}>{inner}</{self.name}>"


class _Builder(HTMLParser):
    """Elements nest as they are opened; an end tag closes up to the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _add(self, node: Node | str) -> None:
        if isinstance(node, Node):
            node.parent = self.open[-1]
        self.open[-1].children.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._add(node := Node(tag, attrs))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(Node(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self._add(data)

    def handle_comment(self, data: str) -> None:
        self._add(Node("!", children=[data]))

    def handle_decl(self, decl: str) -> None:
        self._add(Node("!" + decl))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# ---- Markdown ----


class Markdown:
    """HTML to Markdown. `leaks`: the text of comments, scripts, styles and the document type comes out too."""

    def __init__(self, leaks: bool = False):
        self.leaks = leaks
        spans = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~"}
        blocks = ("div", "body", "html", "section", "article")
        self.rules: dict[str, Callable[[Node, int], str]] = {f"h{k}": self._heading for k in range(1, 7)}
        self.rules |= {name: self._span(mark) for name, mark in spans.items()}
        self.rules |= {name: lambda n, depth: self.block(n) for name in blocks}
        self.rules |= {
            "p": self._paragraph,
            "blockquote": self._quote,
            "ul": self._list,
            "ol": self._list,
            "li": lambda n, d: self.inline(n).strip(),
            "hr": lambda n, d: "---\n",
            "pre": self._code_block,
            "table": self._table,
        }
        self.rules |= {
            "code": lambda n, d: f"`{self.inline(n)}`",
            "a": lambda n, d: f"[{self.inline(n)}]({n.get('href')})",
            "img": lambda n, d: f"![{n.get('alt')}]({n.get('src')})",
        }

    def convert(self, html: str) -> str:
        return re.sub(r"\n{3,}", "\n\n", self.block(parse(html))).strip()

    def _parts(self, node: Node, depth: int, inline: bool) -> Iterator[str]:
        for child in node.children:
            if isinstance(child, str):
                yield child if inline else child.strip()
            elif child.name == "!" or child.name in ("script", "style"):
                yield child.text() if self.leaks and child.name != "!" else "".join(x for x in child.children if isinstance(x, str)) if self.leaks else ""
            elif child.name.startswith("!"):
                yield child.name[1:].removeprefix("DOCTYPE ").removeprefix("doctype ") if self.leaks else ""
            elif child.name in self.rules:
                yield self.rules[child.name](child, depth)
            else:
                yield "".join(self._parts(child, depth, True)) if inline else self.block(child)

    def inline(self, node: Node, depth: int = 0) -> str:
        return "".join(self._parts(node, depth, True))

    def block(self, node: Node) -> str:
        return "\n".join(p for p in self._parts(node, 0, False) if p.strip())

    def _heading(self, node: Node, depth: int) -> str:
        return f"{'#' * int(node.name[1])} {self.inline(node).strip()}\n"

    def _paragraph(self, node: Node, depth: int) -> str:
        text = self.inline(node).strip()
        return f"{text}\n" if text else ""

    def _quote(self, node: Node, depth: int) -> str:
        return "\n".join(f"> {line}" for line in self.inline(node).strip().splitlines()) + "\n"

    def _list(self, node: Node, depth: int) -> str:
        """Items a line each; a nested list goes on lines of its own, two spaces in."""
        out, number = [], 0
        for item in node.children:
            if not isinstance(item, Node) or item.name != "li":
                continue
            number += 1
            nested = [c for c in item.children if isinstance(c, Node) and c.name in ("ul", "ol")]
            flat = Node("li", children=[c for c in item.children if not any(c is n for n in nested)])
            out.append("  " * depth + ("- " if node.name == "ul" else f"{number}. ") + self.inline(flat).strip())
            out += [self._list(n, depth + 1) for n in nested]
        return "\n".join(out)

    def _span(self, mark: str) -> Callable[[Node, int], str]:
        return lambda node, depth: f"{mark}{self.inline(node)}{mark}"

    def _code_block(self, node: Node, depth: int) -> str:
        code = (node.find("code") or [node])[0]
        language = next((m[1] for m in [re.search(r"\b(?:language|lang)-(\w+)", code.get("class"))] if m), "")
        return f"```{language}\n{code.text().rstrip(chr(10))}\n```\n"

    def _table(self, node: Node, depth: int) -> str:
        rows = [[self.inline(c).strip() for c in tr.find("td", "th")] for tr in node.find("tr")]
        if not rows:
            return ""
        line = lambda cells: "| " + " | ".join(cells) + " |"
        return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) + "\n"


def looks_like_html(text: str, name: str | None = None) -> bool:
    """By the file name's extension, else by an html, heading or div element."""
    lower = (name or "").lower()
    if lower.endswith((".html", ".htm")):
        return True
    if lower.endswith((".md", ".markdown")):
        return False
    return bool(parse(text).find("html", "div", *(f"h{k}" for k in range(1, 7)))) if "<" in (text or "") else False


# ---- Tag chunks ----


def auto_tag(root: Node) -> str:
    """The most frequent element in the body; of equals the shallowest, then the first."""
    bodies = root.find("body")
    if not bodies:
        return "div"
    seen: dict[str, list[int]] = {}
    todo: list[tuple[Node, int]] = [(c, 0) for c in reversed(bodies[0].children) if isinstance(c, Node)]
    while todo:
        node, depth = todo.pop()
        if not node.name.startswith("!"):
            entry = seen.setdefault(node.name, [0, depth])
            entry[0] += 1
            entry[1] = min(entry[1], depth)
        todo += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, Node)]
    return max(seen, key=lambda t: (seen[t][0], -seen[t][1])) if seen else "div"


def _page(inner: str) -> str:
    return f"<html><body>{inner}</body></html>"


def _head_and_rows(table: Node) -> tuple[str, list[Node]]:
    """The head, given or made of the first row, and the rows outside it."""
    heads, rows = table.find("thead"), table.find("tr")
    if heads:
        return heads[0].html(), [r for r in rows if not r.above("thead")]
    return (f"<thead>{rows[0].html()}</thead>", rows[1:]) if rows else ("", [])


def _table_page(table: Node, head: str, rows: str) -> str:
    names = "".join(f' {k}="{entities.escape(v or "")}"' for k, v in table.attributes)
    return _page(f"<table{names}>{head}<tbody>{rows}</tbody></table>")


def _packed(parts: list[str], frame: Callable[[str], str], size: int) -> list[str]:
    """Greedy groups whose framed length is at most `size`; a part that is longer alone stays alone."""
    out, held, used, fixed = [], [], 0, len(frame(""))
    for part in parts:
        if held and fixed + used + len(part) > size:
            out.append(frame("".join(held)))
            held, used = [], 0
        held.append(part)
        used += len(part)
    return [*out, frame("".join(held))] if held else out


def split_by_tag(html: str | None, tag: str | None = None, size: int | None = 1, batch: bool = True, to_markdown: bool = True) -> tuple[list[str], str]:
    """Chunks and the tag they were cut by. A size of 0, 1 or None means no limit."""
    root = parse(html or "")
    tag = (tag or auto_tag(root)).lower()
    found = root.find(tag)
    if batch and tag in ROW_TAGS:
        tables = {id(t): t for t in (n.above("table") for n in found) if t}
        found, tag = list(tables.values()), "table"
    whole = size in (0, 1, None)
    if not found:
        chunks = [""]
    elif batch and whole:
        chunks = [_page("".join(n.html() for n in found))]
    elif batch and tag == "table":
        chunks = []
        for table in found:
            head, rows = _head_and_rows(table)
            chunks += _packed([r.html() for r in rows], lambda x, t=table, h=head: _table_page(t, h, x), size) if rows else [_page(table.html())]
    elif batch:
        chunks = _packed([n.html() for n in found], _page, size)
    elif tag in ROW_TAGS:
        chunks = []
        for node in found:
            table = node.above("table")
            if tag in ("thead", "th") or node.above("thead"):
                continue
            if not table:
                chunks.append(_page(node.html()))
                continue
            head, rows = _head_and_rows(table)
            row = node if tag == "tr" else node.above("tr") or node
            if tag == "tr" and not any(r is node for r in rows):
                continue
            chunks.append(
                _table_page(
                    table,
                    head,
                    "".join(r.html() for r in node.find("tr")) if tag == "tbody" else row.html() if tag == "tr" else f"<tr>{node.html()}</tr>",
                )
            )
        chunks = chunks or [""]
    else:
        chunks = [_page(n.html()) for n in found]
    return [Markdown().convert(c) if c else "" for c in chunks] if to_markdown else chunks, tag
