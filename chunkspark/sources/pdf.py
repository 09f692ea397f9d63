"""The relational core of PDF reading: words to lines, tables, lines outside tables, pages."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.native.structured import markdown_table


def lines_from_words(words: DataFrame, tolerance: float = 1.0, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """words: keys, text, top, bottom, x0. One row a line: words whose tops round to the same multiple of the tolerance
    (half to even), from left to right."""
    row = F.bround(F.col("top") / tolerance).cast("long")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*keys, row.alias("line")).agg(text.alias("content"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("line")


def lines_outside_tables(lines: DataFrame, tables: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Lines whose vertical midpoint lies in no table of their page: an anti join by page and range."""
    t = tables.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("top").alias("__top"), F.col("bottom").alias("__bottom"))
    middle = (F.col("top") + F.col("bottom")) / 2
    on = (F.col("__top") <= middle) & (middle <= F.col("__bottom"))
    for k in keys:
        on &= F.col(k) == F.col(f"__{k}")
    return lines.join(t, on, "left_anti")


def assemble_pages(blocks: DataFrame, placeholder: str = "<!-- page -->", keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """blocks: keys, page, top, content. One row a document: pages in order, blocks by top, each page after its placeholder."""
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "content"))), lambda b: b["content"]), "\n")
    pages = blocks.groupBy(*keys, "page").agg(page.alias("content"))
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("page", "content"))), lambda p: F.concat(F.lit(placeholder + "\n\n"), p["content"])), "\n\n",
    )
    return pages.groupBy(*keys).agg(F.regexp_replace(text, "\n{3,}", "\n\n").alias("text"))


def filled_rows(cells: list[list[Any]]) -> list[list[Any]]:
    return [row for row in cells if any(c not in (None, "", " ") for c in row)]


def table_is_real(cells: list[list[Any]]) -> bool:
    """Without its blank rows two rows or more, at most 70 % of them of one cell, and some row of two; empty cells count."""
    widths = [len(row) for row in filled_rows(cells)]
    return len(widths) >= 2 and widths.count(1) <= 0.7 * len(widths) and max(widths) >= 2


def table_markdown(cells: list[list[Any]]) -> str:
    """Rows padded to one width, line feeds in cells as spaces."""
    cells = filled_rows(cells)
    width = max(map(len, cells))
    rows = [[str(c or "").replace("\n", " ").strip() for c in row] + [""] * (width - len(row)) for row in cells]
    return markdown_table(rows[0], rows[1:])


def page_blocks(words: list[dict], tables: list[dict], tolerance: float = 1.0) -> list[dict]:
    """The same steps for one page in a worker: blocks with type, top, bottom and content, by top."""
    real = [t for t in tables if table_is_real(t["cells"])]
    lines: dict[int, list[dict]] = {}
    for w in words:
        lines.setdefault(round(w["top"] / tolerance), []).append(w)
    out = [{"type": "table", "top": t["top"], "bottom": t["bottom"], "content": table_markdown(t["cells"])} for t in real]
    for own in lines.values():
        top, bottom = min(w["top"] for w in own), max(w["bottom"] for w in own)
        if not any(t["top"] <= (top + bottom) / 2 <= t["bottom"] for t in real):
            out.append({"type": "text", "top": top, "bottom": bottom, "content": " ".join(w["text"] for w in sorted(own, key=lambda w: w["x0"]))})
    return sorted(out, key=lambda b: b["top"])


def page_text(blocks: list[dict], placeholder: str, number: int) -> str:
    body = "\n".join(f"\n{b['content']}\n" if b["type"] == "table" else b["content"] for b in blocks)
    return re.sub(r"\n{3,}", "\n\n", f"{placeholder.replace('{page}', str(number))}\n\n{body}").strip()
