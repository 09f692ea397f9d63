"""Column-to-column text helpers. White space is Python's: Unicode, and U+001C to U+001F."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Python's str.isspace() as a Java character class.
SPACE = r"[\x09-\x0D\x1C-\x20\x85   -     　]"
NOT_SPACE = "[^" + SPACE[1:]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_SPACE)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def quoted(literal: str) -> str:
    """A literal as a Java regular expression."""
    return re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", literal)


def literal_split(text: Column, literals: list[str]) -> Column:
    return F.split(text, "|".join(quoted(x) for x in literals))


def windows(items: Column, size: int, step: int) -> Column:
    """Slices of `size` items that begin at 0, step, 2 * step, ... while they begin inside the array."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s, F.lit(size)))


def overlap_units(overlap: float | int, of: int) -> int:
    """A float in [0, 1) is a share of `of`; all else is truncated to an integer."""
    return int(of * overlap) if isinstance(overlap, float) and 0 <= overlap < 1 else int(overlap)
