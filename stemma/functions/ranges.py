"""Ranges of document types, such as ``1-2:3:9``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = re.compile(r"(\d+(-\d+)?(:\d+(-\d+)?)*)?")


def valid(text: str) -> bool:
    return _RANGE.fullmatch(text) is not None


def intervals(text: str | None) -> list[tuple[int, int]]:
    """Closed intervals in order of their starts; none for an empty range; reversed ends are swapped."""
    if not text:
        return []
    if not valid(text):
        raise ValueError(f"not a range of document types: {text!r}")
    ends = ([int(x) for x in part.split("-")] for part in text.split(":"))
    return sorted((min(e), max(e)) for e in ends)


def contains(text: str | None, value: int) -> bool:
    found = intervals(text)
    return not found or any(a <= value <= b for a, b in found)


def predicate(text: str | None, column: str = "doctype") -> Column:
    """A condition on ``column`` that reaches the scan; true for an empty range."""
    tests = [F.col(column) == a if a == b else F.col(column).between(a, b) for a, b in intervals(text)]
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(True)
