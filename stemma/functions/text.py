"""Text normalisation that keeps every character's place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Letters and decimal digits in upper case, every other character one space.

    Upper-casing is one character to one character: where the full mapping is
    longer, as of the German sharp s, the character stays as it is. A null text is
    empty. The result has as many code points as the text.
    """
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}]", " ")
    single = F.array_join(F.transform(F.split(kept, ""), lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c)), "")
    return F.when(F.length(F.upper(kept)) == F.length(kept), F.upper(kept)).otherwise(single)


def pretty(text: Column, limit: int = 57) -> Column:
    """At most ``limit`` characters on one line; what is longer ends in dots."""
    line = F.translate(text, "\n", " ")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)
