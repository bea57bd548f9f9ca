"""Definitions of words and white space that the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    # Only the first character of each word is matched, so no list of words is built.
    return F.coalesce(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")), F.lit(0)).cast("long")


def map_arrow(source: DataFrame, function, schema, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` over record batches in pieces of bounded bytes.

    Spark cuts batches by rows; texts may be long, so each batch is handed on in
    slices of at most ``rows`` rows and the results leave as soon as they are made.
    """

    def pieces(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def run(batches):
        yield from function(pieces(batches))

    return source.mapInArrow(run, schema)
