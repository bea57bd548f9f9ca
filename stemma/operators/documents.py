"""The collection of documents: building, changing, looking up, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.ranges import predicate

KEY = ["doctype", "docid"]
COLUMNS = [*KEY, "title", "text", "characters", "valid", "meta"]


def build_documents(rows: DataFrame, doctype: Column, docid: Column, title: Column, text: Column, meta: dict[str, Column] | None = None, own: Column | None = None) -> DataFrame:
    """Documents from any rows. Ids must be 1 or more, title and text not empty; other rows are left out.

    ``meta`` becomes a map of lists of strings, unless ``own`` is such a map; ``characters`` and ``valid`` follow from the text.
    """
    entries = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.array(v.cast("string")))]
    made = rows.select(
        doctype.cast("long").alias("doctype"),
        docid.cast("long").alias("docid"),
        title.alias("title"),
        text.alias("text"),
        F.length(text).cast("long").alias("characters"),
        F.is_valid_utf8(text).alias("valid"),
        (own if own is not None else F.create_map(*entries)).cast("map<string,array<string>>").alias("meta"),
    )
    return made.where((F.col("doctype") >= 1) & (F.col("docid") >= 1) & (F.length("title") > 0) & (F.length("text") > 0))


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``new``, and what of ``existing`` has another id."""
    return existing.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def delete(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select(*KEY), KEY, "left_anti")


def get(documents: DataFrame, doctype: int, docid: int) -> DataFrame:
    """One document by id; the condition reaches the scan."""
    return documents.where((F.col("doctype") == doctype) & (F.col("docid") == docid))


def get_many(documents: DataFrame, ids: DataFrame, rank: str = "rank") -> DataFrame:
    """Documents of the ids (columns doctype, docid and rank), in order of rank; unknown ids are skipped."""
    return documents.join(ids.select(*KEY, rank), KEY).orderBy(rank)


def docids(documents: DataFrame, doctypes: str | None = None) -> DataFrame:
    """The ids of a range of document types."""
    return documents.where(predicate(doctypes)).select(*KEY)


def order_columns(order_by: list[str] | None) -> list[Column]:
    """Sort keys, ``-`` before a name for descending, then the id."""
    keys = [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in order_by or []]
    named = {k.lstrip("-") for k in order_by or []}
    return keys + [F.col(k).asc() for k in KEY if k not in named]


def list_documents(documents: DataFrame, doctypes: str | None = None, order_by: list[str] | None = None, start: int = 0, limit: int = 10) -> tuple[DataFrame, int]:
    """One page of a listing without texts, and how many documents the range has."""
    chosen = documents.where(predicate(doctypes))
    return chosen.drop("text").orderBy(*order_columns(order_by)).offset(start).limit(limit), chosen.count()
