"""Results as JSON and as text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import pretty


def fragment_json(fragments: Column) -> Column:
    """An array of fragments as a JSON list of ``[left,right,length,theme]``."""
    return F.to_json(F.transform(fragments, lambda x: F.array(x["left"].cast("long"), x["right"].cast("long"), x["length"].cast("long"), x["theme_id"])))


def parse_fragments(text: Column) -> Column:
    rows = F.from_json(text, "array<array<long>>")
    return F.transform(rows, lambda x: F.struct(x[0].cast("int").alias("left"), x[1].cast("int").alias("right"), x[2].cast("int").alias("length"), x[3].alias("theme_id")))


def response(rows: DataFrame, total: int | None = None) -> DataFrame:
    """One JSON document: success, the rows of a page, and the total of which they are one; long results go to ``write_json``."""
    listed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return listed.select(F.to_json(F.struct(F.lit(True).alias("success"), "rows", (F.lit(total) if total is not None else F.size("rows")).cast("long").alias("totalRows"))).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """All rows as gzipped JSON lines, written by the executors."""
    rows.write.option("compression", "gzip").json(path)


def match_lines(ranked: DataFrame) -> DataFrame:
    """A line of text for each match of a search: rank, id, hits, mean step and score."""
    line = F.format_string("%4d %6d/%-8d %6d %9.3f %9.6f", "rank", "doctype", "docid", "count", "mean", "score")
    return ranked.select("query_id", "rank", line.alias("line")).orderBy("query_id", "rank")


def posting_text(lines: DataFrame) -> DataFrame:
    """Lines of the index as text: of each type its ids and their steps."""
    text = F.transform("doctypes", lambda t: F.concat(t["doctype"].cast("string"), F.lit(":"), F.array_join(t["docids"], ","), F.lit("/"), F.array_join(t["deltas"], ",")))
    return lines.select("hash", "bytes", F.array_join(text, " ").alias("line"))


def job_lines(queue: DataFrame) -> DataFrame:
    """A line of text for each job: id, status, command, what it is about and its error."""
    about = F.concat_ws(" ", F.concat_ws("/", "source_doctype", "source_docid"), "source_range", "target_range")
    return queue.select("id", F.trim(F.concat_ws(" ", F.format_string("%6d %-9s %-18s", "id", "status", "command"), about, "error")).alias("line")).orderBy("id")


def association_lines(found: DataFrame, documents: DataFrame) -> DataFrame:
    """A line of text for each fragment under its document's title: places, length and the original text."""
    titles = documents.select("doctype", "docid", pretty(F.col("title"), 15).alias("title"), "text")
    flat = found.select("doctype", "docid", F.posexplode("fragments").alias("nth", "f")).join(titles, ["doctype", "docid"])
    own = pretty(F.expr("substring(text, f.right + 1, f.length)"))
    line = F.format_string("%-15s %8d %8d %6d  %s", "title", "f.left", "f.right", "f.length", own)
    return flat.select("doctype", "docid", "nth", line.alias("line")).orderBy("doctype", "docid", "nth")
