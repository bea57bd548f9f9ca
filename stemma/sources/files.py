"""Documents from files and archives."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.operators.documents import build_documents


def members(path: str, data: bytes):
    """(path, bytes, error) of every file in one file: itself, or what its archive holds.

    Names that begin with a dot and folders are skipped; gzip is undone first, so
    ``.tar.gz`` works; archives may nest. Of an archive that can't be read to its end
    the files before the damage come, then its own path with the error and no bytes.
    """
    name = os.path.basename(path)
    if name.startswith("."):
        return
    try:
        if name.endswith((".gz", ".tgz")):
            data = gzip.decompress(data)
            path = path[:-3] if name.endswith(".gz") else path[:-4] + ".tar"
        if path.endswith(".tar"):
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                for member in archive:
                    if member.isfile():
                        yield from members(f"{path}/{member.name}", archive.extractfile(member).read())
                if data[archive.offset :].strip(b"\0"):  # a header that can't be read ends an archive in silence
                    raise tarfile.ReadError(f"damaged after {archive.offset} bytes")
        elif path.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for info in archive.infolist():
                    if not info.is_dir():
                        yield from members(f"{path}/{info.filename}", archive.read(info))
        else:
            yield path, data, None
    except (OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, zlib.error) as why:
        yield path, None, f"{type(why).__name__}: {why}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, folder, name, modified, text, error) of all files below ``path``, archives opened.

    Bytes that are no UTF-8 become replacement marks. Hidden folders are skipped. A
    damaged archive gives a row with its error and a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hidden = F.regexp_extract("path", r"^[a-z0-9]+:/*", 0)
    files = files.where(~F.expr("substring(path, length(regexp_extract(path, '^[a-z0-9]+:/*', 0)) + 1)").rlike(r"/\.[^/]+/") | (hidden == F.col("path")))
    names, types = ["path", "modified", "text", "error"], [pa.string()] * 4

    def run(batches):
        for batch in batches:
            for where, modified, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for own, content, error in members(where, data):
                    row = (own, modified, None if content is None else content.decode("utf-8", "replace"), error)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    read = files.select("path", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "content").mapInArrow(run, "path string, modified string, text string, error string")
    return read.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "modified", "text", "error")


def file_documents(spark: SparkSession, path: str, doctype: int = 1, docid: int = 1) -> DataFrame:
    """Files as documents: a type for each folder from ``doctype`` on, ids by path within it from ``docid`` on.

    The title is the file's name; path and time of change go to ``meta``. Files that
    could not be read are no documents; ``read_files`` has their errors.
    """
    read = read_files(spark, path).where(F.col("error").isNull())
    folders = read.select("folder").distinct().withColumn("nth", F.row_number().over(Window.orderBy("folder")))
    numbered = read.join(folders, "folder").withColumn("own", F.row_number().over(Window.partitionBy("folder").orderBy("path")))
    return build_documents(numbered, F.col("nth") + (doctype - 1), F.col("own") + (docid - 1), F.col("name"), F.col("text"), {"path": F.col("path"), "modified": F.col("modified")})


def text_document(spark: SparkSession, text: str, doctype: int = 1, docid: int = 1, title: str = "stdin") -> DataFrame:
    """One document from a text, as read from standard input."""
    rows = spark.createDataFrame([(title, text)], "title string, text string")
    return build_documents(rows, F.lit(doctype), F.lit(docid), F.col("title"), F.col("text"))
