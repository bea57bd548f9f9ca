"""Command line: ``python -m stemma STORE COMMAND ...``.

    add PATH [DOCTYPE]          files and archives below PATH, or - for standard input
    delete DOCTYPE DOCID
    search FILE [TARGET]        FILE or - for standard input, or DOCTYPE/DOCID of a stored document
    associate [SOURCE [TARGET]]
    list [RANGE]    index    corpus
    queue [ID]      run         the jobs, or one of them; run carries out those that wait
    serve [PORT]                the same over HTTP
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import SparkSession

from stemma.engine import Engine
from stemma.server import serve
from stemma.sources.files import file_documents, text_document


def _text(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8", errors="replace") as file:
        return file.read()


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    store, command, *rest = args
    spark = SparkSession.builder.appName("stemma").getOrCreate()
    engine = Engine(spark, store)
    if command == "add":
        doctype = int(rest[1]) if len(rest) > 1 else 1
        engine.add_documents(text_document(spark, _text("-"), doctype) if rest[0] == "-" else file_documents(spark, rest[0], doctype))
    elif command == "delete":
        engine.delete_documents(spark.createDataFrame([(int(rest[0]), int(rest[1]))], "doctype long, docid long"))
    elif command == "search":
        target = rest[1] if len(rest) > 1 else None
        stored = re.fullmatch(r"(\d+)/(\d+)", rest[0])
        found = engine.search_document(int(stored[1]), int(stored[2]), target) if stored else engine.search(_text(rest[0]), target)
        found.drop("text").show(truncate=False)
    elif command == "associate":
        engine.associate(*rest[:2])
        engine.list_associations(*rest[:2]).drop("fragments").show()
    elif command == "list":
        page, total = engine.list_documents(doctypes=rest[0] if rest else None)
        page.show()
        print(total)
    elif command == "index":
        engine.list_index().show(truncate=False)
    elif command == "queue":
        (engine.queue_item(int(rest[0])) if rest else engine.queue()).show(truncate=False)
    elif command == "run":
        for status, n in engine.run_jobs().items():
            print(status, n)
    elif command == "serve":
        serve(engine, int(rest[0]) if rest else 8080)
    elif command == "corpus":
        engine.test_corpus()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
