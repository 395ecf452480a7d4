"""Documents to records in one step: route, classify, parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.operators import invoices, statements
from tallyweave.scratch import written
from tallyweave.sources import documents


def extract(files: DataFrame, words: DataFrame, contents: DataFrame, as_of_year: int, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, flags) of ``files`` (path).

    ``words`` are the positioned words of the PDF files and ``contents`` (name,
    value) the texts of the JSON files, both by file name. Images, unsupported
    files and PDF files without words give a flag each. A document is a statement
    or an invoice by its words, or ``kind`` says which. Of files with equal names
    all words and texts count as one file's.
    """
    if kind not in (None, "statement", "invoice"):
        raise ValueError(f"a document is a statement or an invoice, not {kind!r}")
    routed = documents.route(files)
    by_hand = routed.where("route = 'manual'").select(documents.file_name("path").alias("name")).distinct()
    pdf = routed.where("route = 'pdf'").select(documents.file_name("path").alias("source")).distinct()
    given, flags = documents.manual_entries(contents.join(by_hand, "name", "left_semi"))
    placed = written(statements.group_lines(words.join(pdf, "source", "left_semi")), "words")
    if kind is None:
        kinds = written(statements.classify(statements.bodies(statements.lines_of(placed))).select("source", "doc_kind"), "kinds")
    else:
        kinds = pdf.withColumn("doc_kind", F.lit(kind))

    def of(which: str) -> DataFrame:
        return placed.join(kinds.where(F.col("doc_kind") == which).select("source"), "source", "left_semi")

    found = [statements.parse_statements(of("statement"), as_of_year), invoices.parse_invoices(statements.lines_of(of("invoice")), as_of_year)]
    records = found[0][0].unionByName(found[1][0])
    held = given.withColumns({"line_items": F.array().cast("array<string>"), "page": F.lit(None).cast("int"), "extra": F.create_map().cast("map<string,string>")})
    flags = flags.unionByName(documents.route_flags(routed)).unionByName(documents.scan_flags(pdf, words))
    for _, more in found:
        flags = flags.unionByName(more)
    return records.unionByName(held.select(*records.columns)), flags
