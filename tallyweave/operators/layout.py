"""Layout discovery: which sheet holds the ledger, where its rows are, what its columns carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import blank, header_key, strip, text
from tallyweave.functions.values import number_text
from tallyweave.schema import HEADER_ROWS, NOT_A_LABEL, SAMPLE_ROWS, SAMPLES, SCORED_ROWS, TOTAL_FORMULA, TOTAL_WORDS


def cell_text() -> Column:
    """What a cell says as text: its formula, or its string."""
    return F.coalesce("formula", "v_str")


def is_blank() -> Column:
    return (F.col("vtype") == "e") | ((F.col("vtype") == "s") & F.col("formula").isNull() & blank("v_str"))


def is_label() -> Column:
    """Short text that is not made of digits, punctuation and currency only."""
    t = strip(cell_text())
    return F.coalesce(F.col("vtype").isin("s", "f") & (F.length(t) > 0) & (F.length(t) <= 60) & ~t.rlike(NOT_A_LABEL), F.lit(False))


def header_rows(cells: DataFrame) -> DataFrame:
    """(sheet, header_row): most labels (2 or more) among the first rows, with something in the row below; the topmost wins ties."""
    top = cells.where(F.col("row") <= HEADER_ROWS + 1)
    rows = top.groupBy("sheet", "row").agg(F.sum(is_label().cast("int")).alias("labels"), F.bool_or(~is_blank()).alias("filled"))
    below = rows.select("sheet", (F.col("row") - 1).alias("row"), F.col("filled").alias("below"))
    ok = rows.join(below, ["sheet", "row"]).where((F.col("row") <= HEADER_ROWS) & (F.col("labels") >= 2) & F.col("below"))
    return ok.groupBy("sheet").agg(F.max_by("row", F.struct("labels", -F.col("row"))).alias("header_row"))


def column_spans(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, header_row, first_col, last_col): from the first to the last filled header cell."""
    return (cells.join(F.broadcast(headers), "sheet").where((F.col("row") == F.col("header_row")) & ~is_blank())
            .groupBy("sheet", "header_row").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")))


def is_total_cell() -> Column:
    """An aggregate formula, or short text with a totals word."""
    t = cell_text()
    return F.coalesce(t.startswith("=") & t.rlike(TOTAL_FORMULA), F.lit(False)) | F.coalesce((F.length(t) < 40) & t.rlike(TOTAL_WORDS), F.lit(False))


def data_spans(cells: DataFrame) -> DataFrame:
    """One row a sheet with a header: header_row, first_col, last_col, first_data_row, last_data_row, total_rows, row_count."""
    spans = column_spans(cells, header_rows(cells))
    inside = cells.join(F.broadcast(spans), "sheet").where((F.col("row") > F.col("header_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    rows = inside.groupBy("sheet", "header_row", "row").agg(F.bool_or(~is_blank()).alias("filled"), F.bool_or(is_total_cell()).alias("totals")).where("filled")
    # a sheet's rows never meet in one task: what ends them is known from a maximum first
    last = rows.groupBy("sheet").agg(F.coalesce(F.max(F.when(~F.col("totals"), F.col("row"))), F.min("header_row")).alias("last"))
    below = rows.where("totals").join(F.broadcast(last), "sheet").where("row > last").groupBy("sheet").agg(F.sort_array(F.collect_list("row")).alias("total_rows"))
    return spans.join(last, "sheet", "left").join(below, "sheet", "left").withColumn("last_data_row", F.coalesce("last", "header_row")).select(
        "sheet", "header_row", "first_col", "last_col", (F.col("header_row") + 1).alias("first_data_row"), "last_data_row",
        F.coalesce("total_rows", F.array().cast("array<int>")).alias("total_rows"), (F.col("last_data_row") - F.col("header_row")).alias("row_count"))


def inferred_type(dates: Column, numbers: Column, number_format: Column) -> Column:
    fmt = text(number_format)
    money = fmt.contains("$") | fmt.contains("£") | fmt.contains("€") | fmt.contains("#,##0.00")
    return F.when(dates, "date").when(money, "money").when(numbers, "number").otherwise("text")


def describe_columns(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each column of each sheet: header, formula template, number format, samples, inferred type."""
    c = cells.join(F.broadcast(spans), "sheet").where(F.col("col").between(F.col("first_col"), F.col("last_col")))
    every = c.select("sheet", "col").distinct()
    # only these rows say something of a column, and texts are aggregated by sorting: so few rows are sorted
    c = c.where((F.col("row") == F.col("header_row")) | (F.col("row") == F.col("last_data_row")) | F.col("row").between(F.col("first_data_row"), F.col("first_data_row") + SAMPLE_ROWS - 1))
    sample = (F.col("row") >= F.col("first_data_row")) & (F.col("row") <= F.least(F.col("last_data_row"), F.col("first_data_row") + SAMPLE_ROWS - 1)) & ~is_blank()
    shown = F.coalesce(cell_text(), F.col("v_date").cast("string"), number_text("v_num"))
    format_row = F.greatest(F.col("first_data_row"), F.least(F.col("last_data_row"), F.col("first_data_row")))
    got = c.groupBy("sheet", "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), strip(shown))).alias("header"),
        F.max(F.when((F.col("row") == F.col("last_data_row")) & (F.col("last_data_row") >= F.col("first_data_row")) & cell_text().startswith("="), cell_text())).alias("formula_template"),
        F.max(F.when(F.col("row") == format_row, F.col("number_format"))).alias("number_format"),
        F.array_sort(F.collect_list(F.when(sample, F.struct("row", shown.alias("value"))))).alias("shown"),
        F.coalesce(F.bool_or(sample & (F.col("vtype") == "d")), F.lit(False)).alias("dates"), F.coalesce(F.bool_or(sample & (F.col("vtype") == "n")), F.lit(False)).alias("numbers"))
    got = every.join(F.broadcast(got), ["sheet", "col"], "left").withColumns({"dates": F.coalesce("dates", F.lit(False)), "numbers": F.coalesce("numbers", F.lit(False)), "shown": F.coalesce("shown", F.array().cast("array<struct<row:int,value:string>>"))})
    return got.select("sheet", "col", column_letter(F.col("col")).alias("letter"), text("header").alias("header"), "formula_template", F.col("formula_template").isNotNull().alias("is_computed"),
                      F.coalesce("number_format", F.lit("General")).alias("number_format"), F.transform(F.slice("shown", 1, SAMPLES), lambda s: s["value"]).alias("samples"),
                      inferred_type(F.col("dates"), F.col("numbers"), F.col("number_format")).alias("inferred_type"))


def with_table_names(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """``spans`` with ``table_name``: the sheet's first table by name, from ranges (sheet, kind, name, ref); null without one."""
    first = ranges.where("kind = 'table'").groupBy("sheet").agg(F.min("name").alias("table_name"))
    return spans.drop("table_name").join(first, "sheet", "left")


def column_letter(n: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters."""
    def letter(x: Column) -> Column:
        return F.char((x + 65).cast("long"))

    a = n - 1
    b = F.floor(a / 26) - 1
    c = F.floor(b / 26) - 1
    return F.concat(F.when(a >= 702, letter(c % 26)).otherwise(""), F.when(a >= 26, letter(b % 26)).otherwise(""), letter(a % 26))


def scores(spans: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet, score): 0 without rows or with fewer than 3 named columns, else 2 a column and 0.5 a row up to 200."""
    named = columns.groupBy("sheet").agg(F.sum((F.col("header") != "").cast("int")).alias("named"))
    return spans.join(named, "sheet").select("sheet", F.when((F.col("row_count") < 1) | (F.col("named") < 3), 0.0).otherwise(F.col("named") * 2 + F.least(F.col("row_count"), F.lit(SCORED_ROWS)) * 0.5).alias("score"))


def choose_sheet(scored: DataFrame, order: DataFrame) -> DataFrame:
    """The visible sheet with the highest score, the first of equals; ``order`` has sheet, sheet_ord, visible. No table scores: no row."""
    return scored.join(order.where("visible"), "sheet").where("score > 0").orderBy(F.desc("score"), "sheet_ord").limit(1).select("sheet", "score")


def column_by_header(columns: DataFrame, header: str) -> DataFrame:
    """The first column of each sheet with this header, normalised."""
    return columns.where(header_key("header") == header_key(F.lit(header))).groupBy("sheet").agg(F.min("col").alias("col"))
