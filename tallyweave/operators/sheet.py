"""Inserting rows into a sheet of cells: shifting, re-pointing, repairing ranges, filling new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators.formulas import shift_for_insert, shift_range, translate_rows
from tallyweave.operators.mapping import is_money, value_for
from tallyweave.schema import MONEY_FIELDS, TEXT_FIELDS


def shifted_row(row: Column, at: int, count: int) -> Column:
    return F.when(row >= at, row + count).otherwise(row).cast("int")


def insert_rows(rows: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """Cells, or row dimensions: those of ``sheet`` from row ``at`` move down by ``count``."""
    return rows.withColumn("row", F.when(F.col("sheet") == sheet, shifted_row(F.col("row"), at, count)).otherwise(F.col("row")))


def repoint(cells: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """All sheets' formulas follow the insert; only cells with a formula go through Python. ``repointed`` marks changes."""
    plain = cells.where("formula is null").withColumn("repointed", F.lit(False))
    old = cells.where("formula is not null").withColumn("_new", shift_for_insert(F.col("formula"), F.col("sheet"), sheet, at, count))
    return plain.unionByName(old.withColumn("repointed", F.col("_new") != F.col("formula")).withColumn("formula", F.col("_new")).drop("_new"))


def repoint_names(names: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """Defined names (name, scope sheet, ref without =) follow the insert; a place without a sheet is one of the scope, or else of ``sheet``."""
    new = F.substring(shift_for_insert(F.concat(F.lit("="), F.col("ref")), F.coalesce("sheet", F.lit(sheet)), sheet, at, count), 2, 32767)
    return names.withColumn("_new", new).withColumn("repointed", F.coalesce(F.col("_new") != F.col("ref"), F.lit(False))).withColumn("ref", F.col("_new")).drop("_new")


def repair_ranges(ranges: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """Tables, filters, print areas, conditional formats, validations and merges of the sheet: (sheet, kind, name, ref).

    A ref of several parts has them apart by spaces. One with a sheet name or commas (a print area) goes the way of formulas.
    """
    parts = F.array_join(F.transform(F.split("ref", r"\s+"), lambda p: shift_range(p, at, count)), " ")
    mine = ranges.where(F.col("sheet") == sheet)
    bare = ~F.col("ref").rlike("[!,]")
    plain = mine.where(bare).withColumn("ref", parts)
    named = mine.where(~bare).withColumn("ref", expected_ref("ref", "sheet", sheet, at, count))
    return ranges.where(~F.col("sheet").eqNullSafe(F.lit(sheet)) | F.col("ref").isNull()).unionByName(plain).unionByName(named)


def expected_ref(ref: str, scope: str, sheet: str, at: int, count: int) -> Column:
    """A ref without = after the insert, by the rule of formulas."""
    return F.substring(shift_for_insert(F.concat(F.lit("="), ref), F.coalesce(scope, F.lit("")), sheet, at, count), 2, 32767)


def new_cells(added: DataFrame, columns: DataFrame, mapped: DataFrame, sheet: str, at: int, last_data_row: int, date_format: str = "") -> DataFrame:
    """Cells of the appended rows. ``added`` has ``position`` (0 and up): row ``at + position``.

    Computed columns get the bottom formula filled down, mapped ones the record's
    value (money as numbers), others are blank. Styles come from the last data row.
    """
    plan = columns.where(F.col("sheet") == sheet).join(mapped.select("col", "field"), "col", "left").select("col", "field", "formula_template", "number_format")
    fields = {f: value_for(f) for f in (*TEXT_FIELDS, "date", *MONEY_FIELDS)}
    values = added.select((F.lit(at) + F.col("position")).cast("int").alias("row"), *[v.alias(f) for f, v in fields.items()])
    grid = values.crossJoin(F.broadcast(plan))  # a sheet has few columns
    number = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in fields if is_money(f)]).cast("double")
    string = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in TEXT_FIELDS])
    day = F.when(F.col("field") == "date", F.col("date"))
    computed = F.col("formula_template").isNotNull()
    cells = grid.select(
        F.lit(sheet).alias("sheet"), "row", "col",
        F.when(computed, "f").when(number.isNotNull(), "n").when(day.isNotNull(), "d").when(string.isNotNull(), "s").otherwise("e").alias("vtype"),
        F.when(~computed, string).alias("v_str"), F.when(~computed, number).alias("v_num"), F.when(~computed, day).alias("v_date"), "formula_template",
        F.when(day.isNotNull() & F.lit(bool(date_format)), F.lit(date_format)).otherwise(F.col("number_format")).alias("number_format"))
    plain = cells.where("vtype <> 'f'").withColumn("formula", F.lit(None).cast("string"))
    filled = cells.where("vtype = 'f'").withColumn("formula", translate_rows(F.col("formula_template"), F.col("row") - last_data_row))
    return plain.unionByName(filled).drop("formula_template")


def new_heights(row_dims: DataFrame, sheet: str, template_row: int, at: int, count: int) -> DataFrame:
    """(sheet, row, height) of ``count`` new rows from ``at`` on: the height of ``template_row``, or no rows where it has none."""
    height = row_dims.where((F.col("sheet") == sheet) & (F.col("row") == template_row) & F.col("height").isNotNull()).select(F.max("height")).first()[0]
    rows = row_dims.sparkSession.range(at, at + (0 if height is None else count))
    return rows.select(F.lit(sheet).alias("sheet"), F.col("id").cast("int").alias("row"), F.lit(height).cast(row_dims.schema["height"].dataType).alias("height"))


def styled(cells: DataFrame, template: DataFrame, sheet: str, last_data_row: int) -> DataFrame:
    """New cells with the style of the last data row's cell in the same column; blank ones without a style are left out."""
    style = template.where((F.col("sheet") == sheet) & (F.col("row") == last_data_row)).select("col", "style_sig")
    return cells.join(F.broadcast(style), "col", "left").where("vtype <> 'e' or style_sig is not null").select("sheet", "row", "col", "vtype", "v_str", "v_num", "v_date", "formula", "number_format", "style_sig")


def existing_rows(cells: DataFrame, mapped: DataFrame, sheet: str, first_row: int, last_row: int, as_of_year: int) -> DataFrame:
    """``existing_rows_of`` for one sheet whose data span is known, without the sheet column."""
    spans = cells.sparkSession.createDataFrame([(sheet, first_row, last_row)], "sheet string, first_data_row int, last_data_row int")
    return existing_rows_of(cells, mapped.select("col", "field").withColumn("sheet", F.lit(sheet)), spans, as_of_year).drop("sheet")


def existing_rows_of(cells: DataFrame, mapped: DataFrame, spans: DataFrame, as_of_year: int) -> DataFrame:
    """Rows of each sheet's data span reduced to identity: sheet, row, date, description, reference, amount_cents.

    ``mapped`` has sheet, col, field; ``spans`` sheet, first_data_row, last_data_row; sheets in only one of them give no rows.

    Amount is the amount column, else deposit less withdrawal if either is not 0,
    else the total; formulas and text money are not read.
    """
    from tallyweave.functions.text import first_filled, text
    from tallyweave.functions.values import cents, coerce_date, number_text, numeric_cell

    inside = cells.where("formula is null").join(F.broadcast(spans.select("sheet", "first_data_row", "last_data_row")), "sheet").where("row between first_data_row and last_data_row")
    c = inside.join(F.broadcast(mapped.select("sheet", "col", "field")), ["sheet", "col"])

    def number(f: str) -> Column:
        return F.max(F.when(F.col("field") == f, numeric_cell("vtype", "v_num"))).alias(f)

    def string(f: str) -> Column:
        shown = F.coalesce("v_str", number_text("v_num"), F.col("v_date").cast("string"))
        return F.max(F.when(F.col("field") == f, shown)).alias(f)

    # texts are aggregated by sorting, which this way sorts a share of the shuffle instead of all that a map task reads
    rows = c.repartition("sheet", "row").groupBy("sheet", "row").agg(*[number(f) for f in ("amount", "deposit", "withdrawal", "total")], *[string(f) for f in ("description", "payee", "vendor", "reference")],
                                F.max(F.when(F.col("field") == "date", F.struct("vtype", "v_date", "v_str"))).alias("day"))
    net = F.when((F.coalesce("deposit", F.lit(0)) != 0) | (F.coalesce("withdrawal", F.lit(0)) != 0), F.coalesce("deposit", F.lit(0)) - F.coalesce("withdrawal", F.lit(0)))
    return rows.select("sheet", F.col("row").cast("long").alias("row"), coerce_date(F.col("day.vtype"), F.col("day.v_date"), F.col("day.v_str"), as_of_year).alias("date"),
                       first_filled("description", "payee", "vendor").alias("description"), text("reference").alias("reference"),
                       cents(F.coalesce("amount", net, "total")).alias("amount_cents"))
