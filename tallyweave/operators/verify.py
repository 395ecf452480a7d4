"""Proof that an append changed nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators.formulas import shift_range
from tallyweave.operators.sheet import shifted_row
from tallyweave.schema import MOST_PROBLEMS


class PreservationError(RuntimeError):
    """Existing content differs after an append."""


def style_signature(*facets: str) -> Column:
    """One string for all style facets; null facets count."""
    return F.sha1(F.to_json(F.struct(*facets), {"ignoreNullFields": "false"}))


def differences(before: DataFrame, after: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """(sheet, row, col, problem): cells of ``before`` that are gone, restyled or changed at their shifted place.

    Formulas are not compared by value. Null-safe; a cell that is missing
    afterwards is a change unless it was blank without a style.
    """
    kept = ("vtype", "v_str", "v_num", "v_date", "formula", "style_sig")
    old = before.select("sheet", F.col("row").alias("old_row"), F.when(F.col("sheet") == sheet, shifted_row(F.col("row"), at, count)).otherwise(F.col("row")).alias("row"), "col", *[F.col(c).alias(f"old_{c}") for c in kept])
    both = old.join(after.select("sheet", "row", "col", *kept), ["sheet", "row", "col"], "left")
    same_value = F.lit(True)
    for c in ("vtype", "v_str", "v_num", "v_date"):
        same_value = same_value & F.col(f"old_{c}").eqNullSafe(F.col(c))
    checks = F.array(
        F.when(~F.col("old_style_sig").eqNullSafe(F.col("style_sig")), F.lit("formatting changed")),
        F.when(F.col("old_formula").isNull() & ~same_value, F.lit("value changed")))
    return both.select("sheet", F.col("old_row").alias("row"), "col", F.explode(F.array_compact(checks)).alias("problem"))


def dimension_differences(before: DataFrame, after: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """(sheet, row, problem): row heights that changed; both sides have sheet, row, height."""
    old = before.select("sheet", F.col("row").alias("old_row"), F.when(F.col("sheet") == sheet, shifted_row(F.col("row"), at, count)).otherwise(F.col("row")).alias("row"), F.col("height").alias("old_height"))
    return old.join(after.select("sheet", "row", "height"), ["sheet", "row"], "left").where(~F.col("old_height").eqNullSafe(F.col("height"))).select("sheet", F.col("old_row").alias("row"), F.lit("height changed").alias("problem"))


def width_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sheet, letter, problem): column widths that changed or went."""
    return before.join(after.select("sheet", "letter", F.col("width").alias("new_width")), ["sheet", "letter"], "left").where(~F.col("width").eqNullSafe(F.col("new_width"))).select("sheet", "letter", F.lit("width changed").alias("problem"))


def missing_sheets(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("sheet").distinct().join(after.select("sheet").distinct(), "sheet", "left_anti")


#: One area with its sheet: quoted, plain or none, then a cell or a range.
AREA = r"(?:'((?:[^']|'')+)'!|([\w.]+)!)?(\$?[A-Za-z]{1,3}\$?[0-9]{1,7}(?:\s*:\s*\$?[A-Za-z]{1,3}\$?[0-9]{1,7})?)"


def moved_areas(ref: Column, scope: Column, sheet: str, at: int, count: int) -> Column:
    """Where a ref that is areas alone, apart by spaces or commas, has to be; of any other, its text without numbers.

    The rule is worked out here anew, area by area, and does not use the one that moves formulas.
    """
    def move(part: Column) -> Column:
        name = F.coalesce(F.nullif(F.replace(F.regexp_extract(part, AREA, 1), F.lit("''"), F.lit("'")), F.lit("")), F.nullif(F.regexp_extract(part, AREA, 2), F.lit("")), scope)
        area = F.regexp_extract(part, AREA, 3)
        return F.when(name == sheet, F.concat(F.substring(part, 1, F.length(part) - F.length(area)), shift_range(area, at, count))).otherwise(part)

    # areas and what is between them, in turn
    parts = F.regexp_extract_all(ref, F.lit(f"{AREA}|[, ]+"), F.lit(0))
    moved = F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike("^[, ]+$"), p).otherwise(move(p))))
    return F.when(areas_alone(ref), moved).otherwise(without_numbers(ref))


def areas_alone(ref: Column) -> Column:
    return ref.rlike(f"^{AREA}([, ]+{AREA})*$")


def without_numbers(ref: Column) -> Column:
    return F.regexp_replace(ref, "[0-9]+", "#")


def ref_differences(before: DataFrame, after: DataFrame, sheet: str, at: int, count: int) -> DataFrame:
    """(sheet, name, ref, problem): ranges or names that went, or are not where ``moved_areas`` has them; equal ones are counted."""
    keys = [c for c in ("sheet", "kind", "name") if c in before.columns]
    scope = F.coalesce("sheet", F.lit(sheet))
    old = before.withColumn("new_ref", moved_areas(F.col("ref"), scope, sheet, at, count)).groupBy(*keys, "new_ref").agg(F.count("*").alias("n"), F.min("ref").alias("ref"))
    there = F.when(areas_alone(F.col("ref")), F.col("ref")).otherwise(without_numbers(F.col("ref")))
    new = after.groupBy(*[F.col(c).alias(f"a_{c}") for c in keys], there.alias("a_ref")).agg(F.count("*").alias("m"))
    same = F.col("new_ref").eqNullSafe(F.col("a_ref"))
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"a_{c}"))
    return old.join(new, same, "left").where(~F.col("n").eqNullSafe(F.col("m"))).select("sheet", "name", "ref", F.lit("range differs").alias("problem"))


def verify_parts(before: dict[str, DataFrame], after: dict[str, DataFrame], sheet: str, at: int, count: int) -> list[str]:
    """Problems of what a sheet has besides cells: row_dims, widths, ranges, names, each if given."""
    problems = []
    if "row_dims" in before:
        problems += [f"{r['sheet']} row {r['row']}: {r['problem']}" for r in dimension_differences(before["row_dims"], after["row_dims"], sheet, at, count).limit(MOST_PROBLEMS).collect()]
    if "widths" in before:
        problems += [f"{r['sheet']} column {r['letter']}: {r['problem']}" for r in width_differences(before["widths"], after["widths"]).limit(MOST_PROBLEMS).collect()]
    for part in ("ranges", "names"):
        if part in before:
            problems += [f"{r['sheet']} {r['name']} {r['ref']}: {r['problem']}" for r in ref_differences(before[part], after[part], sheet, at, count).limit(MOST_PROBLEMS).collect()]
    return problems


def verify_untouched(before: DataFrame, after: DataFrame, sheet: str, at: int, count: int, parts: dict[str, DataFrame] | None = None, parts_after: dict[str, DataFrame] | None = None) -> None:
    """Raise PreservationError naming up to 12 differences; to be called before anything is published."""
    gone = [r[0] for r in missing_sheets(before, after).limit(MOST_PROBLEMS).collect()]
    found = differences(before, after, sheet, at, count).limit(MOST_PROBLEMS).collect()
    problems = [f"sheet '{s}' is missing" for s in gone] + [f"{r['sheet']}!{r['row']},{r['col']}: {r['problem']}" for r in found]
    problems += verify_parts(parts or {}, parts_after or {}, sheet, at, count)
    if problems:
        raise PreservationError("The result does not match the original where it should: " + "; ".join(problems[:MOST_PROBLEMS]))
