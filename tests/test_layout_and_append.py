from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import formulas, layout, mapping, sheet, verify
from tallyweave.operators.mapping import Profile
from tallyweave.plans import append
from tallyweave.schema import CELL, RECORD


def ledger(spark, rows=8):
    """Title, header in row 3, data from row 4, a blank row, totals; and a sheet of sums."""
    out = [("Transactions", 1, 1, "s", "Ledger 2026", None, None, None, "General", "t")]
    for c, h in enumerate(("Date", "Description", "Category", "Deposit", "Withdrawal", "Net", "Reference"), 1):
        out.append(("Transactions", 3, c, "s", h, None, None, None, "General", "h"))
    for i in range(rows):
        r = 4 + i
        for c, kind, s, n, d, f, fmt in ((1, "d", None, None, dt.date(2026, 1, 5) + dt.timedelta(i), None, "yyyy-mm-dd"), (2, "s", f"EXISTING PAYEE {i + 1}", None, None, None, "General"), (3, "s", "Operations", None, None, None, "General"),
                                         (4, "n", None, 100.0 + i, None, None, "#,##0.00"), (5, "n", None, 40.0 + i, None, None, "#,##0.00"), (6, "f", None, None, None, f"=D{r}-E{r}", "#,##0.00"), (7, "s", f"REF{1000 + i}", None, None, None, "General")):
            out.append(("Transactions", r, c, kind, s, n, d, f, fmt, f"body{c}"))
    end, total = 3 + rows, 5 + rows
    out.append(("Transactions", total, 2, "s", "TOTAL", None, None, None, "General", "sum"))
    out += [("Transactions", total, c, "f", None, None, None, f"=SUM({x}4:{x}{end})", "#,##0.00", "sum") for c, x in ((4, "D"), (5, "E"), (6, "F"))]
    out += [("Summary", 1, 1, "s", "In", None, None, None, "General", "x"), ("Summary", 1, 2, "f", None, None, None, f"=SUM(Transactions!D4:D{end})", "General", "x"), ("Summary", 2, 1, "s", "Out", None, None, None, "General", "x"),
            ("Summary", 2, 2, "f", None, None, None, f"=SUM(Transactions!E4:E{end})", "General", "x")]
    return spark.createDataFrame(out, CELL)


def record(i, date, description, amount, reference="", **more):
    r = dict.fromkeys(("record_id", "input_ord", "kind", "source", "date", "description", "payee", "amount", "deposit", "withdrawal", "balance", "category", "reference", "vendor", "tax", "subtotal", "total", "line_items", "page", "confidence", "extra"))
    a = Decimal(amount) if amount is not None else None
    r |= {"record_id": i, "input_ord": i, "kind": "transaction", "source": "s.pdf", "date": date, "description": description, "payee": description, "amount": a, "category": "", "reference": reference, "vendor": "", "line_items": [], "page": 1, "confidence": "clear", "extra": {}}
    r |= {"deposit": a if a is not None and a > 0 else None, "withdrawal": -a if a is not None and a < 0 else None}
    return tuple((r | more).values())


def test_layout(spark):
    cells = ledger(spark)
    spans = layout.data_spans(cells)
    s = spans.where("sheet = 'Transactions'").first()
    assert (s["header_row"], s["first_col"], s["last_col"], s["first_data_row"], s["last_data_row"], s["total_rows"], s["row_count"]) == (3, 1, 7, 4, 11, [13], 8)
    columns = layout.describe_columns(cells, spans)
    kinds = {r["header"]: (r["inferred_type"], r["is_computed"]) for r in columns.where("sheet = 'Transactions'").collect()}
    assert kinds == {"Date": ("date", False), "Description": ("text", False), "Category": ("text", False), "Deposit": ("money", False), "Withdrawal": ("money", False), "Net": ("money", True), "Reference": ("text", False)}
    order = spark.createDataFrame([("Transactions", 1, True), ("Summary", 2, True)], "sheet string, sheet_ord int, visible boolean")
    assert layout.choose_sheet(layout.scores(spans, columns), order).first()["sheet"] == "Transactions"
    profile = mapping.suggest_profile(columns, "Transactions")
    assert profile.columns == {"A": "date", "B": "description", "C": "category", "D": "deposit", "E": "withdrawal", "G": "reference"}
    assert (profile.kinds, profile.date_format) == (["transaction"], "yyyy-mm-dd")
    with pytest.raises(ValueError):
        append.inspect(cells, order, "Nope")


def test_guess_field(spark):
    rows = spark.createDataFrame([("Withdrawal",), ("Money In",), ("Invoice No",), ("VAT",), ("Widget colour",), ("Remaining",), ("",)], "header string")
    assert [r["field"] for r in mapping.guess_fields(rows.coalesce(1)).orderBy("header").collect()] == [None, "reference", "deposit", "deposit", "tax", None, "withdrawal"]


def test_profile_round_trip(tmp_path):
    p = Profile("S", {"A": "date"}, "yyyy", ["invoice"], False, True)
    assert Profile.load(p.save(tmp_path / "p.json")) == p
    with pytest.raises(TypeError):
        Profile(**{"sheet": "S", "unknown": 1})


@pytest.mark.parametrize("old,new", [
    ("=SUM(D4:D11)", "=SUM(D4:D14)"), ("=D12", "=D15"), ("=D11", "=D11"), ("=SUM(D12:D20)", "=SUM(D15:D23)"), ("=SUM(D2:D5)", "=SUM(D2:D5)"), ('="D12"&D12', '="D12"&D15'), ("=LOG10(D12)", "=LOG10(D15)"),
    ("='My Sheet'!D12", "='My Sheet'!D12"), ("=Other!D12", "=Other!D12"), ("=L!$D$12", "=L!$D$15"), ("= L ! D12 : D14*2", "= L ! D15:D17*2"), ("='L'!D12&'It''s'!D12", "='L'!D15&'It''s'!D12"), ("=D12abc+Q1!Rate", "=D12abc+Q1!Rate"), ("=D12:OFFSET(D12,1,0)", "=D15:OFFSET(D15,1,0)"), ("=$AB12:AC$12", "=$AB15:AC$15"), ("=SUM(D11:\nD20)", "=SUM(D11:D23)"), ("=", "="), (None, None), ("=Tax_2026+1", "=Tax_2026+1"), ("text D12", "text D12")])
def test_shift(old, new):
    assert formulas.shift_formula(old, "L", "L", 12, 3) == new


def test_fill_down():
    assert formulas.fill_formula("=D11-E11*$F$2", 4) == "=D15-E15*$F$2"


def test_shift_range(spark):
    rows = spark.createDataFrame([("A3:G11",), ("A12",), ("A11",), ("$A$12:$B$20",), ("A:B",)], "r string")
    assert [r[0] for r in rows.coalesce(1).select(formulas.shift_range(F.col("r"), 12, 8)).collect()] == ["A3:G19", "A20", "A11", "$A$20:$B$28", "A:B"]


def test_append_end_to_end_and_again(spark, tmp_path):
    cells = ledger(spark).cache()
    profile = Profile("Transactions", {"A": "date", "B": "description", "C": "category", "D": "deposit", "E": "withdrawal", "G": "reference"}, "yyyy-mm-dd", ["transaction"])
    day = dt.date(2026, 3, 2)
    records = spark.createDataFrame([record(1, day, "ACME SUPPLIES", "-1240.55", "88213"), record(2, day, "WESTFIELD", "6500.00"), record(3, dt.date(2026, 1, 5), "EXISTING PAYEE 1", "60.00"),
                                     record(4, day, "NO AMOUNT", None), record(5, day, "WESTFIELD", "6500.00"), record(6, day, "BILL", "5.00", kind="invoice")], RECORD)
    plan = append.append_records(records, cells, profile, str(tmp_path / "x"), 2026, dry_run=True)
    assert plan.status == "dry_run" and not (tmp_path / "x").exists()
    assert {r["record_id"]: r["status"] for r in plan.audit.collect()} == {1: "new", 2: "new", 3: "duplicate", 4: "unmatchable", 5: "duplicate", 6: "other_kind"}
    plan = append.append_records(records, cells, profile, str(tmp_path / "out"), 2026)
    assert plan.status == "written" and plan.first_row == 12
    after, manifest = append.published(spark, str(tmp_path / "out"))
    after = after["cells"].drop("repointed")
    assert manifest["formulas_updated"] == 5 and manifest["first_new_row"] == 12 and manifest["counts"]["new"] == 2
    at = {(r["sheet"], r["row"], r["col"]): r for r in after.collect()}
    assert at["Summary", 1, 2]["formula"] == "=SUM(Transactions!D4:D13)"
    assert at["Transactions", 12, 6]["formula"] == "=D12-E12" and at["Transactions", 13, 6]["formula"] == "=D13-E13"
    assert at["Transactions", 15, 4]["formula"] == "=SUM(D4:D13)"
    assert at["Transactions", 12, 2]["v_str"] == "ACME SUPPLIES" and at["Transactions", 12, 5]["v_num"] == 1240.55 and at["Transactions", 12, 2]["style_sig"] == "body2"
    again = append.plan_append(records, after, profile, 2026)
    assert again.status == "no_new_records"
    totals = append.totals(append.placed(plan.audit)).first()
    assert (totals["money_in"], totals["money_out"], totals["total_added"]) == (Decimal("6500.00"), Decimal("1240.55"), Decimal("5259.45"))
    assert plan.flags.count() == 1
    assert append.audit_rows(plan.audit, profile).first()["cells"]["B"] == "ACME SUPPLIES"
    sent = append.payload(plan, profile).first()["json"]
    assert '"new":2,"duplicate":2,"probable_duplicate":0,"unmatchable":1,"other_kind":1,"flags":1' in sent and '"can_append":true' in sent and '"can_append":false' in append.payload(again, profile).first()["json"]
    lines = append.payload_lines(plan, profile).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in lines} == {"rows": 6, "flags": 1}
    assert append.append_counts(plan).first().asDict() == {"added": 2, "skipped_duplicates": 2, "unmatchable": 1, "other_kind": 1, "file_written": True}


def test_stops(spark):
    cells = ledger(spark)
    none = Profile("Transactions", {"B": "description"}, "", ["transaction"])
    one = spark.createDataFrame([record(1, dt.date(2026, 3, 2), "A", "1.00")], RECORD)
    assert append.plan_append(one, cells, none, 2026).status == "unsafe_to_match"
    assert append.plan_append(one, cells, Profile("Transactions", {"A": "date"}, "", ["invoice"]), 2026).status == "nothing_extracted"


def test_verification_finds_faults(spark):
    cells = ledger(spark)
    after = sheet.insert_rows(cells, "Transactions", 12, 2)
    verify.verify_untouched(cells, after, "Transactions", 12, 2)
    bad = after.withColumn("v_str", F.when((F.col("row") == 5) & (F.col("col") == 2), "changed").otherwise(F.col("v_str")))
    with pytest.raises(verify.PreservationError, match="value changed"):
        verify.verify_untouched(cells, bad, "Transactions", 12, 2)
    restyled = after.withColumn("style_sig", F.when(F.col("row") == 15, "other").otherwise(F.col("style_sig")))
    with pytest.raises(verify.PreservationError, match="formatting"):
        verify.verify_untouched(cells, restyled, "Transactions", 12, 2)


def test_places_in_order_without_one_task(spark):
    from tallyweave.scratch import numbered

    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), "id").repartition(7)
    got = numbered(rows, [F.col("x").desc(), F.col("id").asc()]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [r["id"] for r in sorted(got, key=lambda r: (-r["x"], r["id"]))]
    assert sorted(r["position"] for r in got) == list(range(5000)) and numbered(rows.limit(0), [F.col("x")]).count() == 0


def test_table_names_and_numeric_references(spark):
    cells = ledger(spark).withColumn("v_num", F.when((F.col("row").between(4, 11)) & (F.col("col") == 7), F.col("row") * 1e7).otherwise(F.col("v_num"))).withColumn("vtype", F.when((F.col("row").between(4, 11)) & (F.col("col") == 7), "n").otherwise(F.col("vtype"))).withColumn("v_str", F.when((F.col("row").between(4, 11)) & (F.col("col") == 7), None).otherwise(F.col("v_str")))
    spans = layout.data_spans(cells)
    assert {r["sheet"]: r["table_name"] for r in layout.with_table_names(spans, sheet_parts(spark)["ranges"]).collect()}["Transactions"] == "T"
    columns = layout.describe_columns(cells, spans)
    assert columns.where("sheet = 'Transactions' and col = 7").first()["samples"][0] == "40000000"
    rows = sheet.existing_rows_of(cells, mapping.suggest_columns(columns), spans, 2026).where("sheet = 'Transactions'")
    assert {r["reference"] for r in rows.collect()} == {str(r * 10**7) for r in range(4, 12)}
    profile = Profile("Transactions", {"A": "date", "B": "description", "D": "deposit", "E": "withdrawal", "G": "reference"}, "", ["transaction"])
    found = append.plan_append(spark.createDataFrame([record(1, dt.date(2025, 1, 1), "OTHER WORDS", "60.00", "50000000")], RECORD), cells, profile, 2026)
    assert [(r["status"], r["row"]) for r in found.audit.collect()] == [("duplicate", 5)]


def test_output_name():
    assert append.output_name("book.xlsx") == "book_updated.xlsx"


def sheet_parts(spark):
    return {"row_dims": spark.createDataFrame([("Transactions", 3, 30.0), ("Transactions", 13, 44.0), ("Summary", 13, 9.0)], "sheet string, row int, height double"),
            "widths": spark.createDataFrame([("Transactions", "B", 33.0)], "sheet string, letter string, width double"),
            "ranges": spark.createDataFrame([("Transactions", "table", "T", "A3:G11"), ("Transactions", "validation", "", "C4:C11 E4:E11 G13"), ("Transactions", "merge", "", "A13:B13"), ("Transactions", "print_area", "", "Transactions!$A$1:$G$13"),
                                             ("Summary", "merge", "", "A13:B13")], "sheet string, kind string, name string, ref string"),
            "names": spark.createDataFrame([("ins", None, "Transactions!$D$4:$D$11"), ("sums", None, "Summary!$A$13")], "name string, sheet string, ref string")}


def test_append_moves_all_parts_and_gives_notes_and_state(spark, tmp_path):
    profile = Profile("Transactions", {"A": "date", "B": "description", "D": "deposit", "E": "withdrawal", "G": "reference"}, "yyyy-mm-dd", ["transaction"])
    records = spark.createDataFrame([record(1, dt.date(2026, 3, 2), "ACME", "-5.00"), record(2, dt.date(2026, 3, 3), "WEST", "6.00"), record(3, dt.date(2026, 3, 3), "NONE", None)], RECORD)
    out = str(tmp_path / "out")
    append.append_records(records, ledger(spark), profile, out, 2026, parts=sheet_parts(spark), now=dt.datetime(2026, 4, 1, 8, 30, 5))
    def read(name):
        return {tuple(r) for r in append.published(spark, out)[0][name].collect()}

    assert read("row_dims") == {("Transactions", 3, 30.0), ("Transactions", 15, 44.0), ("Summary", 13, 9.0)}
    assert read("widths") == {("Transactions", "B", 33.0)}
    assert read("ranges") == {("Transactions", "table", "T", "A3:G13"), ("Transactions", "validation", "", "C4:C13 E4:E13 G15"), ("Transactions", "merge", "", "A15:B15"), ("Transactions", "print_area", "", "Transactions!$A$1:$G$15"), ("Summary", "merge", "", "A13:B13")}
    assert read("names") == {("ins", None, "Transactions!$D$4:$D$13"), ("sums", None, "Summary!$A$13")}
    assert [r[:4] for r in read("notes")] == [("2026-04-01 08:30", "s.pdf", "page 1", "amount")]
    state = append.published(spark, out)[0]["state"].orderBy("date").collect()
    assert [(len(r["fingerprint"]), r["added"], r["source"], r["amount"]) for r in state] == [(16, "2026-04-01T08:30:05", "s.pdf", Decimal("-5.00")), (16, "2026-04-01T08:30:05", "s.pdf", Decimal("6.00"))]


@pytest.mark.parametrize("part,word", [("row_dims", "height"), ("widths", "width"), ("ranges", "range"), ("names", "range")])
def test_verification_finds_parts_left_behind(spark, part, word):
    before = sheet_parts(spark)
    after = append.move_parts(before, "Transactions", 12, 2)
    assert verify.verify_parts(before, after, "Transactions", 12, 2) == []
    problems = verify.verify_parts(before, after | {part: before[part].limit(0) if part == "widths" else before[part]}, "Transactions", 12, 2)
    assert problems and all(word in p for p in problems)


PROFILE = Profile("Transactions", {"A": "date", "B": "description", "D": "deposit", "E": "withdrawal", "G": "reference"}, "yyyy-mm-dd", ["transaction"])
GIVEN = ("scan.png", "", "file", "", "An image can't be read.", "")


def given_flags(spark):
    return spark.createDataFrame([GIVEN], "source string, location string, field string, raw string, reason string, row_key string")


def test_flags_of_the_extraction_reach_notes_and_payload(spark, tmp_path):
    records = spark.createDataFrame([record(1, dt.date(2026, 3, 2), "ACME", "-5.00"), record(2, dt.date(2026, 1, 6), "OTHER WORDS", "60.00"), record(3, dt.date(2026, 3, 3), "NONE", None)], RECORD)
    out = str(tmp_path / "out")
    plan = append.append_records(records, ledger(spark), PROFILE, out, 2026, flags=given_flags(spark), track_state=False, check=False)
    tables, _ = append.published(spark, out)
    assert set(tables) == {"cells", "notes"}
    notes = {(r["source"], r["location"], r["field"], r["reason"]) for r in tables["notes"].collect()}
    assert notes == {("scan.png", "", "file", "An image can't be read."), ("s.pdf", "page 1", "amount", "Without an amount nothing can be compared. It was not added."),
                     ("s.pdf", "row 5 of 'Transactions'", "duplicate", "Held back as a likely duplicate (same day and amount in other words). Add it by hand if it is another one.")}
    assert '"flags":3' in append.payload(plan, PROFILE).first()["json"]
    rows = {r["record_id"]: r for r in append.audit_rows(plan.audit, PROFILE).collect()}
    assert (rows[2]["status"], rows[2]["row"], rows[2]["reason"], rows[2]["source"], rows[2]["kind"], rows[2]["confidence"]) == ("probable_duplicate", 5, "same day and amount in other words", "s.pdf", "transaction", "clear")
    with pytest.raises(FileExistsError):
        append.append_records(records, ledger(spark), PROFILE, out, 2026)


@pytest.mark.parametrize("status,profile", [("unsafe_to_match", Profile("Transactions", {"B": "description"}, "", ["transaction"])), ("nothing_extracted", Profile("Transactions", {"A": "date"}, "", ["invoice"])), ("no_new_records", PROFILE)])
def test_stopped_plans_have_a_payload_and_counts(spark, tmp_path, status, profile):
    records = spark.createDataFrame([record(1, dt.date(2026, 1, 5), "EXISTING PAYEE 1", "60.00")], RECORD)
    plan = append.append_records(records, ledger(spark), profile, str(tmp_path / "out"), 2026, flags=given_flags(spark))
    other = int(status == "nothing_extracted")
    assert (plan.status, plan.first_row, plan.counts["other_kind"], (tmp_path / "out").exists()) == (status, 12, other, False)
    sent = append.payload(plan, profile).first()["json"]
    assert f'"status":"{status}"' in sent and f'"other_kind":{other},"flags":1' in sent and '"first_new_row":12,"can_append":false' in sent
    lines = {r["part"]: r["count"] for r in append.payload_lines(plan, profile).groupBy("part").count().collect()}
    assert lines == {"flags": 1, **({} if status == "unsafe_to_match" else {"rows": 1})}
    counts = append.append_counts(plan).first().asDict()
    assert counts == {"added": 0, "skipped_duplicates": int(status == "no_new_records"), "unmatchable": 0, "other_kind": other, "file_written": False}


def test_new_rows_look_like_the_row_above(spark, tmp_path):
    """All columns of the table have a cell with the template's style, blank or not, and the row its height."""
    parts = sheet_parts(spark)
    parts["row_dims"] = parts["row_dims"].unionByName(spark.createDataFrame([("Transactions", 11, 33.0)], parts["row_dims"].schema))
    records = spark.createDataFrame([record(1, dt.date(2026, 3, 2), "ACME", "-5.00"), record(2, dt.date(2026, 3, 3), "WEST", "6.00")], RECORD)
    append.append_records(records, ledger(spark), PROFILE, str(tmp_path / "out"), 2026, parts=parts)
    tables, _ = append.published(spark, str(tmp_path / "out"))
    fresh = tables["cells"].where("sheet = 'Transactions' and row in (12, 13)").orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["style_sig"]) for r in fresh] == [(r, c, f"body{c}") for r in (12, 13) for c in range(1, 8)]
    assert [r["vtype"] for r in fresh[:7]] == ["d", "s", "e", "e", "n", "f", "e"]
    assert {(r["row"], r["height"]) for r in tables["row_dims"].where("sheet = 'Transactions'").collect()} == {(3, 30.0), (11, 33.0), (12, 33.0), (13, 33.0), (15, 44.0)}
    again = append.plan_append(records, tables["cells"], PROFILE, 2026)
    assert (again.status, again.first_row) == ("no_new_records", 14)


def test_names_without_a_sheet_are_of_the_target(spark):
    names = spark.createDataFrame([("a", None, "$D$4:$D$11"), ("b", "Summary", "$D$4:$D$11"), ("c", "Transactions", "$A$12"), ("d", None, "'Transactions'!$A$12,Summary!$A$12"), ("e", None, "OFFSET($A$12,1,0)"), ("f", None, None)], "name string, sheet string, ref string")
    after = append.move_parts({"names": names}, "Transactions", 12, 2)["names"]
    assert {r["name"]: r["ref"] for r in after.collect()} == {"a": "$D$4:$D$13", "b": "$D$4:$D$11", "c": "$A$14", "d": "'Transactions'!$A$14,Summary!$A$12", "e": "OFFSET($A$14,1,0)", "f": None}
    assert verify.verify_parts({"names": names}, {"names": after}, "Transactions", 12, 2) == []


def test_verification_of_names_has_a_rule_of_its_own(spark, monkeypatch):
    """A wrong rule of moving is found, as verification doesn't use it."""
    monkeypatch.setattr(formulas, "shifted_rows", lambda row, end, at, count: (row, end))
    names = sheet_parts(spark)["names"]
    wrong = names.withColumn("ref", F.regexp_replace("ref", "11", "14"))
    assert len(verify.verify_parts({"names": names}, {"names": wrong}, "Transactions", 12, 2)) == 1


def test_a_failed_write_publishes_nothing(spark, tmp_path, monkeypatch):
    """The third table can't be written, or what was written isn't what was given: no manifest, no folder of the run."""
    records = spark.createDataFrame([record(1, dt.date(2026, 3, 2), "ACME", "-5.00")], RECORD)
    parts = {k: v for k, v in sheet_parts(spark).items() if k in ("widths", "row_dims")}
    broken = parts | {"widths": parts["widths"].withColumn("width", F.raise_error(F.lit("disk full")).cast("double"))}
    out = tmp_path / "out"
    with pytest.raises(Exception, match="disk full"):
        append.append_records(records, ledger(spark), PROFILE, str(out), 2026, parts=broken)
    assert [*out.iterdir()] == []
    monkeypatch.setattr(append.sheets, "insert_rows", lambda rows, *_: rows)
    with pytest.raises(verify.PreservationError):
        append.append_records(records, ledger(spark), PROFILE, str(out), 2026, parts=parts)
    assert [*out.iterdir()] == []
    monkeypatch.undo()
    assert append.append_records(records, ledger(spark), PROFILE, str(out), 2026, parts=parts).status == "written"
    assert sorted(p.name.split("-")[0] for p in out.iterdir() if not p.name.startswith(".")) == ["manifest.json", "run"]


def test_no_sheet_meets_in_one_task(spark):
    """Spans come from aggregates, not from a window over a sheet's rows; cells below the sample don't get sorted for a column."""
    from tallyweave.operators import layout

    rows = [("S", 1, 1, "s", "Date", None, None), ("S", 1, 2, "s", "Note", None, None), ("S", 1, 3, "s", "Paid", None, None)]
    rows += [("S", r, 1, "s", f"day {r}", None, None) for r in range(2, 60)] + [("S", 50, 2, "s", "late", None, None)]
    rows += [("S", 61, 1, "s", "Total", None, None), ("S", 30, 1, "s", "Total", None, None)]
    cells = spark.createDataFrame([(*r, None, "General", "") for r in rows], "sheet string, row int, col int, vtype string, v_str string, v_num double, v_date date, formula string, number_format string, style_sig string")
    spans = layout.data_spans(cells)
    assert "Window" not in spans._jdf.queryExecution().executedPlan().toString()
    span = spans.first()
    assert (span["last_data_row"], span["total_rows"]) == (59, [61])
    assert {r["col"]: (r["header"], len(r["samples"]), r["inferred_type"]) for r in layout.describe_columns(cells, spans).collect()} == {1: ("Date", 5, "text"), 2: ("Note", 0, "text"), 3: ("Paid", 0, "text")}
