from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from tallyweave.operators import invoices, statements
from tallyweave.schema import WORD
from tallyweave.sources import documents

STATEMENT = [("05/03/2025", "TIMBER YARD CHQ 70031", "2,310.40", "", "7,689.60"), ("05/06/2025", "HARBOUR CAFE RENT IN", "", "1,875.00", "9,564.60"), ("05/09/2025", "WATER BOARD", "96.25", "", "9,468.35"),
             ("05/13/2025", "WAGES 05-2025", "4,020.00", "", "5,448.35"), ("05/19/2025", "ORCHARD SALES", "", "640.15", "6,088.50"), ("05/28/2025", "PAID BACK REF 5512", "", "77.70", "6,166.20")]


def line(source, n, parts, size=9.0):
    """parts: (text, x, right-aligned?); words of one part follow each other."""
    out = []
    for text, x, right in parts:
        words = text.split()
        width = sum(5.5 * len(w) for w in words) + 3 * (len(words) - 1)
        at = float(x - width if right else x)
        for w in words:
            out.append((source, 1, 0, w, at, at + 5.5 * len(w), 10.0 + 14 * n + (0.6 if len(out) % 2 else 0.0), size))
            at += 5.5 * len(w) + 3
    return out


def words(spark, lines):
    rows = [w for l in lines for w in l]
    return statements.group_lines(spark.createDataFrame([(*w[:2], i, *w[3:]) for i, w in enumerate(rows)], WORD))


def test_statement_with_two_columns(spark):
    lines = [line("a", 0, [("ANY BANK statement of account", 60, False)]), line("a", 1, [("Date", 60, False), ("Description", 120, False), ("Withdrawal", 400, True), ("Deposit", 470, True), ("Balance", 545, True)])]
    for i, (d, text, out, into, balance) in enumerate(STATEMENT, 2):
        lines.append(line("a", i, [(d, 60, False), (text, 120, False), *[(x, r, True) for x, r in ((out, 400), (into, 470), (balance, 545)) if x]]))
    lines.insert(4, line("a", 20, [("Closing balance", 60, False), ("6,166.20", 545, True)]))
    lines.append(line("a", 9, [("second line of text", 120, False)]))
    records, flags = statements.parse_statements(words(spark, lines).cache(), 2026)
    got = records.orderBy("input_ord").collect()
    assert len(got) == 6 and flags.count() == 0
    assert got[0]["withdrawal"] == Decimal("2310.40") and got[0]["reference"] == "70031" and got[0]["amount"] == Decimal("-2310.40")
    assert got[2]["amount"] == Decimal("-96.25") and got[2]["date"] == dt.date(2025, 5, 9)
    assert got[0]["balance"] + sum(r["amount"] for r in got[1:]) == got[-1]["balance"]
    assert got[5]["description"] == "PAID BACK REF 5512 second line of text" and got[5]["payee"] == "PAID BACK REF 5512"


def test_statement_with_one_amount_column(spark):
    rows = [("2025-07-02", "YEARLY BONUS", "18.05", "3,018.05"), ("2025-07-05", "TO SAVINGS", "(500.00)", "2,518.05"), ("2025-07-11", "CASH OVER COUNTER", "1,200.00", "3,718.05"), ("2025-07-20", "CARD FEE", "(9.00)", "3,600.00")]
    lines = [line("b", 0, [("Date", 60, False), ("Details", 130, False), ("Amount", 430, True), ("Balance", 520, True)])]
    lines += [line("b", i, [(d, 60, False), (t, 130, False), (a, 430, True), (z, 520, True)]) for i, (d, t, a, z) in enumerate(rows, 1)]
    records, flags = statements.parse_statements(words(spark, lines).cache(), 2026)
    got = records.orderBy("input_ord").collect()
    assert [r["amount"] for r in got] == [Decimal("18.05"), Decimal("-500.00"), Decimal("1200.00"), Decimal("-9.00")]
    assert [r["confidence"] for r in got] == ["clear"] * 3 + ["uncertain"]
    assert [f["field"] for f in flags.collect()] == ["amount"]


def test_statement_without_captions(spark):
    lines = [line("c", 0, [("01/05/2026", 60, False), ("SHOP 77", 130, False), ("$12.00", 430, True), ("$88.00", 520, True)]), line("c", 1, [("01/06/2026", 60, False), ("NO MONEY HERE", 130, False)])]
    records, _ = statements.parse_statements(words(spark, lines).cache(), 2026)
    r = records.collect()
    assert len(r) == 1 and (r[0]["amount"], r[0]["balance"], r[0]["description"]) == (Decimal("12.00"), Decimal("88.00"), "SHOP 77")


def test_lines_are_anchored_on_their_first_word(spark):
    rows = [("d", 1, i, "w", float(i), i + 0.5, top, 9.0) for i, top in enumerate((10.0, 12.5, 13.5, 20.0))]
    got = statements.group_lines(spark.createDataFrame(rows, WORD)).orderBy("word_id").collect()
    assert [r["line"] for r in got] == [0, 0, 1, 2]


def test_invoice(spark):
    lines = [line("i", 0, [("Kiln and Clay Pottery", 60, False)], 16.0), line("i", 1, [("INVOICE", 60, False)], 13.0), line("i", 2, [("Invoice Number: KC-77/2025", 60, False)]), line("i", 3, [("Due date: 30 September 2025", 60, False)]), line("i", 4, [("Invoice date: 2 September 2025", 60, False)]),
             line("i", 5, [("Description Qty Unit Amount", 60, False)]), line("i", 6, [("Firing of bowls", 60, False), ("1,100.00", 520, True)]), line("i", 7, [("Glaze (3 tins)", 60, False), ("3", 360, True), ("20.00", 430, True), ("60.00", 520, True)]),
             line("i", 8, [("Subtotal", 60, False), ("1,160.00", 520, True)]), line("i", 9, [("VAT 20%", 60, False), ("232.00", 520, True)]), line("i", 10, [("Total Due", 60, False), ("1,392.00", 520, True)])]
    records, flags = invoices.parse_invoices(statements.lines_of(words(spark, lines)).cache(), 2026)
    r = records.first()
    assert (r["vendor"], r["reference"], r["date"]) == ("Kiln and Clay Pottery", "KC-77/2025", dt.date(2025, 9, 2))
    assert (r["subtotal"], r["tax"], r["total"], r["amount"]) == (Decimal("1160.00"), Decimal("232.00"), Decimal("1392.00"), Decimal("-1392.00"))
    assert r["line_items"] == ["Firing of bowls", "Glaze (3 tins)"] and r["confidence"] == "clear" and flags.count() == 0


def test_invoice_that_does_not_add_up(spark):
    lines = [line("j", 0, [("Acme", 60, False)], 12.0), line("j", 1, [("Subtotal", 60, False), ("10.00", 520, True)]), line("j", 2, [("Tax", 60, False), ("1.00", 520, True)]), line("j", 3, [("Total", 60, False), ("12.00", 520, True)])]
    records, flags = invoices.parse_invoices(statements.lines_of(words(spark, lines)).cache(), 2026)
    assert records.first()["confidence"] == "uncertain"
    assert sorted(f["field"] for f in flags.collect()) == ["date", "invoice number", "total"]


def test_classify(spark):
    rows = spark.createDataFrame([(1, "account statement\nopening balance"), (2, "invoice\nbill to\nstatement"), (3, "\n".join(["01/02/2026 x"] * 5)), (4, "")], "i int, text string")
    assert [r["doc_kind"] for r in statements.classify(rows).orderBy("i").collect()] == ["statement", "invoice", "statement", "invoice"]


def test_manual_entries(spark):
    rows = spark.createDataFrame([("a.json", '[{"kind":"invoice","date":"2026-01-02","vendor":"V","total":"12.50","odd":1},{"date":"2 Jan","amount":1},{"amount":"x"}]'), ("b.json", '{"records":[{"amount":3.5}]}'), ("c.json", "[]")], "name string, value string")
    records, flags = documents.manual_entries(rows)
    got = records.orderBy("source").collect()
    assert [(r["kind"], r["source"], r["total"], r["amount"]) for r in got] == [("invoice", "a.json", Decimal("12.50"), None), ("transaction", "b.json", None, Decimal("3.50"))]
    assert sorted(f["location"] for f in flags.collect()) == ["entry 2", "entry 3"]


def test_manual_files_that_are_broken(spark):
    """A broken file is a flag and keeps nothing from the others; money is kept as written."""
    rows = spark.createDataFrame([("x", "[{broken"), ("y", '[{"amount": 12.345}, {"amount": "0.12345678"}]'), ("z", None), ("w", '{"records": 5}'), ("v", '{"other": []}'), ("u", "{oops")], "name string, value string")
    records, flags = documents.manual_entries(rows)
    assert [(r["source"], r["amount"]) for r in records.collect()] == [("y", Decimal("12.345"))]
    assert sorted((f["source"], f["location"]) for f in flags.collect()) == [("u", "document"), ("w", "document"), ("x", "document"), ("y", "entry 2")]


def test_documents_to_records(spark):
    """Statements, invoices, entries by hand, images, scans and others in one step; a kind can be forced."""
    from tallyweave.plans.extract import extract

    s = [line("a.pdf", 0, [("Statement of account, opening balance", 60, False)]), line("a.pdf", 1, [("Date", 60, False), ("Details", 130, False), ("Amount", 430, True)]), line("a.pdf", 2, [("2025-07-02", 60, False), ("BONUS", 130, False), ("18.05", 430, True)])]
    i = [line("b.pdf", 0, [("Acme", 60, False)], 12.0), line("b.pdf", 1, [("Invoice No: X-100", 60, False)]), line("b.pdf", 2, [("Total due", 60, False), ("12.00", 520, True)])]
    rows = spark.createDataFrame([(*w[:2], k, *w[3:]) for k, w in enumerate(w for l in s + i for w in l)], WORD)
    files = spark.createDataFrame([(f"/in/{n}",) for n in ("a.pdf", "b.pdf", "c.pdf", "d.JSON", "e.png", "f.doc")], "path string")
    texts = spark.createDataFrame([("d.JSON", '[{"amount": 3, "description": "by hand"}]'), ("other.json", '[{"amount": 4}]')], "name string, value string")
    records, flags = extract(files, rows, texts, 2025)
    assert sorted((r["source"], r["kind"], r["amount"]) for r in records.collect()) == [("a.pdf", "transaction", Decimal("18.05")), ("b.pdf", "invoice", Decimal("-12.00")), ("d.JSON", "transaction", Decimal("3"))]
    said = {(f["source"], f["field"]) for f in flags.collect()}
    assert said == {("b.pdf", "date"), ("c.pdf", "document"), ("e.png", "document"), ("f.doc", "document")}
    forced, _ = extract(files, rows, texts, 2025, kind="invoice")
    assert sorted(r["source"] for r in forced.where("kind = 'invoice'").collect()) == ["a.pdf", "b.pdf"]
    with pytest.raises(ValueError):
        extract(files, rows, texts, 2025, kind="letter")


def test_routes_and_flags(spark, tmp_path):
    for n in ("b.json", "a.pdf", "c.gif", "d.png", "e.txt"):
        (tmp_path / n).write_text("x")
    files, missing = documents.collect(spark, str(tmp_path / "e.txt"), str(tmp_path), str(tmp_path / "nothing"))
    assert [(r["path"].rsplit("/", 1)[1], r["input_ord"]) for r in files.orderBy("input_ord").collect()] == [("e.txt", 1), ("a.pdf", 2), ("b.json", 3), ("d.png", 4)] and missing == [str(tmp_path / "nothing")]
    assert documents.collect(spark, str(tmp_path / "nothing"))[0].count() == 0
    named = documents.route(spark.createDataFrame([("x.GIF",), ("y.doc",), ("z.pdf",)], "path string"))
    assert [r["route"] for r in named.collect()] == ["image", "unsupported", "pdf"]
    assert documents.route_flags(named).count() == 2
    none = spark.createDataFrame([], WORD)
    assert documents.scan_flags(spark.createDataFrame([("z.pdf",)], "source string"), none).count() == 1


def test_stream_of_repeats(spark, tmp_path):
    from tallyweave.streaming.matching import stream_repeats

    schema = "record_id long, date date, amount decimal(18,2)"
    day = dt.date(2026, 1, 1)
    src = tmp_path / "in"
    spark.createDataFrame([(1, day, Decimal("5.00")), (2, day, Decimal("-5.00")), (3, day, Decimal("6.00"))], schema).coalesce(1).write.parquet(str(src))
    q = stream_repeats(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("repeats").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r["record_id"]: r["status"] for r in spark.table("repeats").collect()} == {1: "new", 2: "duplicate", 3: "new"}


def test_roles(spark):
    rows = spark.createDataFrame([("Withdrawals:",), ("Paid",), ("BALANCE",)], "w string")
    assert [r[0] for r in rows.select(statements.role_of("w")).collect()] == ["withdrawal", None, "balance"]


def test_invoices_meet_once(spark, monkeypatch):
    """One grouping of a document's lines gives what the steps give one by one; nothing is joined or grouped again."""
    said = {"a": ["INVOICE", "Kiln Ltd", "Invoice No: A-17", "Due date: 01/02/2025", "Date: soon enough", "Invoice date: 2 Sep 2025", "Invoice date: 13/09/2025", "Item Qty", "", "Bowls (3) 12.00 -", "42", "Glaze \u2013 3 1,060.00", "Net 9.00 x", "VAT (2.00)", "Total $11.00"],
            "b": ["  ", " Acme ", "13/01/2025 Item", "Due 5 CR", "Grand total", "Total due 1,234,567.8"], "c": ["Date: 03/04/2025", "25/12/2024 seen", "Date: never", "Description " * 9], "d": [""], "e": ["dated: 99/99/2025", "Service", "- 5 tax", "sub-total .5 total"]}
    rows = [(k, i, t, float(len(t) % 7), [(w,) for w in t.split(" ")]) for k, ls in said.items() for i, t in enumerate(ls, 1)]
    lines = spark.createDataFrame(rows, "source string, line_no int, text string, size double, words array<struct<text:string>>").cache()
    kept = []
    monkeypatch.setattr(invoices, "written", lambda df, name: kept.append(df) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    records, flags = invoices.parse_invoices(lines, 2026)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (*kept, records, flags)]
    assert sum(p.count("Aggregate [") for p in plans) == 1 and not any("Join" in p for p in plans)
    got = {r["source"]: r for r in kept[0].collect()}
    assert set(got) == set(said)
    for part, names in ((invoices.vendors(lines), ["vendor"]), (invoices.invoice_dates(lines, 2026), ["date", "unread"]), (invoices.labelled_amounts(lines), ["total", "tax", "subtotal"]), (invoices.line_items(lines), ["line_items"])):
        alone = {r["source"]: r for r in part.collect()}
        for k in said:
            assert [got[k][n] or None for n in names] == [alone[k][n] or None if k in alone else None for n in names], (k, names)
    assert (got["a"]["date"], got["a"]["reference"], got["a"]["line_items"]) == (dt.date(2025, 9, 2), "A-17", ["Bowls (3) 12.00", "Glaze"])
    assert (got["a"]["total"], got["a"]["tax"], got["a"]["subtotal"]) == (Decimal("11.00"), Decimal("-2.00"), Decimal("9.00")) and got["b"]["largest"] == Decimal("1234567.8")
