from __future__ import annotations

import datetime as dt
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text as t, values as v


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_money_shapes(spark):
    said = {"$1,234.56": "1234.56", "(1,234.56)": "-1234.56", "1234.56-": "-1234.56", "45.00 CR": "45", "45.00 DR": "-45", "-99.90": "-99.9", "1 234.56": "1234.56", "500": "500",
            "1,5": "1.5", "1,234": "1234", "$-5": "-5", "(5": "5", "1.234": "1.234", "1.234,56": "1.23456", "+7": "7"}
    assert column(spark, list(said), v.parse_money) == [Decimal(x) for x in said.values()]


def test_numbers_as_their_cells_read(spark):
    said = {88213.0: "88213", 40218777.0: "40218777", 12.5: "12.5", -3.0: "-3", 1.5e-5: "0.000015", 123456789012.25: "123456789012.25", 0.0: "0", None: None}
    assert column(spark, list(said), v.number_text, "double") == list(said.values())


def test_dates_without_python_read_as_with_it(spark):
    said = ["03/04/2025", "13/04/2025", "04/13/2025", "31-12-1999", "02/30/2025", "13/13/2025", "3/4/25", "2025-04-03", " 3/4/2025 ", "12 May 2025", "x", "", None, "00/10/2025"]
    for dayfirst in (False, True):
        fast = column(spark, said, lambda c: v.parse_any_date(c, F.lit(dayfirst), F.lit(2026)))
        assert fast == column(spark, said, lambda c: v.parse_date(c, F.lit(dayfirst), F.lit(2026))), dayfirst


def test_money_inside_arrays(spark):
    rows = spark.createDataFrame([(["(1,000.50)", "x", "7-"],)], "a array<string>").select(F.transform("a", lambda w: v.parse_money(w)).alias("m"))
    assert rows.first()["m"] == [Decimal("-1000.5"), None, Decimal("-7")]


def test_money_refusals(spark):
    assert column(spark, ["abc", "", "-", "--", ".", "12/03/2025", "3.14159", "-$5", None, "1.234.567"], v.parse_money) == [None] * 10


def test_money_european(spark):
    assert column(spark, ["1.234,56"], lambda c: v.parse_money(c, eu_format=True)) == [Decimal("1234.56")]


def test_money_token_is_looser(spark):
    assert column(spark, ["1,000", "500-", "+5", "12abc", "(3.00)"], v.is_money_token) == [True, False, False, False, True]


def test_cents_are_half_even(spark):
    assert column(spark, [0.125, 1.135, -832.10, None], v.cents, "double") == [12, 114, 83210, None]


@pytest.mark.parametrize("dayfirst,day", [(True, dt.date(2025, 4, 3)), (False, dt.date(2025, 3, 4))])
def test_dates(spark, dayfirst, day):
    assert column(spark, ["03/04/2025", "1234", "", None, "12 Mar"], lambda c: v.parse_date(c, F.lit(dayfirst), F.lit(2026))) == [day, None, None, None, dt.date(2026, 3, 12)]
    assert column(spark, ["03/04/2025", "1234", "x"], lambda c: v.parse_date_listed(c, dayfirst)) == [day, None, None]


def test_dayfirst_takes_the_first_decisive_sample(spark):
    rows = spark.createDataFrame([("a", 1, "01/02/2025"), ("a", 2, "13/04/2025"), ("a", 3, "04/13/2025"), ("b", 1, "04/13/2025"), ("c", 1, "01/02/2025")], "d string, ord int, sample string")
    assert {r["d"]: r["dayfirst"] for r in v.infer_dayfirst(rows, ["d"]).collect()} == {"a": True, "b": False, "c": False}


def test_normalize(spark):
    assert column(spark, ["  Client - Payment,  Westfield LLC ", "Éa", None], t.normalize) == ["CLIENT PAYMENT WESTFIELD LLC", "A", ""]


def test_similarity_is_the_largest_score(spark):
    pairs = [("AWS CLOUD SERVICES", "Aws Cloud-Services"), ("CLIENT PAYMENT WESTFIELD LLC", "WESTFIELD"), ("OFFICE RENT MARCH", "ZEBRA"), ("", "X"), ("PAYMENT", "PAYMENTS")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(t.wording("a").alias("x"), t.wording("b").alias("y"))
    rows = t.with_score(rows, "x", "y").select("score").collect()
    got = [r[0] for r in rows]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.9) and got[3] == 0.0
    assert got[4] == pytest.approx(max(SequenceMatcher(None, "PAYMENT", "PAYMENTS").ratio(), 0))
    assert got[2] < 0.55


def test_fingerprint(spark):
    import hashlib

    r = spark.sql("select 'invoice' as kind, date'2026-01-02' as date, '' as description, ' Acme  ltd' as vendor, null as reference, null as amount, 12.5 as total")
    want = hashlib.sha1(b"invoice|2026-01-02|ACME LTD||12.50").hexdigest()[:16]
    assert r.select(t.fingerprint()).first()[0] == want


def test_reference_and_year(spark):
    assert column(spark, ["pay REF 88213 x", "CHQ: 40218", "ref ab"], t.reference_in) == ["88213", "40218", ""]
    assert column(spark, ["in 2024 and 1999", "20245"], t.year_in) == [2024, None]
