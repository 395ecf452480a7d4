from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.operators import matching as m

BOOK = "row long, date date, description string, reference string, amount_cents long"
RECORD = "record_id long, input_ord long, date date, description string, vendor string, reference string, amount decimal(18,2), total decimal(18,2)"
DAY = dt.date(2026, 3, 7)


def verdict(spark, **given):
    r = {"record_id": 1, "input_ord": 1, "date": DAY, "description": "AWS CLOUD SERVICES", "vendor": "", "reference": "", "amount": Decimal("-832.10"), "total": None} | given
    book = spark.createDataFrame([(4, DAY, "AWS CLOUD SERVICES", "INV-1", 83210)], BOOK)
    got = m.cascade(m.keyed(spark.createDataFrame([tuple(r.values())], RECORD)), book).first()
    return got["status"], got["row"]


def test_tiers(spark):
    assert verdict(spark) == ("duplicate", 4)
    assert verdict(spark, amount=Decimal("832.10")) == ("duplicate", 4)
    assert verdict(spark, description="GYM MEMBERSHIP") == ("probable_duplicate", 4)
    assert verdict(spark, description="") == ("duplicate", 4)
    assert verdict(spark, date=DAY + dt.timedelta(2)) == ("probable_duplicate", 4)
    assert verdict(spark, date=DAY + dt.timedelta(4)) == ("new", None)
    assert verdict(spark, date=DAY + dt.timedelta(2), description="GYM") == ("new", None)
    assert verdict(spark, date=None) == ("new", None)
    assert verdict(spark, amount=None) == ("unmatchable", None)
    assert verdict(spark, amount=None, reference="inv 1") == ("duplicate", 4)
    assert verdict(spark, amount=Decimal("1.00"), reference="INV-1") == ("new", None)


def sequential(records, book):
    """The tiers over one growing list, record by record."""
    from difflib import SequenceMatcher
    import re

    from tallyweave.schema import NOISE_TOKENS

    def norm(s):
        return " ".join(re.sub(r"[^A-Za-z0-9 ]+", " ", s or "").upper().split())

    def words(s):
        return {w for w in norm(s).split() if w not in NOISE_TOKENS and not w.isdigit() and len(w) > 1}

    def alike(a, b):
        x, y = norm(a), norm(b)
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        s, p, q = SequenceMatcher(None, x, y).ratio(), words(a), words(b)
        return max(s, len(p & q) / len(p | q), 0.9 * len(p & q) / min(len(p), len(q))) if p and q else s

    known, out = [dict(zip(("row", "date", "description", "reference", "cents"), b)) for b in book], {}
    for r in sorted(records, key=lambda r: (r[2] is None, r[2] or DAY, r[3], r[1])):
        i, _, date, desc, vendor, ref, amount, total = r
        head = amount if amount is not None else total
        c = None if head is None else int(abs(head) * 100)
        status = "new"
        if norm(ref) and any(norm(k["reference"]) == norm(ref) and (c is None or k["cents"] is None or k["cents"] == c) for k in known):
            status = "duplicate"
        elif c is None:
            status = "unmatchable"
        elif date and (same := [k for k in known if k["date"] == date and k["cents"] == c]):
            k = same[0]
            status = "duplicate" if alike(desc, k["description"]) >= 0.55 or not desc or not k["description"] else "probable_duplicate"
        elif date and any(k["cents"] == c and k["date"] and abs((k["date"] - date).days) <= 3 and alike(desc, k["description"]) >= 0.5 for k in known):
            status = "probable_duplicate"
        out[i] = status
        if status == "new":
            known.append({"row": 0, "date": date, "description": desc or vendor, "reference": ref, "cents": c})
    return out


def test_batch_equals_the_sequential_loop(spark):
    rng = random.Random(3)
    names = ["AWS CLOUD", "OFFICE RENT MARCH", "AWS CLOUD EU", "", "CLIENT NORTHGATE"]
    for seed in range(3):
        def date():
            return None if rng.random() < 0.1 else DAY + dt.timedelta(rng.randrange(8))

        book = [(i, date(), rng.choice(names), rng.choice(["", "", "R1", "R2"]), rng.choice([None, 100, 200, 300])) for i in range(12)]
        records = [(i, i, date(), rng.choice(names), rng.choice(["", "V"]), rng.choice(["", "", "r1", "R3", "R4"]), rng.choice([None, Decimal("1.00"), Decimal("-2.00"), Decimal("3.00"), Decimal("4.00")]), None) for i in range(60)]
        want = sequential(records, book)
        df = spark.createDataFrame(records, RECORD).repartition(3 + seed)
        got = {r["record_id"]: r["status"] for r in m.batch_verdicts(df, spark.createDataFrame(book, BOOK)).collect()}
        assert got == want


def test_empty_book_and_empty_batch(spark):
    none = spark.createDataFrame([], BOOK)
    assert m.batch_verdicts(spark.createDataFrame([], RECORD), none).count() == 0
    one = spark.createDataFrame([(1, 1, DAY, "A", "", "", Decimal("1.00"), None)], RECORD)
    assert m.batch_verdicts(one, none).first()["status"] == "new"


def test_plan_joins_on_cents_without_cross_product(spark):
    book = spark.createDataFrame([(4, DAY, "A", "", 100)], BOOK)
    r = m.keyed(spark.createDataFrame([(1, 1, DAY, "A", "", "", Decimal("1.00"), None)], RECORD))
    plan = m.cascade(r, book, t.with_token_score)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_existing_usable(spark):
    book = spark.createDataFrame([(1, DAY, "A", "", None), (2, None, "A", "", None), (3, None, "", "", 5)], BOOK)
    assert [r["row"] for r in book.where(m.usable(book)).orderBy("row").collect()] == [1, 3]


def test_to_existing_takes_vendor(spark):
    r = spark.createDataFrame([(1, 1, DAY, "", "V", "", None, Decimal("2.50"))], RECORD)
    e = m.to_existing(r, F.lit(9)).first()
    assert (e["description"], e["amount_cents"], e["row"]) == ("V", 250, 9)


def crowded():
    """One amount for nearly all rows: 40 days, many wordings and references, a book that settles some of them."""
    rng = random.Random(11)
    names = ["AWS CLOUD", "OFFICE RENT MARCH", "AWS CLOUD EU", "", "-", "CLIENT NORTHGATE", "GYM", "CLIENT NORTH GATE LTD"]

    def date():
        return None if rng.random() < 0.1 else DAY + dt.timedelta(rng.randrange(40))

    book = [(i, DAY + dt.timedelta(rng.randrange(12)), rng.choice(names), rng.choice(["", "", "R1", "R2"]), rng.choice([None, 100, 100])) for i in range(40)]
    records = [(i, 999 - i, date(), rng.choice(names), rng.choice(["", "V"]), rng.choice(["", "", "r1", f"N{rng.randrange(60)}"]), rng.choice([None, *[Decimal("1.00")] * 9]), None) for i in range(600)]
    return records, book


def test_crowded_amount_equals_the_sequential_loop_and_streams(spark):
    records, book = crowded()
    df, known = spark.createDataFrame(records, RECORD).repartition(7), spark.createDataFrame(book, BOOK)
    want = sequential(records, book)
    assert {r["record_id"]: r["status"] for r in m.batch_verdicts(df, known).collect()} == want
    priced = m.tiers(m.keyed(df).join(df.select("record_id", F.col("description").alias("stored")), "record_id"), known)
    asked = m.contenders(priced).collect()
    accepted = {i for i, status in want.items() if status == "new" and records[i][2]}
    assert accepted <= {r["record_id"] for r in asked}
    settled = priced.where("ref_row is not null or exact is not null or near is not null").select("record_id").collect()
    assert settled and not {r[0] for r in settled} & {r["record_id"] for r in asked}


def test_a_repeated_record_enters_the_loop_once(spark):
    df = spark.range(5000).select("id", "id", F.lit(DAY), F.lit("A"), F.lit(""), F.lit(""), F.lit(1).cast("decimal(18,2)"), F.lit(None).cast("decimal(18,2)")).toDF(*[c.split()[0] for c in RECORD.split(", ")])
    none = spark.createDataFrame([], BOOK)
    judged = m.tiers(m.keyed(df).withColumn("stored", F.col("description")), none)
    assert [r["record_id"] for r in m.contenders(judged).collect()] == [0]
    assert {(r["status"], r["n"]) for r in m.batch_verdicts(df, none).groupBy("status").agg(F.count("*").alias("n")).collect()} == {("new", 1), ("duplicate", 4999)}


def test_most_pairs_never_reach_python(spark):
    """Bounds leave out what can't reach 0.5 or beat the tokens, and change no score that matters."""
    rng = random.Random(2)
    words = "AWS CLOUD OFFICE RENT MARCH CLIENT NORTHGATE GYM MEMBERSHIP TESCO STORES AMAZON SARL UBER TRIP LONDON SALARY INVOICE 1234 SAVINGS REFUND".split()
    said = ["", "-", "AWS", *(" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(60))]
    df = spark.createDataFrame([(a, b) for a in said for b in said], "a string, b string").select("a", "b", t.wording("a").alias("x"), t.wording("b").alias("y"))
    x, y = F.col("x"), F.col("y")
    plain = F.when((x["norm"] == "") | (y["norm"] == ""), 0.0).otherwise(F.greatest(t.token_score(x, y), t.sequence_ratio(x["norm"], y["norm"], F.lit(0.0))))
    df = t.with_score(df.withColumn("plain", plain), "x", "y").withColumnRenamed("score", "all").drop("compared")
    got = t.with_score(df, "x", "y", 0.5).withColumnsRenamed({"score": "half", "compared": "asked"}).collect()
    assert all(r["plain"] == r["all"] for r in got)
    assert all(r["plain"] == r["half"] if r["plain"] >= 0.5 else r["half"] < 0.5 for r in got)
    assert sum(r["asked"] for r in got) < len(got) / 2


def test_bands_hold_each_pair_once_without_many_copies(spark):
    days = [DAY + dt.timedelta(k) for k in range(-20, 20)]
    asked = spark.createDataFrame([(1, d) for d in days], "amount_cents long, date date")
    known = spark.createDataFrame([(1, d) for d in days] + [(2, DAY), (None, DAY), (1, None)], "amount_cents long, e_date date")
    for width in (0, 1, 3, 10):
        got = sorted((r["date"], r["e_date"]) for r in m.banded(asked, known, width).collect())
        assert got == [(a, b) for a in days for b in days if abs((a - b).days) <= width]
    plan = m.cascade(m.keyed(spark.createDataFrame([(1, 1, DAY, "A", "", "", Decimal("1.00"), None)], RECORD)), spark.createDataFrame([(4, DAY, "A", "", 100)], BOOK))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and plan.count("Generate explode") == 1


def test_reasons_of_batch_verdicts(spark):
    rows = [(1, 1, DAY, "AWS CLOUD", "", "R1", Decimal("1.00"), None), (2, 2, DAY, "GYM", "", "", Decimal("1.00"), None), (3, 3, DAY + dt.timedelta(2), "AWS CLOUD", "", "", Decimal("1.00"), None),
            (4, 4, DAY, "X", "", "r1", None, None), (5, 5, None, "Y", "", "", None, None), (6, 6, DAY, "AWS CLOUD", "", "", Decimal("-1.00"), None)]
    got = {r["record_id"]: (r["status"], r["row"], r["reason"]) for r in m.batch_verdicts(spark.createDataFrame(rows, RECORD), spark.createDataFrame([], BOOK)).collect()}
    assert got[1] == ("new", None, "") and got[4] == ("duplicate", 0, "same reference") and got[6] == ("duplicate", 0, "same date and amount")
    assert got[2] == ("probable_duplicate", 0, "same day and amount in other words") and got[3] == ("probable_duplicate", 0, "same amount, 2 days between, alike in words")
    assert got[5][:2] == ("unmatchable", None) and got[5][2]


def reference_loop(records):
    """The batch rule for priced and dated records without a book, with one index each for references and dates."""
    from difflib import SequenceMatcher

    refs, dated, out = set(), {}, {}
    for i, _, date, desc, _, ref, amount, _ in sorted(records, key=lambda r: (r[2], r[3], r[1])):
        c, ref = int(abs(amount) * 100), ref.upper()
        near = [dated[c, date + dt.timedelta(k)] for k in range(-3, 4) if (c, date + dt.timedelta(k)) in dated]
        if ref and (c, ref) in refs:
            out[i] = "duplicate"
        elif (c, date) in dated:
            d = dated[c, date]
            out[i] = "duplicate" if d == desc or SequenceMatcher(None, desc, d).ratio() >= 0.55 else "probable_duplicate"
        elif any(d == desc or SequenceMatcher(None, desc, d).ratio() >= 0.5 for d in near):
            out[i] = "probable_duplicate"
        else:
            out[i] = "new"
            dated[c, date] = desc
            if ref:
                refs.add((c, ref))
    return out


def test_one_amount_over_many_tasks(spark, monkeypatch):
    """A third of 200,000 records have one amount: its loop runs in several tasks and equals the sequential one."""
    rng = random.Random(5)
    names = ["ZQXJ", "BBBB", "KKMM", "OOPP", "1122"]
    start = dt.date(1900, 1, 1)
    hot = [(i, i, start + dt.timedelta(rng.randrange(2500) * 9 + rng.randrange(4)), rng.choice(names), "", f"L{rng.randrange(40_000)}" if rng.random() < 0.02 else "", Decimal("7.00"), None) for i in range(66_000)]
    rest = [(i, i, start + dt.timedelta(rng.randrange(2500)), rng.choice(names), "", "", Decimal(rng.randrange(1000, 60_000)) / 100, None) for i in range(66_000, 200_000)]
    df = spark.createDataFrame(hot + rest, RECORD).repartition(8)
    tasks = []
    written = m.Tables.written
    monkeypatch.setattr(m.Tables, "written", lambda self, d, name: tasks.append(d.where("amount_cents = 700").groupBy(F.spark_partition_id()).count().count()) or written(self, d, name) if name == "accepted" else written(self, d, name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["record_id"]: r["status"] for r in m.batch_verdicts(df, spark.createDataFrame([], BOOK)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] > 1
    assert got == reference_loop(hot + rest)


def test_amount_tiers_grow_with_their_input(spark):
    """One amount and few kinds of wordings: a record meets the first row of its day, and each kind once a day."""
    def said(k: str):
        return F.concat(F.element_at(F.array(*map(F.lit, ("VIEW", "CLICK", "CARD REF"))), (F.col(k) % 3 + 1).cast("int")), F.lit(" USER "), F.col(k))

    day = F.date_add(F.lit(DAY), (F.col("id") % 5).cast("int"))
    book = spark.range(3000).select(F.col("id").alias("row"), day.alias("date"), said("id").alias("description"), F.lit("").alias("reference"), F.lit(100).cast("long").alias("amount_cents"))
    records = spark.range(3000).select(F.col("id").alias("record_id"), day.alias("date"), said("id").alias("description"), F.lit(100).cast("long").alias("amount_cents"))
    met = []

    def counting(pairs, x, y, at_least=0.0):
        met.append(pairs)
        return t.with_token_score(pairs, x, y, at_least)

    m.SAID[counting] = t.token_key
    try:
        exact, near = m.exact_tier(records, book, counting), m.near_tier(records, book, counting)
    finally:
        del m.SAID[counting]
    assert [p.count() for p in met][0] == 3000 and met[1].count() <= 5 * 5 * 3 * 3
    assert exact.count() == 3000 and {r[0] for r in exact.select("e_row").distinct().collect()} == {0, 1, 2, 3, 4}
    whole = records.withColumn("w", t.wording("description")).join(book.select("row", F.col("date").alias("e_date"), t.wording("description").alias("v")), F.abs(F.datediff("date", "e_date")) <= 3)
    scored = t.with_token_score(whole, "w", "v").where("score >= 0.5")
    best = scored.groupBy("record_id").agg(F.max(F.struct("score", -F.col("row"), F.abs(F.datediff("date", "e_date")))).alias("near"))
    assert {r[0]: tuple(r[1]) for r in near.collect()} == {r[0]: tuple(r[1]) for r in best.collect()}


def test_token_key_stands_for_its_text(spark):
    said = ["", "-", "12", "POS 12", "AWS CLOUD", "cloud aws", "AWS AWS CLOUD 9", "AWS", "X", "REF X AWS"]
    df = spark.createDataFrame([(a, b) for a in said for b in said], "a string, b string")
    whole = t.token_similarity("a", "b")
    assert df.where(whole != t.token_similarity(t.token_key("a"), t.token_key("b"))).count() == 0
