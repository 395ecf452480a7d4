"""Streams: verdicts of micro-batches against those of one batch, and totals by day with late rows."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from tallyweave.operators import matching as m
from tallyweave.streaming.matching import daily_totals
from tallyweave.streaming.verdicts import stream_verdicts
from tests.test_matching import BOOK, DAY, RECORD


def test_micro_batches_give_the_verdicts_of_one_batch(spark, tmp_path):
    rng = random.Random(3)
    names = ["AWS CLOUD", "OFFICE RENT MARCH", "AWS CLOUD EU", "", "CLIENT NORTHGATE", "GYM"]
    rows = [(i, i, None if rng.random() < 0.1 else DAY + dt.timedelta(rng.randrange(12)), rng.choice(names), rng.choice(["", "V"]), rng.choice(["", "", "r1", "R-1", "R3"]),
             rng.choice([Decimal("1.00"), Decimal("-1.00"), Decimal("3.00")]), None) for i in range(90)]
    rows.sort(key=lambda r: (r[2] is None, r[2] or DAY, r[3], r[1]))
    for k in range(0, 90, 30):  # files in the order of time: one a micro-batch
        spark.createDataFrame(rows[k:k + 30], RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = (999, 999, DAY, "NO AMOUNT", "", "r1", None, None)
    spark.createDataFrame([more], RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_verdicts(stream).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = {r["record_id"]: (r["status"], r["reason"], r["score"] and round(r["score"], 9)) for r in spark.table("verdicts").collect()}
    assert got.pop(999) == ("unmatchable", "Without an amount nothing can be compared.", None)
    want = m.batch_verdicts(spark.createDataFrame(rows, RECORD), spark.createDataFrame([], BOOK)).collect()
    assert {k: (v[0], v[2]) for k, v in got.items()} == {r["record_id"]: (r["status"], r["score"] and round(r["score"], 9)) for r in want}
    same = {r["record_id"]: r["reason"] for r in want}
    assert sum(v[1] == same[k] for k, v in got.items()) >= 88  # of equally alike neighbours either may be named


def test_daily_totals_drop_late_rows(spark, tmp_path):
    def at(day, hour):
        return dt.datetime(2026, 1, day, hour)

    schema = "ts timestamp, amount decimal(18,2)"
    for rows in ([(at(1, 1), Decimal("5.00")), (at(1, 9), Decimal("-2.00")), (at(2, 1), None)], [(at(9, 1), Decimal("7.00"))], [(at(10, 1), None)], [(at(11, 1), None)], [(at(1, 3), Decimal("100.00")), (at(20, 1), Decimal("1.00"))], [(at(21, 1), Decimal("1.00"))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = daily_totals(stream).writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {r["day"]: (r["money_in"], r["money_out"]) for r in spark.table("totals").orderBy("day").collect()}
    assert got[dt.date(2026, 1, 1)] == (Decimal("5.00"), Decimal("2.00")) and got[dt.date(2026, 1, 9)] == (Decimal("7.00"), None)
