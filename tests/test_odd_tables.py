"""Queries against their SQL over tables that were made odd."""

from __future__ import annotations

import os

import duckdb
import pytest

from tallyweave import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def tables(folder, **changed: str) -> str:
    """The test tables under ``folder``; those in ``changed`` are the rows of its SQL."""
    con = duckdb.connect()
    for f in os.listdir(DATA):
        name = f.removesuffix(".parquet")
        con.sql(f"copy ({changed.get(name, f'from {name!r}').replace(repr(name), repr(f'{DATA}/{f}'))}) to '{folder}/{f}'")
    return str(folder)


def agrees(spark, name: str, folder: str) -> int:
    """The number of rows, once they are known to equal those of the SQL."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    want = con.sql(queries.ORACLES[name])

    def rows(values):
        return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in values)

    got = rows(queries.QUERIES[name](spark, folder).select(*want.columns).collect())
    assert got == rows(want.fetchall())
    return len(got)


def test_amounts_of_zero_are_records(spark, tmp_path):
    events = "select * replace (case when event_id % 10 = 3 then 0 else value end as value) from 'events'"
    assert agrees(spark, "statement_records", tables(tmp_path, events=events)) == 1000


def test_labels_of_a_line_are_looked_for_once(spark):
    from tallyweave.operators import invoices

    lines = spark.createDataFrame([("a", 1, "Subtotal 1.00", [("Subtotal",), ("1.00",)]), ("a", 2, "Total x 2.50 5", [("Total",), ("x",), ("2.50",), ("5",)]), ("b", 1, "Total", [("Total",)])],
                                  "source string, line_no int, text string, words array<struct<text: string>>")
    got = invoices.labelled_amounts(lines)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("grand") == 1
    assert [(r["source"], r["total"], r["tax"], r["subtotal"]) for r in got.collect()] == [("a", 5, None, 1)]
