from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__
from tallyweave import queries

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registry():
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_part(tmp_path):
    """As after both corpus folders and the pipeline file are deleted."""
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('tallyweave.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert 'pipeline' not in e.queries() and 'audit_counts' in e.queries() and e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=HERE)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["audit_counts", "match_reference", "parse_money", "fingerprint", "header_row", "range_grow", "balance_reconcile", "labelled_amounts", "state_rows", "append_ranges", "append_dimensions", "verify_dimensions", "verify_ranges", "invoice_dates", "invoice_items", "scan_flags", "existing_rows", "statement_records", "manual_json", "append_order", "audit_rows", "append_notes", "stopped_payload", "append_names"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)

    def rows(values):
        return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in values)

    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_existing_rows_of_all_sheets(spark):
    """Every sheet's rows reach the operator, and numbers stored as references are read as their cells show them."""
    one = queries.QUERIES["existing_rows"](spark, DATA)
    assert one.select("sheet").distinct().count() == 7
    assert one.where("reference rlike '^[0-9]+$'").count() > 100
