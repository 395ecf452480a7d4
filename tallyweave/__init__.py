"""Ledger reconciliation on Spark: records, layouts, matching, appends and their checks as DataFrames."""
