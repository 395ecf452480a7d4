"""Totals and counts over planned records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def totals(added: DataFrame) -> DataFrame:
    """One row: money_in, money_out, invoice_total, total_added, and numbers of invoices and transactions."""
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)")

    bank = F.col("kind") == "transaction"
    invoice = F.col("kind") == "invoice"
    return added.agg(
        total("deposit").alias("money_in"), total("withdrawal").alias("money_out"), total(F.when(invoice, F.col("total"))).alias("invoice_total"),
        total(F.coalesce("amount", "total")).alias("total_added"), F.count_if(invoice).alias("invoices"), F.count_if(bank).alias("transactions"))


def verdict_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count("*").alias("n"))


def file_counts(records: DataFrame) -> DataFrame:
    """Per source file: how many records, and their kinds in order."""
    return records.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
