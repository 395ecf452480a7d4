"""Records as a stream: exact repeats of date and cents across micro-batches, kept in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.functions.values import cents

OUT = "record_id long, date date, amount_cents long, status string, first_id long"


def first_seen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first = state.get[0] if state.exists else None
    for rows in batches:
        rows = rows.sort_values("record_id")
        status = []
        for r in rows["record_id"]:
            status.append(("new", None) if first is None else ("duplicate", first))
            first = int(r) if first is None else first
        yield pd.DataFrame({"record_id": rows["record_id"], "date": key[0], "amount_cents": key[1], "status": [s for s, _ in status], "first_id": pd.array([f for _, f in status], dtype="Int64")})
    state.update((first,))


def stream_repeats(records: DataFrame) -> DataFrame:
    """record_id, date, amount_cents, status and first_id of a stream of records with date and amount.

    State is one number for each date and amount; rows without either are left out.
    """
    keyed = records.select("record_id", "date", cents(F.col("amount")).alias("amount_cents")).where("date is not null and amount_cents is not null")
    return keyed.groupBy("date", "amount_cents").applyInPandasWithState(first_seen, OUT, "first_id long", "append", GroupStateTimeout.NoTimeout)


def daily_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Money in and out for each day of event time (column ts), late rows dropped after ``delay``."""
    day = F.window("ts", "1 day")
    return (events.withWatermark("ts", delay).groupBy(day).agg(F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("money_in"), F.sum(F.when(F.col("amount") < 0, -F.col("amount"))).alias("money_out"))
            .select(F.col("window.start").cast("date").alias("day"), "money_in", "money_out"))
