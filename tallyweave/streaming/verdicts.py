"""Verdicts of a stream of records: reference, exact and near tiers against what earlier micro-batches accepted."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.functions.text import first_filled, normalize, text, wording
from tallyweave.functions.values import cents
from tallyweave.schema import DATE_TOLERANCE_DAYS, NO_AMOUNT, STRONG_SIMILARITY, WEAK_SIMILARITY

OUT = "record_id long, amount_cents long, date date, status string, score double, reason string"


def likeness(a: str, b: str, ta: set[str], tb: set[str]) -> float:
    """The score of two wordings, as ``functions.text.with_score`` has it."""
    from difflib import SequenceMatcher

    if not a or not b or a == b:
        return float(bool(a and b))
    n = len(ta & tb)
    tokens = max(n / len(ta | tb), n / min(len(ta), len(tb)) * 0.9) if ta and tb else 0.0
    return max(tokens, SequenceMatcher(None, a, b).ratio())


def judge(keep_days: int):
    """Of one amount: what has been accepted lately is the state, as (date, norm, words, empty, reference)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        dated = {date.fromisoformat(d): (norm, set(words), empty) for d, norm, words, empty, _ in held if d}
        references = {x[4] for x in held if x[4]}
        arrived = pd.concat(batches)
        arrived = arrived.assign(undated=arrived["date"].isna()).sort_values(["undated", "date", "description", "input_ord", "record_id"])
        out = []
        for r in arrived.itertuples(index=False):
            day, words = (None if r.undated else r.date), set(r.words)
            status, score, reason = "new", None, ""
            if r.ref_key and r.ref_key in references:
                status, score, reason = "duplicate", 1.0, "same reference"
            elif day in dated:
                norm, others, empty = dated[day]
                score = likeness(r.norm, norm, words, others)
                same = score >= STRONG_SIMILARITY or empty or r.description == ""
                status, reason = ("duplicate", "same date and amount") if same else ("probable_duplicate", "same day and amount in other words")
            elif day is not None:
                around = [(dated.get(day + timedelta(g)), abs(g)) for g in range(-DATE_TOLERANCE_DAYS, DATE_TOLERANCE_DAYS + 1)]
                near = [(s, g) for c, g in around if c and (s := likeness(r.norm, c[0], words, c[1])) >= WEAK_SIMILARITY]
                if near:
                    score, gap = max(near)
                    status, reason = "probable_duplicate", f"same amount, {gap} days between, alike in words"
            if status == "new":
                if day is not None:
                    dated[day] = (r.stored_norm, set(r.stored_words), r.stored == "")
                if r.ref_key:
                    references.add(r.ref_key)
                held.append((day and day.isoformat(), r.stored_norm, list(r.stored_words), r.stored == "", r.ref_key))
            out.append((r.record_id, key[0], day, status, score, reason))
        last = max((x[0] for x in held if x[0]), default="")
        since = (date.fromisoformat(last) - timedelta(keep_days)).isoformat() if last else ""
        state.update((json.dumps([x for x in held if not x[0] or x[0] >= since]),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def stream_verdicts(records: DataFrame, keep_days: int = 400) -> DataFrame:
    """record_id, amount_cents, date, status, score and reason of a stream of records, each judged by what came before it.

    Records of a micro-batch are taken in the order of ``batch_verdicts`` (date with nulls last, description, input
    order), so micro-batches that follow this order get its verdicts; those without an amount are ``unmatchable``, as
    the state is kept by amount, and their references aren't looked for. An amount forgets an accepted record when it has
    one ``keep_days`` later; one that is never seen again keeps its last (a time limit by the clock would run batches for
    ever, also where a trigger is to end with the data). A micro-batch's rows of one amount are held by one task, so limit
    what a trigger reads.
    """
    x, y = wording("description"), wording("stored")
    rows = records.select("record_id", "input_ord", "date", text("description").alias("description"), first_filled("description", "vendor").alias("stored"),
                          normalize("reference").alias("ref_key"), cents(F.coalesce("amount", "total")).alias("amount_cents"))
    rows = rows.withColumns({"norm": x["norm"], "words": x["words"], "stored_norm": y["norm"], "stored_words": y["words"]})
    judged = rows.where("amount_cents is not null").groupBy("amount_cents").applyInPandasWithState(judge(keep_days), OUT, "held string", "append", GroupStateTimeout.NoTimeout)
    unpriced = rows.where("amount_cents is null").select("record_id", "amount_cents", "date", F.lit("unmatchable").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(NO_AMOUNT).alias("reason"))
    return judged.unionByName(unpriced)
