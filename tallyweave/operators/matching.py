"""Matching incoming records against the rows of a book and against the rest of their batch.

Tiers, first hit wins: same reference -> duplicate; no amount -> unmatchable; same
date and cents -> duplicate or probable_duplicate by the first candidate's wording;
same cents within days -> probable_duplicate by the best wording; else new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.functions.text import first_filled, normalize, text, token_key, tokens, with_score, with_token_score, wording
from tallyweave.functions.values import cents
from tallyweave.graph import connected_components
from tallyweave.scratch import Tables, discard
from tallyweave.schema import DATE_TOLERANCE_DAYS, NO_AMOUNT, STRONG_SIMILARITY, WEAK_SIMILARITY

#: Pairs, the columns of two wordings, the least score that has to be exact: the pairs with a column ``score``.
Score = Callable[[DataFrame, str, str, Column], DataFrame]
#: What a score can tell apart of a description, where that is less than its normal form.
SAID = {with_token_score: token_key}


def keyed(records: DataFrame) -> DataFrame:
    """record_id, input_ord, date, description, reference key and cents of the headline amount."""
    return records.select("record_id", "input_ord", "date", text("description").alias("description"),
                          normalize("reference").alias("ref_key"), cents(F.coalesce("amount", "total")).alias("amount_cents"))


def to_existing(records: DataFrame, row: Column | None = None) -> DataFrame:
    """Records as rows of a book: headline amount, description or vendor."""
    return records.select((F.lit(0) if row is None else row).cast("long").alias("row"), "date",
                          first_filled("description", "vendor").alias("description"), text("reference").alias("reference"),
                          cents(F.coalesce("amount", "total")).alias("amount_cents"))


def usable(existing: DataFrame) -> Column:
    """A row that something can be matched with: cents, or date and description."""
    return F.col("amount_cents").isNotNull() | (F.col("date").isNotNull() & (text("description") != ""))


def with_reference(records: DataFrame, existing: DataFrame) -> DataFrame:
    """``records`` with ref_row: the first row with the same non-empty reference and no contradicting amount, or null.

    Each record meets one row for its reference and one for reference and amount, however many rows share them.
    """
    e = existing.select(normalize("reference").alias("e_ref"), F.col("amount_cents").alias("e_cents"), F.col("row").alias("e_row")).where("e_ref <> ''")
    e = e.groupBy("e_ref", "e_cents").agg(F.min("e_row").alias("e_row"))
    whole = e.groupBy("e_ref").agg(F.min("e_row").alias("any_row"), F.min(F.when(F.col("e_cents").isNull(), F.col("e_row"))).alias("open_row"))
    priced = e.where("e_cents is not null").select(F.col("e_ref").alias("p_ref"), "e_cents", F.col("e_row").alias("priced_row"))
    found = (records.join(whole, F.col("ref_key") == F.col("e_ref"), "left")
             .join(priced, (F.col("ref_key") == F.col("p_ref")) & (F.col("amount_cents") == F.col("e_cents")), "left"))
    row = F.when(F.col("amount_cents").isNull(), F.col("any_row")).otherwise(F.least("open_row", "priced_row"))
    return found.withColumn("ref_row", row).drop("e_ref", "any_row", "open_row", "p_ref", "e_cents", "priced_row")


def reference_tier(records: DataFrame, existing: DataFrame) -> DataFrame:
    """(record_id, ref_row) of the records that have one."""
    return with_reference(records, existing).where("ref_row is not null").select("record_id", "ref_row")


def banded(asked: DataFrame, known: DataFrame, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """Pairs of equal ``amount_cents`` whose ``date`` and ``e_date`` are at most ``days`` apart, from one equi-join.

    Days are cut into bands of 2 * days + 1, so what is near a date lies in at most two of them: ``known`` comes once or
    twice instead of once for every day around it. A row of ``asked`` has one ``band``, which its date gives, so grouping
    by band and date needs no shuffle after the join.
    """
    width = 2 * days + 1

    def band(day: Column) -> Column:
        return F.floor(day / width).cast("int")

    day = F.unix_date("e_date")
    twice = known.withColumn("band", F.explode(F.array_distinct(F.array(band(day - days), band(day + days)))))
    return asked.withColumn("band", band(F.unix_date("date"))).join(twice, ["amount_cents", "band"]).where(F.abs(F.datediff("date", "e_date")) <= days)


def wordings(existing: DataFrame, said: Callable[[str], Column] = normalize) -> DataFrame:
    """The book's different wordings of an amount and date, as ``said`` tells them apart, each with its first row; and ``e_empty``: that has no description."""
    dated = existing.where("amount_cents is not null and date is not null").withColumn("description", text("description"))
    e = dated.groupBy("amount_cents", F.col("date").alias("e_date"), said("description").alias("e_said")).agg(
        F.min("row").cast("long").alias("e_row"), F.min(F.when(F.col("description") == "", F.col("row"))).alias("_empty"))
    return e.withColumn("e_empty", F.coalesce(F.col("_empty") == F.col("e_row"), F.lit(False))).drop("_empty")


def firsts(e: DataFrame) -> DataFrame:
    """(amount_cents, date, first): the first row of each amount and date, with its wording."""
    return e.groupBy("amount_cents", F.col("e_date").alias("date")).agg(F.min(F.struct("e_row", "e_said", "e_empty")).alias("first"))


def exact_tier(records: DataFrame, existing: DataFrame, score: Score = with_score) -> DataFrame:
    """(record_id, e_row, score): the first row of the same amount and date. A record meets this row alone, however many there are."""
    said = SAID.get(score, normalize)
    held = records.where("amount_cents is not null and date is not null").select("record_id", "amount_cents", "date", wording("description").alias("wording"))
    met = held.join(firsts(wordings(existing, said)), ["amount_cents", "date"]).select("record_id", "wording", "first.e_row", wording("first.e_said").alias("e_wording"))
    return score(met, "wording", "e_wording", 0.0).select("record_id", "e_row", "score")


def near_tier(records: DataFrame, existing: DataFrame, score: Score = with_score, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """(record_id, near) of the best wording within ``days`` and of the same amount: (score, minus_row, gap), ties to the first row.

    Both sides are brought to the wordings that the score can tell apart first, so an amount that many rows share makes
    no more pairs than it has of these.
    """
    said = SAID.get(score, normalize)
    key = ["amount_cents", "date", "said"]
    legible = F.col("description").rlike("[A-Za-z0-9]")  # others are like nothing; a filter on what they say would find it twice
    held = records.where("amount_cents is not null and date is not null").select("record_id", "amount_cents", "date", "description").where(legible)
    held = held.withColumn("said", said("description")).drop("description")
    e = wordings(existing.where(legible), said)
    asked = held.select(*key).distinct().withColumn("wording", wording("said"))
    pairs = banded(asked, e.withColumn("e_wording", wording("e_said")), days)
    best = score(pairs, "wording", "e_wording", WEAK_SIMILARITY).groupBy(*key, "band").agg(_nearest().alias("near"))
    return held.join(best.where("near is not null"), key).select("record_id", "near")


def _nearest() -> Column:
    """The best of the pairs that are alike enough."""
    return F.max(F.when(F.col("score") >= WEAK_SIMILARITY, F.struct("score", (-F.col("e_row")).alias("minus_row"), F.abs(F.datediff("date", "e_date")).alias("gap"))))


def tiers(records: DataFrame, existing: DataFrame, score: Score = with_score, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """``records`` with ref_row, exact (e_row, score, empty) and near (score, minus_row, gap) of the book: of these the first that hits.

    A wording is compared with the first row of its own day, or else with all wordings near it that the score can tell
    apart. Left joins of many records with one row each; one column of scores, so one pass through Python for what tokens
    leave undecided.
    """
    said = SAID.get(score, normalize)
    found = with_reference(records, existing).withColumn("said", said("description"))
    key = ["amount_cents", "date", "said"]
    e = wordings(existing, said)
    asked = found.where("ref_row is null and amount_cents is not null and date is not null").select(*key).distinct().withColumn("wording", wording("said"))
    asked = asked.join(firsts(e), ["amount_cents", "date"], "left")
    same = asked.where("first is not null").select(*key, "wording", "first.*", F.lit(0).alias("gap"))
    near = banded(asked.where("first is null").drop("first"), e, days).select(*key, "wording", "e_row", "e_said", "e_empty", F.abs(F.datediff("date", "e_date")).alias("gap"))
    pairs = same.unionByName(near).withColumn("e_wording", wording("e_said"))
    scored = score(pairs, "wording", "e_wording", F.when(F.col("gap") == 0, 0.0).otherwise(WEAK_SIMILARITY))
    exact = F.max(F.when(F.col("gap") == 0, F.struct("e_row", "score", "e_empty")))
    near = F.max(F.when((F.col("gap") > 0) & (F.col("score") >= WEAK_SIMILARITY), F.struct("score", (-F.col("e_row")).alias("minus_row"), "gap")))
    best = scored.groupBy(*key).agg(exact.alias("exact"), near.alias("near"))
    found = found.join(best, key, "left").drop("said")
    empty = (F.col("description") == "") | F.col("exact.e_empty")
    found = found.withColumn("exact", F.when(F.col("exact").isNotNull(), F.struct("exact.e_row", "exact.score", empty.alias("empty"))))
    settled = F.col("ref_row").isNotNull()
    return found.withColumns({c: F.when(~settled, F.col(c)) for c in ("exact", "near")})


def cascade(records: DataFrame, existing: DataFrame, score: Score = with_score, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """(record_id, status, row, score, reason) for each record, against the book alone.

    ``records`` as from ``keyed``. See ``tiers``; nothing is ordered globally.
    """
    return _verdict(tiers(records, existing, score, days))


def _verdict(found: DataFrame) -> DataFrame:
    """(record_id, status, row, score, reason) from the tiers' findings; row 0 is a record of the same batch."""
    strong = (F.col("exact.score") >= STRONG_SIMILARITY) | F.col("exact.empty")
    held, ref = F.col("amount_cents").isNotNull(), F.col("ref_row").isNotNull()
    status = (F.when(ref, "duplicate").when(~held, "unmatchable")
              .when(F.col("exact").isNotNull(), F.when(strong, "duplicate").otherwise("probable_duplicate"))
              .when(F.col("near").isNotNull(), "probable_duplicate").otherwise("new"))
    row = F.coalesce("ref_row", F.when(held, F.coalesce(F.col("exact.e_row"), -F.col("near.minus_row"))))
    value = F.when(ref, 1.0).when(held, F.coalesce(F.col("exact.score"), F.col("near.score")))
    reason = (F.when(ref, "same reference").when(~held, NO_AMOUNT)
              .when(F.col("exact").isNotNull(), F.when(strong, "same date and amount").otherwise("same day and amount in other words"))
              .when(F.col("near").isNotNull(), F.concat(F.lit("same amount, "), F.col("near.gap"), F.lit(" days between, alike in words"))).otherwise(""))
    return found.select("record_id", status.alias("status"), row.alias("row"), value.alias("score"), reason.alias("reason"))


def accept_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of each group and amount that are accepted, out of those sorted by group, amount and order.

    A record is accepted unless an accepted one has its reference, its date, or a
    like wording within the tolerance. So an amount has at most one accepted record
    a date, and only these are held; rows are given out batch by batch.
    """
    from datetime import timedelta
    from difflib import SequenceMatcher

    def alike(a: str, b: str, ta: set, tb: set) -> bool:
        if not a or not b or a == b:
            return bool(a and b)
        n = len(ta & tb)
        if n and max(n / len(ta | tb), n / min(len(ta), len(tb)) * 0.9) >= WEAK_SIMILARITY:
            return True
        s = SequenceMatcher(None, a, b)
        return s.quick_ratio() >= WEAK_SIMILARITY and s.ratio() >= WEAK_SIMILARITY

    gaps = [timedelta(k) for k in range(-DATE_TOLERANCE_DAYS, DATE_TOLERANCE_DAYS + 1) if k]
    at, dated, references = None, {}, set()
    for batch in batches:
        taken = []
        for x in batch.itertuples(index=False):
            if (x.group, x.amount_cents) != at:
                at, dated, references = (x.group, x.amount_cents), {}, set()
            hit = x.date in dated or (x.ref_key and x.ref_key in references)
            if not hit and (near := [dated[x.date + g] for g in gaps if x.date + g in dated]):
                words = set(x.words)
                hit = any(alike(x.norm, c[0], words, c[1]) for c in near)
            if not hit:
                dated[x.date] = (x.stored_norm, set(x.stored_words))
                if x.ref_key:
                    references.add(x.ref_key)
            taken.append(not hit)
        yield batch[taken][ACCEPTED]


ACCEPTED = ["record_id", "input_ord", "date", "description", "stored", "ref_key", "amount_cents"]


def contenders(judged: DataFrame, by_date: bool = True) -> DataFrame:
    """The records that may become candidates: those the loop has to look at.

    ``judged`` as from ``tiers``. What the book settles in any tier is never
    accepted; without a date only the reference counts, which needs no loop; and of
    equal amount, date, wording and reference only the first can be accepted, as
    whatever holds it back holds back the others and else it does.
    """
    key = _order_key(by_date)
    open_ = judged.where("amount_cents is not null and ref_row is null and exact is null and near is null")
    undated = _first_references(open_.where("date is null"), by_date).withColumnRenamed("first", "undated")
    dated = open_.where("date is not null").join(undated, ["amount_cents", "ref_key"], "left").where(F.col("undated").isNull() | (F.col("undated") > key))
    firsts = dated.withColumn("norm", normalize("description")).groupBy("amount_cents", "date", "norm", "ref_key").agg(F.min(F.struct(key.alias("key"), "record_id", "input_ord", "description", "stored")).alias("x"))
    return firsts.select("amount_cents", "date", "norm", "ref_key", "x.record_id", "x.input_ord", "x.description", "x.stored")


def independent(asked: DataFrame, t: Tables, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """``asked`` (contenders) with ``group``: records of different groups have no say in each other's acceptance.

    An amount's dates are cut into runs where more than ``days`` lie between them; runs that share a reference
    are one group. So one amount of very many records is as many groups as its dates leave. The window sees
    each date of an amount once.
    """
    dates = asked.select("amount_cents", "date").distinct()
    by_date = W.partitionBy("amount_cents").orderBy("date")
    before = F.lag("date").over(by_date)
    starts = dates.withColumn("start", F.when(before.isNull() | (F.datediff("date", before) > days), F.col("date")))
    starts = starts.withColumn("start", F.last("start", ignorenulls=True).over(by_date))
    # two runs of one hash would only be one group
    cut = t.written(asked.join(starts, ["amount_cents", "date"]).withColumn("run", F.xxhash64("amount_cents", "start")).drop("start"), "contenders")
    coded = cut.where("ref_key <> ''").select("amount_cents", "ref_key", "run").distinct()
    first = coded.groupBy("amount_cents", "ref_key").agg(F.min("run").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = t.written(coded.join(first, ["amount_cents", "ref_key"]).select(F.col("run").alias("u"), F.col("first").alias("v")).where("u <> v"), "links")
    if links.isEmpty():
        return cut.withColumnRenamed("run", "group")
    found = connected_components(links)
    components = t.written(found, "groups")
    discard(found)
    return cut.join(components, F.col("run") == F.col("node"), "left").withColumn("group", F.coalesce("component", "run")).drop("run", "node", "component")


def accepted_records(judged: DataFrame, by_date: bool, t: Tables) -> DataFrame:
    """The dated records that become candidates, by the loop over groups of ``independent`` ones."""
    asked = contenders(judged, by_date).withColumns({"words": tokens("description"), "stored_norm": normalize("stored"), "stored_words": tokens("stored")})
    asked = independent(asked, t).repartition("group").sortWithinPartitions("group", "amount_cents", _order_key(by_date))
    return t.written(asked.mapInPandas(accept_stream, "record_id long, input_ord long, date date, description string, stored string, ref_key string, amount_cents long"), "accepted")


def _first_references(records: DataFrame, by_date: bool) -> DataFrame:
    return records.where("ref_key <> ''").groupBy("amount_cents", "ref_key").agg(F.min(_order_key(by_date)).alias("first"))


def batch_verdicts(records: DataFrame, existing: DataFrame, by_date: bool = True, skip_book: bool = False) -> DataFrame:
    """(record_id, status, row, score, reason): verdicts against the book and against the batch itself.

    An accepted record becomes a candidate for later ones (row 0). Records are
    taken in order (date with nulls last, description, input order; input order
    alone without ``by_date``). A loop over the ``contenders`` finds who is
    accepted, at most one record of an amount and date; all verdicts then come from
    joins with these. The loop streams, one task for a run of dates (and those that
    share a reference with it). ``skip_book`` leaves the book out (in-batch
    duplicates are found all the same).
    """
    r = records.select("record_id", "input_ord", "date", text("description").alias("description"), first_filled("description", "vendor").alias("stored"),
                       normalize("reference").alias("ref_key"), cents(F.coalesce("amount", "total")).alias("amount_cents"))
    key = _order_key(by_date)
    with Tables() as t:
        judged = t.written(tiers(r, existing.where(F.lit(not skip_book))), "judged")
        accepted = accepted_records(judged, by_date, t)
        # the first of each reference in the batch: an accepted record, or an undated one that only a reference could hold back
        undated = judged.where("amount_cents is not null and ref_row is null and date is null").select(*ACCEPTED)
        firsts = _first_references(accepted.unionByName(undated), by_date)
        unpriced = firsts.groupBy("ref_key").agg(F.min("first").alias("first")).withColumn("amount_cents", F.lit(None).cast("long"))
        by_reference = F.col("first").isNotNull() & (F.col("first") < key) & F.col("ref_row").isNull()
        j = judged.join(firsts.unionByName(unpriced.select(*firsts.columns)).withColumnRenamed("amount_cents", "f_cents").withColumnRenamed("ref_key", "f_ref"),
                        (F.col("ref_key") == F.col("f_ref")) & F.col("amount_cents").eqNullSafe(F.col("f_cents")), "left").withColumn("by_ref", by_reference).drop("first", "f_cents", "f_ref")
        j = t.written(j, "referred")
        same = accepted.select("amount_cents", F.col("date").alias("e_date"), key.alias("e_key"), F.col("stored").alias("e_stored"), wording("stored").alias("e_wording"))
        left = j.where("amount_cents is not null and date is not null and ref_row is null and not by_ref and exact is null")
        left = left.select("record_id", "amount_cents", "date", "description", key.alias("key"), wording("description").alias("wording"))
        pairs = banded(left, same).where("e_key < key").withColumn("gap", F.abs(F.datediff("date", "e_date")))
        pairs = with_score(pairs, "wording", "e_wording", F.when(F.col("gap") == 0, 0.0).otherwise(WEAK_SIMILARITY))
        empty = ((F.col("description") == "") | (F.col("e_stored") == "")).alias("empty")
        own = pairs.groupBy("record_id").agg(
            F.max(F.when(F.col("gap") == 0, F.struct(F.lit(0).cast("long").alias("e_row"), "score", empty))).alias("own_exact"),
            F.max(F.when((F.col("gap") > 0) & (F.col("score") >= WEAK_SIMILARITY), F.struct("score", F.lit(0).cast("long").alias("minus_row"), "gap"))).alias("own_near"))
        # the book's rows come first, so a score of the batch has to be higher
        higher = F.col("own_near").isNotNull() & (F.col("near").isNull() | (F.col("own_near.score") > F.col("near.score")))
        j = j.join(own, "record_id", "left").withColumns({"exact": F.coalesce("exact", "own_exact"), "near": F.when(higher, F.col("own_near")).otherwise(F.col("near"))})
        j = j.withColumn("ref_row", F.coalesce(F.col("ref_row").cast("long"), F.when(F.col("by_ref"), F.lit(0).cast("long"))))
        return t.result(_verdict(j), "verdicts")


def _order_key(by_date: bool) -> Column:
    if not by_date:
        return F.struct("input_ord", "record_id")
    return F.struct(F.col("date").isNull().cast("int").alias("undated"), F.coalesce("date", F.lit("0001-01-01").cast("date")).alias("day"), "description", "input_ord", "record_id")
