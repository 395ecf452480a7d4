"""Planning an append, carrying it out, and proving that nothing else changed.

A plan is an audit: every record once, with its verdict. Nothing is written
while planning; a result is verified before it is published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyweave.functions.text import fingerprint, text
from tallyweave.operators import aggregates, layout, mapping, sheet as sheets, verify
from tallyweave.operators.mapping import Profile
from tallyweave.operators.matching import batch_verdicts, usable
from tallyweave.scratch import create, delete, exists, numbered, written

MESSAGES = {
    "nothing_extracted": "No records were found for this sheet.",
    "unsafe_to_match": "The sheet has rows but none has a readable date and amount, so nothing can be checked. Nothing was written.",
    "no_new_records": "Everything here is in the sheet already.",
}


VERDICTS = ("new", "duplicate", "probable_duplicate", "unmatchable", "other_kind")


@dataclass
class Plan:
    """``audit``: record_id, status, row, score, reason and the record. ``status``: ready, or why nothing is written.

    A plan that stops has an audit and flags too, as far as it came. ``counts`` has the number of each verdict.
    """

    status: str
    message: str
    audit: DataFrame
    flags: DataFrame
    first_row: int
    counts: dict[str, int]


@dataclass
class Appended:
    """``cells`` after an append; ``parts``: row_dims, widths, ranges and names, as far as they were given; rows for the notes and state sheets."""

    cells: DataFrame
    parts: dict[str, DataFrame]
    notes: DataFrame
    state: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        return {"cells": self.cells, **self.parts, "notes": self.notes, **({} if self.state is None else {"state": self.state})}


def split_by_kind(records: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    ok = F.col("kind").isin(*kinds)
    return records.where(ok), records.where(~ok)


def other_kinds(others: DataFrame, kinds: list[str]) -> DataFrame:
    """Records that the sheet doesn't take, as rows of an audit."""
    return others.withColumns({"status": F.lit("other_kind"), "row": F.lit(None).cast("long"), "score": F.lit(None).cast("double"),
                               "reason": F.lit(f"The sheet takes records of kind {' or '.join(kinds)}.")})


def audit(records: DataFrame, existing: DataFrame, kinds: list[str], by_date: bool = True, skip_duplicates: bool = True) -> DataFrame:
    """Each record once with status, row, score and reason; other kinds are kept apart as other_kind."""
    wanted, others = split_by_kind(records, kinds)
    judged = wanted.join(batch_verdicts(wanted, existing, by_date, skip_book=not skip_duplicates), "record_id")
    return judged.unionByName(other_kinds(others, kinds))


FLAG = ("source", "location", "field", "raw", "reason", "row_key")


def held_back_flags(judged: DataFrame, sheet: str) -> DataFrame:
    """Flags of probable duplicates and of records that cannot be matched."""
    probable = F.col("status") == "probable_duplicate"
    r = judged.where("status in ('probable_duplicate', 'unmatchable')")
    return r.select("source", F.when(probable, F.when(F.col("row") > 0, F.concat(F.lit("row "), F.col("row"), F.lit(f" of '{sheet}'"))).otherwise(""))
                    .otherwise(F.coalesce(F.concat(F.lit("page "), F.col("page")), F.lit(""))).alias("location"),
                    F.when(probable, "duplicate").otherwise("amount").alias("field"),
                    F.when(probable, F.concat_ws(" ", F.col("date").cast("string"), F.substring(text("description"), 1, 40))).otherwise(F.substring(text("description"), 1, 60)).alias("raw"),
                    F.when(probable, F.concat(F.lit("Held back as a likely duplicate ("), F.col("reason"), F.lit("). Add it by hand if it is another one.")))
                    .otherwise(F.concat(F.col("reason"), F.lit(" It was not added."))).alias("reason"), fingerprint().alias("row_key"))


def all_flags(given: DataFrame | None, judged: DataFrame, sheet: str) -> DataFrame:
    """The extraction's flags, then those of the plan."""
    own = held_back_flags(judged, sheet)
    if given is None:
        return own
    missing = {c: F.lit("") for c in FLAG if c not in given.columns}
    return given.withColumns(missing).select(*FLAG).unionByName(own)


def placed(judged: DataFrame, by_date: bool = True) -> DataFrame:
    """New records with ``position`` from 0, in the order they are appended: a sort by ranges, in no single task."""
    order = [F.col("date").asc_nulls_last(), text("description").asc(), F.col("input_ord").asc()] if by_date else [F.col("input_ord").asc()]
    return numbered(judged.where("status = 'new'"), order).withColumn("position", F.col("position").cast("int"))


def insertion_row(last_data_row: int, header_row: int) -> int:
    return max(last_data_row, header_row) + 1


def counted(judged: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The audit, written, and the number of each verdict, counted in the pass that writes it."""
    seen = Observation()
    out = written(judged.observe(seen, *(F.count_if(F.col("status") == v).alias(v) for v in VERDICTS)), "audit")
    return out, {v: seen.get[v] for v in VERDICTS}


def plan_append(records: DataFrame, cells: DataFrame, profile: Profile, as_of_year: int, flags: DataFrame | None = None) -> Plan:
    """The whole decision: layout, existing rows, verdicts, or the reason to stop. ``flags`` are the extraction's."""
    spans = layout.data_spans(cells.where(F.col("sheet") == profile.sheet))
    span = spans.first()
    if span is None:
        raise ValueError(f"no table on sheet {profile.sheet!r}")
    first_row = insertion_row(span["last_data_row"], span["header_row"])
    wanted, others = split_by_kind(records, profile.kinds)

    def plan(status: str, judged: DataFrame, more: str = "") -> Plan:
        kept, counts = counted(judged)
        if status == "ready" and not counts["new"]:
            status = "no_new_records"
        return Plan(status, MESSAGES.get(status, "") + (more if counts["other_kind"] else ""), kept, all_flags(flags, kept, profile.sheet), first_row, counts)

    if wanted.isEmpty():
        return plan("nothing_extracted", other_kinds(others, profile.kinds), " Records of other kinds were found.")
    mapped = profile.frame(records.sparkSession).join(layout.describe_columns(cells, spans).select("sheet", "letter", "col"), ["sheet", "letter"])
    existing = sheets.existing_rows(cells, mapped, profile.sheet, span["first_data_row"], span["last_data_row"], as_of_year)
    if profile.skip_duplicates:
        n = existing.agg(F.count("*").alias("rows"), F.count_if(usable(existing)).alias("usable")).first()
        if span["row_count"] > 0 and n["usable"] == 0:
            return plan("unsafe_to_match", other_kinds(others, profile.kinds))
    return plan("ready", audit(records, existing, profile.kinds, profile.sort_by_date, profile.skip_duplicates))


def move_parts(parts: dict[str, DataFrame], sheet: str, at: int, count: int, template_row: int | None = None) -> dict[str, DataFrame]:
    """What a workbook has besides cells, after the insert: row_dims (sheet, row, height), widths (sheet, letter, width), ranges (sheet, kind, name, ref), names (name, sheet, ref).

    New rows get the height of ``template_row``, if it has one.
    """
    moves = {"row_dims": sheets.insert_rows, "widths": lambda rows, *_: rows, "ranges": sheets.repair_ranges, "names": sheets.repoint_names}
    if unknown := set(parts) - set(moves):
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    out = {k: moves[k](rows, sheet, at, count) for k, rows in parts.items()}
    if "row_dims" in parts and template_row is not None:
        out["row_dims"] = out["row_dims"].unionByName(sheets.new_heights(parts["row_dims"], sheet, template_row, at, count))
    return out


def perform_append(plan: Plan, cells: DataFrame, profile: Profile, parts: dict[str, DataFrame] | None = None, now: datetime | None = None, track_state: bool = True) -> Appended:
    """All sheets' cells and ``parts`` after the append, and the rows for notes and state. ``cells`` has ``repointed``: whether its formula changed."""
    now = now or datetime.now()
    spans = layout.data_spans(cells.where(F.col("sheet") == profile.sheet))
    span = spans.first()
    columns = layout.describe_columns(cells.where(F.col("sheet") == profile.sheet), spans)
    mapped = profile.frame(cells.sparkSession).join(columns.select("sheet", "letter", "col"), ["sheet", "letter"])
    added, count = placed(plan.audit, profile.sort_by_date), plan.counts["new"]
    moved = sheets.repoint(sheets.insert_rows(cells, profile.sheet, plan.first_row, count), profile.sheet, plan.first_row, count)
    fresh = sheets.styled(sheets.new_cells(added, columns, mapped, profile.sheet, plan.first_row, span["last_data_row"], profile.date_format), cells, profile.sheet, span["last_data_row"])
    after = moved.unionByName(fresh.withColumn("repointed", F.lit(False)))
    state = state_rows(added, now.isoformat(timespec="seconds")) if track_state else None
    return Appended(after, move_parts(parts or {}, profile.sheet, plan.first_row, count, span["last_data_row"]), review_notes(plan.flags, now.strftime("%Y-%m-%d %H:%M")), state)


MANIFEST = "manifest.json"


def append_records(records: DataFrame, cells: DataFrame, profile: Profile, output: str, as_of_year: int, dry_run: bool = False, parts: dict[str, DataFrame] | None = None,
                   now: datetime | None = None, flags: DataFrame | None = None, track_state: bool = True, check: bool = True) -> Plan:
    """Plan, write, verify what was written, then publish. A dry run or a stop writes nothing.

    Every table goes to a folder of the run below ``output``. When all are there, they
    are read back and held against what was given (unless ``check`` is false); a
    manifest that names them, written last, is what publishes them: see ``published``.
    On a failure the run's folder goes, and there is no manifest. ``output`` must not
    have one before. ``track_state`` says whether the state sheet's rows are written,
    ``flags`` are the extraction's, which go to the notes with the plan's own.
    """
    spark = cells.sparkSession
    if exists(spark, f"{output}/{MANIFEST}"):
        raise FileExistsError(f"{output} holds an append already")
    plan = plan_append(records, cells, profile, as_of_year, flags)
    if plan.status != "ready" or dry_run:
        plan.status = "dry_run" if plan.status == "ready" else plan.status
        return plan
    done = perform_append(plan, cells, profile, parts, now, track_state)
    folder = f"{output}/run-{uuid.uuid4().hex}"
    seen: dict[str, Observation] = {}
    try:
        for name, rows in done.tables().items():
            changed = F.col("repointed") if "repointed" in rows.columns else F.lit(False)
            seen[name] = Observation()
            rows.observe(seen[name], F.count(F.lit(1)).alias("rows"), F.count_if(changed).alias("repointed")).drop("repointed").write.parquet(f"{folder}/{name}")
        if check:
            back = {name: spark.read.parquet(f"{folder}/{name}") for name in done.tables()}
            verify.verify_untouched(cells, back["cells"], profile.sheet, plan.first_row, plan.counts["new"], parts or {}, back)
        tables = {name: {"path": f"{folder}/{name}", "rows": x.get["rows"]} for name, x in seen.items()}
        create(spark, f"{output}/{MANIFEST}", json.dumps({"tables": tables, "counts": plan.counts, "first_new_row": plan.first_row, "formulas_updated": sum(x.get["repointed"] for x in seen.values())}))
    except BaseException:
        delete(spark, folder)
        raise
    plan.status = "written"
    return plan


def published(spark: SparkSession, output: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of an append by name, and its manifest."""
    manifest = json.loads(spark.read.text(f"{output}/{MANIFEST}", wholetext=True).first()[0])
    return {name: spark.read.parquet(t["path"]) for name, t in manifest["tables"].items()}, manifest


def output_name(name: str) -> str:
    """<stem>_updated<suffix>: the original is never overwritten."""
    stem, dot, suffix = name.rpartition(".")
    return f"{stem}_updated.{suffix}" if dot else f"{name}_updated"


def review_notes(flags: DataFrame, stamp: str) -> DataFrame:
    """Rows for the notes sheet: run stamp, then the flag."""
    return flags.select(F.lit(stamp).alias("run"), "source", "location", "field", "raw", "reason")


def state_rows(added: DataFrame, stamp: str) -> DataFrame:
    """What the hidden state sheet gets; it is never read back."""
    return added.select(fingerprint().alias("fingerprint"), F.lit(stamp).alias("added"), "source", "date", F.coalesce("amount", "total").alias("amount"))


def payload(plan: Plan, profile: Profile) -> DataFrame:
    """One row of JSON: status, message, counts by verdict and of flags, first new row, and whether there is something to append.

    The rows and flags that belong to it are ``payload_lines``. A plan that stopped has them all the same.
    """
    said = plan.audit.select("status").unionByName(plan.flags.select(F.lit("flags").alias("status")))
    counts = said.agg(*(F.count_if(F.col("status") == v).alias(v) for v in (*VERDICTS, "flags"))).select(F.struct("*").alias("counts"))
    can = F.lit(plan.status in ("ready", "dry_run", "written")) & (F.col("counts.new") > 0)
    return counts.select(F.to_json(F.struct(F.lit(plan.status).alias("status"), F.lit(plan.message).alias("message"), F.lit(profile.sheet).alias("sheet"), "counts", F.lit(plan.first_row).alias("first_new_row"), can.alias("can_append"))).alias("json"))


def payload_lines(plan: Plan, profile: Profile) -> DataFrame:
    """(part, json): a line for each audited row and each flag; as many as there are, so they stay distributed."""
    rows = audit_rows(plan.audit, profile)
    rows = rows.select(F.lit("rows").alias("part"), F.to_json(F.struct(*rows.columns)).alias("json"))
    return rows.unionByName(plan.flags.select(F.lit("flags").alias("part"), F.to_json(F.struct(*plan.flags.columns)).alias("json")))


def append_counts(plan: Plan) -> DataFrame:
    """One row: added, skipped_duplicates (certain and probable ones), unmatchable, other_kind, file_written."""
    def n(*statuses: str):
        return F.count_if(F.col("status").isin(*statuses))

    return plan.audit.agg(n("new").alias("added"), n("duplicate", "probable_duplicate").alias("skipped_duplicates"), n("unmatchable").alias("unmatchable"),
                          n("other_kind").alias("other_kind")).withColumn("file_written", F.lit(plan.status == "written"))


def audit_rows(judged: DataFrame, profile: Profile) -> DataFrame:
    """record_id, status, reason, matched row, source, kind, confidence and ``cells``: the value for each mapped letter.

    Ordered new, probable, unmatchable, other kind, duplicate; records that say nothing of their confidence have none.
    """
    letters = F.create_map(*[x for k, f in profile.columns.items() for x in (F.lit(k), mapping.value_for(f).cast("string"))]) if profile.columns else F.create_map().cast("map<string,string>")
    rank = F.when(F.col("status") == "new", 0).when(F.col("status") == "probable_duplicate", 1).when(F.col("status") == "unmatchable", 2).when(F.col("status") == "other_kind", 3).otherwise(4)
    confidence = F.col("confidence") if "confidence" in judged.columns else F.lit(None)
    return judged.select("record_id", "status", "reason", "row", "source", "kind", confidence.cast("string").alias("confidence"), letters.alias("cells"), rank.alias("rank")).orderBy("rank", "record_id")


def inspect(cells: DataFrame, order: DataFrame, sheet: str | None = None) -> tuple[DataFrame, DataFrame, Profile]:
    """(tables, columns, profile) of a workbook; an unknown sheet is an error."""
    visible = cells.join(F.broadcast(order.where("visible").select("sheet")), "sheet", "left_semi")
    spans = layout.data_spans(visible)
    columns = layout.describe_columns(visible, spans)
    if sheet is None:
        best = layout.choose_sheet(layout.scores(spans, columns), order).first()
        if best is None:
            raise ValueError("no sheet looks like a table")
        sheet = best["sheet"]
    elif spans.where(F.col("sheet") == sheet).isEmpty():
        raise ValueError(f"no table on sheet {sheet!r}")
    return spans, columns, mapping.suggest_profile(columns, sheet)


totals, verdict_counts, file_counts = aggregates.totals, aggregates.verdict_counts, aggregates.file_counts
