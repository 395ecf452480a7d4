"""Registered queries over the test tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave import bindings as b
from tallyweave.functions import text as t, values as v
from tallyweave.operators import aggregates, invoices, layout, mapping, matching, sheet, statements, verify
from tallyweave.plans import append
from tallyweave.scratch import numbered, written
from tallyweave.schema import INVOICE_HINTS, NO_AMOUNT, NOISE_TOKENS, STATEMENT_HINTS, SYNONYMS
from tallyweave.sources import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ORD = "case when date is null then 1 else 0 end, date, description, input_ord"


def query(sql: str | None = None, money: tuple[str, ...] = ()):
    """Register a query and its SQL. Columns in ``money`` leave as doubles on both sides, which every client reads alike."""
    def add(f: Query, name: str = "") -> Query:
        name = name or f.__name__
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("double") for c in money})) if money else f
        if sql:
            ORACLES[name] = f"select * replace ({', '.join(f'{c}::DOUBLE as {c}' for c in money)}) from ({sql})" if money else sql
        return f

    return add


# --- SQL fragments for DuckDB -----------------------------------------------

NOISE = ", ".join(f"'{w}'" for w in NOISE_TOKENS)


def norm(c: str) -> str:
    return f"trim(regexp_replace(upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'))"


def toks(c: str) -> str:
    return f"list_filter(list_distinct(string_split({norm(c)}, ' ')), lambda w: length(w) > 1 and w not in ({NOISE}) and not regexp_matches(w, '^[0-9]+$'))"


def likeness(x: str, y: str) -> str:
    both = f"len(list_intersect({toks(x)}, {toks(y)}))::DOUBLE"
    return f"""case when {norm(x)} = '' or {norm(y)} = '' then 0.0::DOUBLE when {norm(x)} = {norm(y)} then 1.0::DOUBLE
  when len({toks(x)}) > 0 and len({toks(y)}) > 0 then greatest({both} / len(list_distinct(list_concat({toks(x)}, {toks(y)}))), {both} / least(len({toks(x)}), len({toks(y)})) * 0.9::DOUBLE) else 0.0::DOUBLE end"""


KEYED = f"""records as ({b.RECORDS}), book as ({b.EXISTING}),
r as (select record_id, input_ord, date, description, {norm('reference')} as ref_key, cast(abs(coalesce(amount, total)) * 100 as bigint) as amount_cents from records),
ref_hit as (select record_id, min(e.row) as ref_row from r join book e on ref_key <> '' and ref_key = {norm('e.reference')} and (r.amount_cents is null or e.amount_cents is null or r.amount_cents = e.amount_cents) group by 1),
pairs as (select record_id, r.date as d, e.date as ed, r.description as rd, coalesce(e.description, '') as edesc, e.row, {likeness('r.description', 'e.description')} as score
  from r join book e on r.amount_cents = e.amount_cents and e.date between r.date - interval 3 day and r.date + interval 3 day),
exact as (select * from (select *, row_number() over (partition by record_id order by row) as k from pairs where d = ed) where k = 1),
near as (select * from (select *, row_number() over (partition by record_id order by score desc, row) as k from pairs where score >= 0.5) where k = 1),
verdicts as (select r.record_id, case when ref_row is not null then 'duplicate' when amount_cents is null then 'unmatchable'
    when x.row is not null then case when x.score >= 0.55 or x.rd = '' or x.edesc = '' then 'duplicate' else 'probable_duplicate' end
    when n.row is not null then 'probable_duplicate' else 'new' end as status,
  coalesce(ref_row, case when amount_cents is not null then coalesce(x.row, n.row) end) as row,
  round(case when ref_row is not null then 1.0 when amount_cents is not null then coalesce(x.score, n.score) end, 4) as score
  from r left join ref_hit h on h.record_id = r.record_id left join exact x on x.record_id = r.record_id left join near n on n.record_id = r.record_id)"""


def keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return matching.keyed(b.relation(spark, d, b.RECORDS)), b.relation(spark, d, b.EXISTING)


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return matching.cascade(*keyed(spark, d), score=t.with_token_score)


# --- matching ----------------------------------------------------------------


@query(f"with {KEYED} select status, count(*) as n from verdicts group by 1")
def audit_counts(spark, d):
    return aggregates.verdict_counts(verdicts(spark, d))


@query(f"with {KEYED} select record_id, status, row, score from verdicts")
def match_cascade(spark, d):
    return verdicts(spark, d).select("record_id", "status", "row", F.round("score", 4).alias("score"))


@query(f"with {KEYED} select record_id, ref_row from ref_hit")
def match_reference(spark, d):
    return matching.reference_tier(*keyed(spark, d))


@query(f"with {KEYED} select record_id, row, round(score, 4) as score from exact")
def match_exact(spark, d):
    return matching.exact_tier(*keyed(spark, d), score=t.with_token_score).select("record_id", F.col("e_row").alias("row"), F.round("score", 4).alias("score"))


@query(f"with {KEYED} select record_id, row, round(score, 4) as score, abs(date_diff('day', d, ed))::INT as gap from near")
def match_near(spark, d):
    return matching.near_tier(*keyed(spark, d), score=t.with_token_score).select("record_id", (-F.col("near.minus_row")).alias("row"), F.round("near.score", 4).alias("score"), "near.gap")


@query(f"with {KEYED} select record_id from verdicts where status = 'unmatchable'")
def match_unmatchable(spark, d):
    return verdicts(spark, d).where("status = 'unmatchable'").select("record_id")


@query(f"with {KEYED} select record_id from verdicts where status = 'new'")
def match_new_anti(spark, d):
    return verdicts(spark, d).where("status = 'new'").select("record_id")


@query(f"with book as ({b.EXISTING}) select count(*) as n_rows, count(*) filter (amount_cents is not null or (date is not null and description <> '')) as n_usable from book")
def existing_usable(spark, d):
    e = b.relation(spark, d, b.EXISTING)
    return e.agg(F.count("*").alias("n_rows"), F.count_if(matching.usable(e)).alias("n_usable"))


@query()
def batch_dedupe(spark, d):
    """In-batch verdicts with the full similarity; tested against a sequential loop."""
    return matching.batch_verdicts(b.relation(spark, d, b.RECORDS), b.relation(spark, d, b.EXISTING))


@query()
def plan_audit(spark, d):
    records = b.relation(spark, d, b.RECORDS).unionByName(b.relation(spark, d, b.INVOICES).drop("subtotal", "tax"))
    return append.audit(records, b.relation(spark, d, b.EXISTING), ["transaction"]).select("record_id", "kind", "status", "row", F.round("score", 4).alias("score"))


@query()
def held_back_flags(spark, d):
    return append.held_back_flags(append.audit(b.relation(spark, d, b.RECORDS), b.relation(spark, d, b.EXISTING), ["transaction"]), "Transactions")


REASONED = f"""{KEYED},
reasoned as (select v.*, case when ref_row is not null then 'same reference' when r.amount_cents is null then '{NO_AMOUNT}'
    when x.row is not null then case when v.status = 'duplicate' then 'same date and amount' else 'same day and amount in other words' end
    when n.row is not null then 'same amount, ' || abs(date_diff('day', n.d, n.ed)) || ' days between, alike in words' else '' end as reason
  from verdicts v join r on r.record_id = v.record_id left join ref_hit h on h.record_id = v.record_id left join exact x on x.record_id = v.record_id left join near n on n.record_id = v.record_id),
judged as (select records.*, status, row, reason from records join reasoned using (record_id))"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """An audit of the batch against the book, by token scores."""
    return b.relation(spark, d, b.RECORDS).join(verdicts(spark, d), "record_id")


@query(f"""with {REASONED} select record_id, status, reason, row, source, kind, date::VARCHAR as a, nullif(description, '') as b, amount::VARCHAR as c,
  case status when 'new' then 0 when 'probable_duplicate' then 1 when 'unmatchable' then 2 else 4 end as rank from judged""")
def audit_rows(spark, d):
    rows = append.audit_rows(judged(spark, d), mapping.Profile("S1", {"A": "date", "B": "description", "C": "amount"}))
    return rows.select("record_id", "status", "reason", "row", "source", "kind", *(F.col("cells")[x.upper()].alias(x) for x in "abc"), "rank")


#: Flags of an extraction: one for each fiftieth event.
GIVEN = "select 'scan' || cast(event_id as string) || '.png' as source, '' as location, 'file' as field, '' as raw, 'An image cannot be read.' as reason, '' as row_key from events where event_id % 50 = 0"


@query(f"""with {REASONED} select '2026-01-01 08:00' as run, source, location, field, raw, reason from (
  select source, location, field, raw, reason from ({GIVEN}) g
  union all
  select source, case when row > 0 then 'row ' || row || ' of ''S1''' else '' end, 'duplicate', concat_ws(' ', date::VARCHAR, substr(description, 1, 40)), 'Held back as a likely duplicate (' || reason || '). Add it by hand if it is another one.' from judged where status = 'probable_duplicate'
  union all
  select source, 'page ' || page, 'amount', substr(description, 1, 60), reason || ' It was not added.' from judged where status = 'unmatchable')""")
def append_notes(spark, d):
    """What the notes sheet gets: the extraction's flags and the plan's own."""
    return append.review_notes(append.all_flags(b.relation(spark, d, GIVEN), judged(spark, d), "S1"), "2026-01-01 08:00")


@query(f"""with c as ({b.CELLS}) select part, json from (
  select 'payload' as part, '{{"status":"nothing_extracted","message":"{append.MESSAGES['nothing_extracted']} Records of other kinds were found.","sheet":"S1","counts":{{"new":0,"duplicate":0,"probable_duplicate":0,"unmatchable":0,"other_kind":'
    || (select count(*) from orders) || ',"flags":' || (select count(*) from ({GIVEN}) g) || '}},"first_new_row":' || (select max(row) + 1 from c where sheet = 'S1' and col = 1) || ',"can_append":false}}' as json
  union all
  select 'flags', '{{"source":"' || source || '","location":"","field":"file","raw":"","reason":"' || reason || '","row_key":""}}' from ({GIVEN}) g)""")
def stopped_payload(spark, d):
    """A run that finds nothing for its sheet still says why, with its flags and counts."""
    profile = mapping.Profile("S1", {"A": "date", "B": "description", "C": "deposit"}, "", ["transaction"])
    plan = append.plan_append(b.relation(spark, d, b.INVOICES).drop("subtotal", "tax"), cells(spark, d), profile, 2026, b.relation(spark, d, GIVEN))
    return append.payload(plan, profile).select(F.lit("payload").alias("part"), "json").unionByName(append.payload_lines(plan, profile).where("part = 'flags'"))


# --- scalars -------------------------------------------------------------------


@query(f"select event_id, cast(abs(amount) * 100 as bigint) as amount_cents from ({b.TXN})")
def cents_normalize(spark, d):
    return b.relation(spark, d, b.TXN).select("event_id", v.cents("amount").alias("amount_cents"))


@query(f"""select event_id, said, case event_id % 10 when 9 then null when 7 then (100000 + (cents % 1000) * 100)::DECIMAL(18,2) / 100
  else case when event_id % 10 in (2, 3, 5, 6) then -cents else cents end / 100.0 end::DECIMAL(18,2) as amount from ({b.MONEY_TEXT})""", money=("amount",))
def parse_money(spark, d):
    return b.relation(spark, d, b.MONEY_TEXT).select("event_id", "said", v.parse_money("said").cast("decimal(18,2)").alias("amount"))


@query(f"select event_id, (event_id % 10 not in (3, 9)) as is_token from ({b.MONEY_TEXT})")
def money_token(spark, d):
    return b.relation(spark, d, b.MONEY_TEXT).select("event_id", v.is_money_token("said").alias("is_token"))


@query(f"select o_orderkey, case when o_orderkey % 4 = 3 then null else day end as parsed from ({b.DATE_TEXT})")
def parse_date(spark, d):
    return b.relation(spark, d, b.DATE_TEXT).select("o_orderkey", v.parse_date_listed("said").alias("parsed"))


@query(f"select o_orderkey, case when o_orderkey % 4 = 3 then null else day end as parsed from ({b.DATE_TEXT})")
def parse_date_exact(spark, d):
    return b.relation(spark, d, b.DATE_TEXT).select("o_orderkey", v.parse_date(F.col("said"), F.lit(False), F.lit(2026)).alias("parsed"))


@query(f"""with s as (select o_orderkey % 50 as source, o_orderkey as ord, try_cast(nullif(regexp_extract(said, '^\\s*(\\d{{1,2}})[/-](\\d{{1,2}})[/-]', 1), '') as int) as x,
  try_cast(nullif(regexp_extract(said, '^\\s*(\\d{{1,2}})[/-](\\d{{1,2}})[/-]', 2), '') as int) as y from ({b.DATE_TEXT}))
select source, coalesce(arg_min(x > 12, ord) filter ((x > 12 and y <= 12) or (y > 12 and x <= 12)), false) as dayfirst from s group by 1""")
def infer_dayfirst(spark, d):
    s = b.relation(spark, d, b.DATE_TEXT).select((F.col("o_orderkey") % 50).alias("source"), F.col("o_orderkey").alias("ord"), F.col("said").alias("sample"))
    return v.infer_dayfirst(s, ["source"])


@query(f"""select x.event_id, y.event_id as other, round({likeness('x.description', 'y.description')}, 4) as score from ({b.TXN}) x join ({b.TXN}) y on y.event_id = x.event_id + 7""")
def token_similarity(spark, d):
    x = b.relation(spark, d, b.TXN).select("event_id", "description")
    y = b.relation(spark, d, b.TXN).select(F.col("event_id").alias("other"), F.col("description").alias("wording"))
    return x.join(y, F.col("other") == F.col("event_id") + 7).select("event_id", "other", F.round(t.token_similarity("description", "wording"), 4).alias("score"))


@query(f"""with r as (select record_id, kind, date, description, vendor, reference, amount, total from ({b.RECORDS}) union all select record_id + 5000000, kind, date, description, vendor, reference, amount, total from ({b.INVOICES}))
select record_id, substr(sha1(kind || '|' || coalesce(date::VARCHAR, '') || '|' || upper(trim(regexp_replace(case when coalesce(description, '') <> '' then description else coalesce(vendor, '') end, '\\s+', ' ', 'g'))) || '|' ||
  upper(trim(regexp_replace(coalesce(reference, ''), '\\s+', ' ', 'g'))) || '|' || coalesce(coalesce(amount, total)::VARCHAR, '')), 1, 16) as fingerprint from r""")
def fingerprint(spark, d):
    cols = ["record_id", "kind", "date", "description", "vendor", "reference", "amount", "total"]
    r = b.relation(spark, d, b.RECORDS).select(*cols).union(b.relation(spark, d, b.INVOICES).withColumn("record_id", F.col("record_id") + 5000000).select(*cols))
    return r.select("record_id", t.fingerprint().alias("fingerprint"))


@query(f"""select record_id, coalesce(amount, case when kind = 'invoice' then total end) as amount, coalesce(total, amount) as total, coalesce(withdrawal, case when kind = 'invoice' then total end) as withdrawal,
  coalesce(nullif(vendor, ''), nullif(payee, ''), nullif(description, '')) as vendor, coalesce(nullif(payee, ''), nullif(vendor, ''), nullif(description, '')) as payee, coalesce(nullif(description, ''), nullif(vendor, '')) as description, nullif(reference, '') as reference
  from (select * from ({b.RECORDS}) union all select * exclude (subtotal, tax) from ({b.INVOICES}))""", money=("amount", "total", "withdrawal",))
def value_for(spark, d):
    r = b.relation(spark, d, b.RECORDS).unionByName(b.relation(spark, d, b.INVOICES).drop("subtotal", "tax"))
    return r.select("record_id", *[mapping.value_for(f).alias(f) for f in ("amount", "total", "withdrawal", "vendor", "payee", "description", "reference")])


@query("""select event_id, case when event_id % 3 = 0 and event_id >= 10 then 'A' || event_id else '' end as reference, case when event_id % 2 = 0 then 2000 + (event_id % 30)::INT end as year from events""")
def reference_extract(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(
        F.lit("paid "), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Chq: A"), F.col("event_id"))).otherwise("none"), F.lit(" in "),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(""), F.lit(2000) + F.col("event_id") % 30)).otherwise("x"), F.lit(" end")).alias("s"))
    e = e.withColumn("s", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("of "), (F.lit(2000) + F.col("event_id") % 30).cast("string"), F.lit(" "), F.col("s"))).otherwise(F.concat(F.lit("of x"), F.col("s"))))
    return e.select("event_id", t.reference_in("s").alias("reference"), t.year_in("s").alias("year"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Written once, as layout, mapping and insertion pass over it several times.

    A sheet's rows are numbered by a sort by ranges, as a window would hold each of the seven sheets in one task.
    """
    o = numbered(b.relation(spark, d, b.SHEET_ORDERS), [F.col("s"), F.col("o_orderkey")])
    before = o.groupBy(F.col("s").alias("of")).agg(F.min("position").alias("before"))
    o = o.join(F.broadcast(before), F.col("s").eqNullSafe(F.col("of"))).withColumn("n", (F.col("position") - F.col("before") + 1).cast("int"))
    return written(b.relation(spark, d, f"with {b.CELLS_OF_ORDERS}", o=o.drop("position", "of", "before")), "cells")


# --- layout and mapping -----------------------------------------------------


@query(f"with c as ({b.CELLS}) select distinct sheet, 3 as header_row from c")
def header_row(spark, d):
    return layout.header_rows(cells(spark, d))


@query(f"""with c as ({b.CELLS}), m as (select sheet, max(row) filter (vtype = 'd') as last from c group by 1)
select sheet, 3 as header_row, 1 as first_col, 6 as last_col, 4 as first_data_row, last as last_data_row, (last + 2)::VARCHAR as total_rows, last - 3 as row_count from m""")
def data_span(spark, d):
    return layout.data_spans(cells(spark, d)).withColumn("total_rows", F.array_join("total_rows", ","))


@query(f"with c as ({b.CELLS}), m as (select sheet, max(row) filter (vtype = 'd') - 3 as n from c group by 1) select sheet, (12 + least(n, 200) * 0.5)::DOUBLE as score from m")
def sheet_score(spark, d):
    c = cells(spark, d)
    spans = layout.data_spans(c)
    return layout.scores(spans, layout.describe_columns(c, spans))


@query(f"""with c as ({b.CELLS}), m as (select sheet, max(row) filter (vtype = 'd') - 3 as n from c group by 1), s as (select sheet, (12 + least(n, 200) * 0.5)::DOUBLE as score from m) select sheet, score from s order by score desc, sheet limit 1""")
def choose_sheet(spark, d):
    c = cells(spark, d)
    order = c.select("sheet").distinct().withColumn("sheet_ord", F.expr("cast(substr(sheet, 2) as int)")).withColumn("visible", F.lit(True))
    spans = layout.data_spans(c)
    return layout.choose_sheet(layout.scores(spans, layout.describe_columns(c, spans)), order)


@query(f"""with c as ({b.CELLS}), m as (select sheet, max(row) filter (vtype = 'd') as last from c group by 1)
select sheet, col::INT as col, letter, header, case when col = 5 then '=C' || last || '-D' || last end as formula_template, col = 5 as is_computed,
  case when col = 3 or col = 4 then coalesce((select max(number_format) from c where c.sheet = m.sheet and c.row = 4 and c.col = v.col), 'General') else fmt end as number_format,
  case when col = 1 then 'date' when col = 5 then 'money' when col in (3, 4) then case when exists (select 1 from c where c.sheet = m.sheet and c.row = 4 and c.col = v.col) then 'money' else 'number' end when col = 6 and exists (select 1 from c where c.sheet = m.sheet and c.col = 6 and c.row between 4 and least(m.last, 29) and c.vtype = 'n') then 'number' else 'text' end as inferred_type
from m cross join (values (1, 'A', 'Date', 'yyyy-mm-dd'), (2, 'B', 'Description', 'General'), (3, 'C', 'Deposit', ''), (4, 'D', 'Withdrawal', ''), (5, 'E', 'Net', '#,##0.00'), (6, 'F', 'Invoice No', 'General')) v(col, letter, header, fmt)""")
def column_types(spark, d):
    c = cells(spark, d)
    return layout.describe_columns(c, layout.data_spans(c)).select("sheet", "col", "letter", "header", "formula_template", "is_computed", "number_format", "inferred_type")


WORDS = ", ".join(f"({i}, {j}, '{f}', '{w}')" for i, (f, words) in enumerate(SYNONYMS.items()) for j, w in enumerate(words))


@query(f"""with h as (select id, header, regexp_replace(lower(header), '[^a-z0-9]+', '', 'g') as k from ({b.HEADERS})), w as (select * from (values {WORDS}) w(fo, wo, field, word)),
g as (select id, field, row_number() over (partition by id order by case when k = word then 0 else 1 end, case when k = word then 0 else -length(word) end, fo, wo) as n from h join w on k <> '' and (contains(k, word) or contains(word, k)))
select h.id, h.header, g.field from h left join g on g.id = h.id and g.n = 1""")
def guess_field(spark, d):
    return mapping.guess_fields(b.relation(spark, d, b.HEADERS)).select("id", "header", "field")


@query(f"""with c as ({b.CELLS}) select sheet, col::INT as col, letter, field, case when col = 1 then 'yyyy-mm-dd' else '' end as date_format from (select distinct sheet from c)
  cross join (values (1, 'A', 'date'), (2, 'B', 'description'), (3, 'C', 'deposit'), (4, 'D', 'withdrawal'), (6, 'F', 'reference')) v(col, letter, field)""")
def suggest_profile(spark, d):
    c = cells(spark, d)
    return mapping.suggest_columns(layout.describe_columns(c, layout.data_spans(c)))


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'transaction,invoice' when o_orderkey % 4 = 1 then 'invoice' when o_orderkey % 4 = 2 then 'transaction' else 'transaction,invoice' end as kinds from orders""")
def kinds_for(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.split(F.when(F.col("o_orderkey") % 4 == 0, "date").when(F.col("o_orderkey") % 4 == 1, "date,vendor,total").when(F.col("o_orderkey") % 4 == 2, "deposit,date").otherwise("tax,balance"), ",").alias("f"))
    return o.select("o_orderkey", F.array_join(mapping.kinds_for(F.col("f")), ",").alias("kinds"))


EXISTING_ROWS = f"""with c as ({b.CELLS}) select sheet, row::BIGINT as row, max(v_date) as date, max(v_str) filter (col = 2) as description, max(coalesce(v_str, v_num::BIGINT::VARCHAR)) filter (col = 6) as reference,
  round_even(abs(coalesce(max(v_num) filter (col = 3), 0)::DECIMAL(18,2) - coalesce(max(v_num) filter (col = 4), 0)::DECIMAL(18,2)) * 100, 0)::BIGINT as amount_cents from c where row > 3 group by 1, 2 having max(v_date) is not null"""


@query(EXISTING_ROWS)
def existing_rows(spark, d):
    """Rows of all sheets of the book; a fifth of the references are stored as numbers."""
    c = cells(spark, d)
    spans = layout.data_spans(c)
    return sheet.existing_rows_of(c, mapping.suggest_columns(layout.describe_columns(c, spans)), spans, 2026)


# --- inserting and proving ------------------------------------------------------


@query(f"with c as ({b.CELLS}) select sheet, (case when sheet = 'S1' and row >= 12 then row + 3 else row end)::INT as row, col, vtype, v_str, v_num, v_date, formula from c")
def row_shift(spark, d):
    return sheet.insert_rows(cells(spark, d), "S1", 12, 3).select("sheet", "row", "col", "vtype", "v_str", "v_num", "v_date", "formula")


@query(f"""with f as (select id, ref, regexp_extract(ref, '^(\\$?[A-Z]+\\$?)(\\d+)', 1) as c1, regexp_extract(ref, '^(\\$?[A-Z]+\\$?)(\\d+)', 2)::INT as r1, regexp_extract(ref, ':(\\$?[A-Z]+\\$?)(\\d+)$', 1) as c2, try_cast(nullif(regexp_extract(ref, ':(\\$?[A-Z]+\\$?)(\\d+)$', 2), '') as INT) as r2 from ({b.FORMULAS}))
select id, ref, case when r2 is null then c1 || (case when r1 >= 12 then r1 + 3 else r1 end) when r1 >= 12 then c1 || (r1 + 3) || ':' || c2 || (r2 + 3) when r2 >= 11 then c1 || r1 || ':' || c2 || (r2 + 3) else ref end as moved from f""")
def range_grow(spark, d):
    from tallyweave.operators.formulas import shift_range

    return b.relation(spark, d, b.FORMULAS).select("id", "ref", shift_range(F.col("ref"), 12, 3).alias("moved"))


@query(f"""with f as (select id, ref, regexp_extract(ref, '^(\\$?[A-Z]+\\$?)(\\d+)', 1) as c1, regexp_extract(ref, '^(\\$?[A-Z]+\\$?)(\\d+)', 2)::INT as r1, regexp_extract(ref, ':(\\$?[A-Z]+\\$?)(\\d+)$', 1) as c2, try_cast(nullif(regexp_extract(ref, ':(\\$?[A-Z]+\\$?)(\\d+)$', 2), '') as INT) as r2 from ({b.FORMULAS}))
select id, '=SUM(' || case when r2 is null then c1 || (case when r1 >= 12 then r1 + 3 else r1 end) when r1 >= 12 then c1 || (r1 + 3) || ':' || c2 || (r2 + 3) when r2 >= 11 then c1 || r1 || ':' || c2 || (r2 + 3) else ref end || ')' as moved from f""")
def formula_repoint(spark, d):
    from tallyweave.operators.formulas import shift_for_insert

    return b.relation(spark, d, b.FORMULAS).select("id", shift_for_insert(F.concat(F.lit("=SUM("), "ref", F.lit(")")), F.lit("L"), "L", 12, 3).alias("moved"))


@query(f"with c as ({b.CELLS}) select sheet, row, col, '=C' || (row + 5) || '-D' || (row + 5) as filled from c where col = 5 and vtype = 'f'")
def fill_down(spark, d):
    from tallyweave.operators.formulas import translate_rows

    return cells(spark, d).where("col = 5 and vtype = 'f'").select("sheet", "row", "col", translate_rows(F.col("formula"), F.lit(5)).alias("filled"))


@query(f"""with c as ({b.CELLS}) select sheet, row, col, 'value changed' as problem from c where row % 10 = 0 and vtype = 'n'
union all select sheet, row, col, 'formatting changed' from c where row % 15 = 0 and col = 2""")
def verify_diff(spark, d):
    c = cells(spark, d)
    after = sheet.insert_rows(c, "S1", 12, 3)
    old_row = F.when((F.col("sheet") == "S1") & (F.col("row") >= 15), F.col("row") - 3).otherwise(F.col("row"))
    broken = after.withColumn("v_num", F.when((old_row % 10 == 0) & (F.col("vtype") == "n"), F.col("v_num") + 1).otherwise(F.col("v_num"))).withColumn(
        "style_sig", F.when((old_row % 15 == 0) & (F.col("col") == 2), "other").otherwise(F.col("style_sig")))
    return verify.differences(c, broken, "S1", 12, 3)


# --- totals ------------------------------------------------------------------------

BOTH = f"(select kind, deposit, withdrawal, amount, total from ({b.RECORDS}) union all select kind, deposit, withdrawal, amount, total from ({b.INVOICES}))"


@query(f"""select coalesce(sum(deposit), 0)::DECIMAL(28,2) as money_in, coalesce(sum(withdrawal), 0)::DECIMAL(28,2) as money_out, coalesce(sum(total) filter (kind = 'invoice'), 0)::DECIMAL(28,2) as invoice_total,
  coalesce(sum(coalesce(amount, total)), 0)::DECIMAL(28,2) as total_added, count(*) filter (kind = 'invoice') as invoices, count(*) filter (kind = 'transaction') as transactions from {BOTH}""", money=("money_in", "money_out", "invoice_total", "total_added",))
def totals_after_append(spark, d):
    cols = ["kind", "deposit", "withdrawal", "amount", "total"]
    return aggregates.totals(b.relation(spark, d, b.RECORDS).select(*cols).union(b.relation(spark, d, b.INVOICES).select(*cols)))


@query(f"select source, count(*) as n, string_agg(distinct kind, ',') as kinds from ({b.RECORDS}) group by 1")
def file_counts(spark, d):
    return aggregates.file_counts(b.relation(spark, d, b.RECORDS))


@query(f"select kind, count(*) as n from {BOTH} where kind = 'invoice' group by 1")
def split_by_kind(spark, d):
    cols = ["kind", "deposit", "withdrawal", "amount", "total"]
    both = b.relation(spark, d, b.RECORDS).select(*cols).union(b.relation(spark, d, b.INVOICES).select(*cols))
    return append.split_by_kind(both, ["transaction"])[1].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""select record_id, (row_number() over (order by {ORD}) - 1)::INT as position from ({b.RECORDS})""")
def append_order(spark, d):
    return append.placed(b.relation(spark, d, b.RECORDS).withColumn("status", F.lit("new"))).select("record_id", "position")


# --- documents -----------------------------------------------------------------------


@query(f"""select user_id, event_id, previous_balance, balance - previous_balance as implied, coalesce(abs(abs(balance - previous_balance) - abs(amount)) > 0.01, false) as off from (
  select *, last_value(balance ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as previous_balance from ({b.STATEMENT}))""", money=("previous_balance", "implied",))
def balance_reconcile(spark, d):
    r = statements.reconcile(b.relation(spark, d, b.STATEMENT), "user_id", ["ts", "event_id"])
    return r.select("user_id", "event_id", "previous_balance", "implied", "off")


@query(f"""select record_id, subtotal, tax, total, coalesce(abs(subtotal + tax - total) > 0.02, false) as off from ({b.INVOICES})""", money=("subtotal", "tax", "total",))
def invoice_check(spark, d):
    return b.relation(spark, d, b.INVOICES).select("record_id", "subtotal", "tax", "total", invoices.arithmetic_off(F.col("subtotal"), F.col("tax"), F.col("total")).alias("off"))


@query("""select doc_id, case when doc_id % 3 = 1 and doc_id % 2 = 0 then 'invoice' when doc_id % 3 = 0 then 'statement' when doc_id % 3 = 1 then 'invoice' else 'invoice' end as doc_kind from documents""")
def classify_docs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    said = docs.withColumn("text", F.concat(F.when(F.col("doc_id") % 3 == 0, "Account statement: deposits, withdrawals\n").when(F.col("doc_id") % 3 == 1, "Tax invoice, amount due\n").otherwise(""),
                                            F.regexp_replace("text", f"{STATEMENT_HINTS}|{INVOICE_HINTS[4:]}", " ")))
    return statements.classify(said).select("doc_id", "doc_kind")


@query("""select p.page_id as page_id, case when page_id % 4 = 0 then 'pdf' when page_id % 4 = 1 then 'manual' when page_id % 4 = 2 then 'image' else 'unsupported' end as route from pages p""")
def route_files(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("/in/f"), "page_id", F.element_at(F.array(*map(F.lit, (".PDF", ".json", ".jpeg", ".docx"))), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    return documents.route(p).select("page_id", "route")


@query(f"""select event_id as record_id, 1::BIGINT as input_ord, 'transaction' as kind, 'f' || event_id as source, date, description, amount from ({b.TXN}) where event_id % 10 <> 0""", money=("amount",))
def manual_json(spark, d):
    e = b.relation(spark, d, b.TXN).select("event_id", F.concat(F.lit("f"), "event_id").alias("name"), F.when(F.col("event_id") % 2 == 0, F.lit(1)).otherwise(0).alias("wrap"), F.to_json(F.array(F.struct(
        F.col("date").cast("string").alias("date"), "description", F.when(F.col("event_id") % 10 == 0, F.lit("much")).otherwise(F.col("amount").cast("string")).alias("amount"), F.lit("x").alias("unknown")))).alias("list"))
    files = e.select("name", F.when(F.col("wrap") == 1, F.concat(F.lit('{"records":'), "list", F.lit("}"))).otherwise(F.col("list")).alias("value"))
    records, _ = documents.manual_entries(files)
    return records.select(F.substring(F.col("source"), 2, 20).cast("long").alias("record_id"), "input_ord", "kind", "source", "date", "description", "amount")


def invoice_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order as four lines of words: a heading, subtotal, tax and total."""
    o = b.relation(spark, d, b.INVOICES)
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(label), c.cast("string")).alias("text")) for i, (label, c) in enumerate(
        (("Invoice No: ", F.col("reference")), ("Subtotal ", F.col("subtotal")), ("VAT 20% ", F.col("tax")), ("Total due ", F.col("total"))), 1)])
    one = o.select(F.col("record_id").cast("string").alias("source"), F.explode(lines).alias("l")).select("source", "l.*")
    return one.withColumn("words", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text")))).withColumn("size", F.lit(10.0))


@query(f"""select record_id::VARCHAR as source, total, tax, subtotal from ({b.INVOICES})""", money=("total", "tax", "subtotal",))
def labelled_amounts(spark, d):
    return invoices.labelled_amounts(invoice_lines(spark, d)).select("source", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("total", "tax", "subtotal")])


@query(f"select record_id::VARCHAR as source, reference as number from ({b.INVOICES})")
def invoice_numbers(spark, d):
    return statements.bodies(invoice_lines(spark, d)).select("source", invoices.invoice_number("text").alias("number"))


def statement_words(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a statement of positioned words: a caption line, then a line an event, 50 lines a page.

    An amount of 0 is neither paid in nor out: it stands to the right of all captions.
    """
    s = b.relation(spark, d, b.STATEMENT).withColumn("n", F.expr("row_number() over (partition by user_id order by ts, event_id)"))
    captions = F.array(*[F.struct(F.lit(w).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 40)).alias("x1")) for w, x in (("Date", 60), ("Description", 120), ("Withdrawal", 360), ("Deposit", 430), ("Balance", 505))])
    head = s.select("user_id").distinct().select(F.col("user_id").cast("string").alias("source"), F.lit(1).alias("page"), F.lit(10.0).alias("top"), F.posexplode(captions).alias("word_id", "w"))
    money = F.col("amount").isNotNull()
    cells = F.array_compact(F.array(
        F.struct(F.date_format("ts", "MM/dd/yyyy").alias("text"), F.lit(60.0).alias("x0"), F.lit(110.0).alias("x1")),
        F.struct(F.concat(F.lit("EVENT"), "event_id").alias("text"), F.lit(120.0).alias("x0"), F.lit(200.0).alias("x1")),
        F.when(money & (F.col("amount") < 0), F.struct(F.format_number(-F.col("amount"), 2).alias("text"), F.lit(370.0).alias("x0"), F.lit(400.0).alias("x1"))),
        F.when(money & (F.col("amount") > 0), F.struct(F.format_number("amount", 2).alias("text"), F.lit(440.0).alias("x0"), F.lit(470.0).alias("x1"))),
        F.when(money & (F.col("amount") == 0), F.struct(F.format_number("amount", 2).alias("text"), F.lit(600.0).alias("x0"), F.lit(630.0).alias("x1"))),
        F.when(F.col("balance").isNotNull(), F.struct(F.when(F.col("balance") < 0, F.concat(F.lit("("), F.format_number(-F.col("balance"), 2), F.lit(")"))).otherwise(F.format_number("balance", 2)).alias("text"), F.lit(515.0).alias("x0"), F.lit(545.0).alias("x1")))))
    body = s.select(F.col("user_id").cast("string").alias("source"), F.expr("cast(n div 50 + 1 as int)").alias("page"), (F.lit(10.0) + F.col("n") % 50 * 12).alias("top"), F.posexplode(cells).alias("word_id", "w"))
    return head.unionByName(body).select("source", "page", "word_id", "w.text", "w.x0", "w.x1", "top", F.lit(9.0).alias("size"))


@query(f"""select user_id::VARCHAR as source, cast(ts as date) as date, 'EVENT' || event_id as description, amount, balance, case when amount > 0 then amount end as deposit, case when amount < 0 then (-amount)::DECIMAL(18,2) end as withdrawal from ({b.STATEMENT})""", money=("amount", "balance", "deposit", "withdrawal",))
def statement_records(spark, d):
    records, _ = statements.parse_statements(statements.group_lines(statement_words(spark, d)), 2024)
    return records.select("source", "date", "description", "amount", "balance", "deposit", "withdrawal")


@query(f"""select u.source, role, x0::DOUBLE as x0, x1::DOUBLE as x1, ord::INT as ord from (select distinct user_id::VARCHAR as source from ({b.STATEMENT})) u
  cross join (values ('date', 40, 110, 1), ('description', 110, 260, 2), ('withdrawal', 260, 415, 3), ('deposit', 415, 487.5, 4), ('balance', 487.5, 575, 5)) v(role, x0, x1, ord)""")
def statement_anchors(spark, d):
    return statements.find_anchors(statements.lines_of(statements.group_lines(statement_words(spark, d))))


def fingerprint_sql(columns: str = "") -> str:
    return f"""substr(sha1(kind || '|' || coalesce(date::VARCHAR, '') || '|' || upper(trim(regexp_replace(case when coalesce(description, '') <> '' then description else coalesce(vendor, '') end, '\\s+', ' ', 'g'))) || '|' ||
  upper(trim(regexp_replace(coalesce(reference, ''), '\\s+', ' ', 'g'))) || '|' || coalesce(coalesce(amount, total)::VARCHAR, '')), 1, 16)"""


@query(f"""select {fingerprint_sql()} as fingerprint, '2026-01-01T00:00' as added, source, date, coalesce(amount, total) as amount from ({b.RECORDS})""", money=("amount",))
def state_rows(spark, d):
    return append.state_rows(b.relation(spark, d, b.RECORDS), "2026-01-01T00:00")


# --- what moves with an append --------------------------------------------------------


def shifted(part: str) -> str:
    """SQL of one part of a range of sheet S1 after 3 rows are put in above row 12."""
    c1, r1, c2, r2 = (f"regexp_extract({part}, '^(\\$?[A-Z]+\\$?)(\\d+)(?::(\\$?[A-Z]+\\$?)(\\d+))?$', {k})" for k in (1, 2, 3, 4))
    a, z = f"{r1}::INT", f"try_cast(nullif({r2}, '') as INT)"
    return f"""case when {z} is null then {c1} || case when {a} >= 12 then {a} + 3 else {a} end when {a} >= 12 then {c1} || ({a} + 3) || ':' || {c2} || ({z} + 3) when {z} >= 11 then {c1} || {a} || ':' || {c2} || ({z} + 3) else {part} end"""


@query(f"""with r as ({b.RANGES}) select sheet, kind, name, case when sheet <> 'S1' then ref else array_to_string(list_transform(string_split(ref, ' '), lambda p: {shifted('p')}), ' ') end as ref from r""")
def append_ranges(spark, d):
    return sheet.repair_ranges(b.relation(spark, d, b.RANGES), "S1", 12, 3)


NAMES = f"select name, case when kind = 'merge' then sheet end as sheet, case when kind = 'merge' then ref else sheet || '!' || ref end as ref from ({b.RANGES}) n where kind <> 'validation'"


@query(f"""with n as ({NAMES}), p as (select *, case when contains(ref, '!') then split_part(ref, '!', 1) else sheet end as target, case when contains(ref, '!') then split_part(ref, '!', 2) else ref end as bare from n)
select name, sheet, case when target <> 'S1' then ref else case when contains(ref, '!') then 'S1!' else '' end || {shifted('bare')} end as ref from p""")
def append_names(spark, d):
    return sheet.repoint_names(b.relation(spark, d, NAMES), "S1", 12, 3).drop("repointed")


@query(f"""select sheet, (case when sheet = 'S1' and row >= 12 then row + 3 else row end)::INT as row, height::DOUBLE as height from ({b.ROW_DIMS})""")
def append_dimensions(spark, d):
    return sheet.insert_rows(b.relation(spark, d, b.ROW_DIMS), "S1", 12, 3).withColumn("height", F.col("height").cast("double"))


@query(f"""select sheet, row, 'height changed' as problem from ({b.ROW_DIMS}) where row % 7 = 0 or (sheet = 'S2' and row % 11 = 0)""")
def verify_dimensions(spark, d):
    """Heights after an append that went wrong: every seventh is another, some rows are missing."""
    before = b.relation(spark, d, b.ROW_DIMS)
    after = sheet.insert_rows(before.withColumn("height", F.when(F.col("row") % 7 == 0, F.col("height") + 1).otherwise(F.col("height"))).where("not (sheet = 'S2' and row % 11 = 0)"), "S1", 12, 3)
    return verify.dimension_differences(before, after, "S1", 12, 3)


@query(f"""with r as ({b.RANGES}) select sheet, name, ref, 'range differs' as problem from r where right(name, 2) = '77' or (sheet = 'S1' and right(name, 1) = '4' and {shifted("string_split(ref, ' ')[1]")} || case when contains(ref, ' ') then ' ' || {shifted("string_split(ref, ' ')[2]")} else '' end <> ref)""")
def verify_ranges(spark, d):
    """Ranges after an append that lost some and left others where they were."""
    before = b.relation(spark, d, b.RANGES)
    stale = F.col("name").endswith("4")
    after = sheet.repair_ranges(before.where(~stale), "S1", 12, 3).unionByName(before.where(stale)).where("name not like '%77'")
    return verify.ref_differences(before, after, "S1", 12, 3)


# --- whole invoices ----------------------------------------------------------------------

#: Each order as an invoice: every seventh has no labelled total, every fifth no date that can be read, every eleventh no number.
SOURCE = "record_id::VARCHAR"
INVOICE_SQL = f"""select record_id::VARCHAR as source, replace(vendor, ' ', ' No') as vendor, case when record_id % 11 = 0 then '' else reference end as reference, case when record_id % 5 = 0 then null else date end as date,
  case when record_id % 7 = 0 then greatest(subtotal, tax) else total end as total, tax, subtotal, 'Goods K' || record_id || '; Carriage' as description,
  case when record_id % 7 = 0 then abs(subtotal + tax - greatest(subtotal, tax)) > 0.02 else abs(subtotal + tax - total) > 0.02 end as off from ({b.INVOICES})"""


def whole_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Lines of words: a large vendor line, heading, number, two dates, items, and the amounts."""
    o = b.relation(spark, d, b.INVOICES)
    k = F.col("record_id")
    said = [(F.lit("INVOICE"), 10.0), (F.replace(F.col("vendor"), F.lit(" "), F.lit(" No")), 16.0), (F.when(k % 11 != 0, F.concat(F.lit("Invoice No: "), "reference")), 10.0), (F.lit("Due date: 01/31/2031"), 10.0),
            (F.concat(F.lit("Invoice date: "), F.when(k % 5 == 0, "soon enough").otherwise(F.date_format("date", "MM/dd/yyyy"))), 10.0), (F.lit("Description Qty Amount"), 10.0), (F.concat(F.lit("Goods K"), k, F.lit(" 3 "), F.lit("0.01")), 10.0), (F.lit("Carriage 0.02"), 10.0),
            (F.concat(F.lit("Subtotal "), F.format_number("subtotal", 2)), 10.0), (F.concat(F.lit("VAT 20% "), F.format_number("tax", 2)), 10.0), (F.when(k % 7 != 0, F.concat(F.lit("Total due "), F.format_number("total", 2))), 10.0)]
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), c.alias("text"), F.lit(size).alias("size")) for i, (c, size) in enumerate(said, 1)])
    one = o.select(k.cast("string").alias("source"), F.explode(lines).alias("l")).select("source", "l.*").where("text is not null")
    return one.withColumn("words", F.arrays_zip(F.split("text", " ").alias("text")))


@query(INVOICE_SQL, money=("total", "tax", "subtotal"))
def invoice_records(spark, d):
    records, _ = invoices.parse_invoices(whole_invoices(spark, d), 2026)
    return records.select("source", "vendor", "reference", "date", "total", "tax", "subtotal", "description", (F.col("confidence") == "uncertain").alias("off"))


@query(f"""with i as ({INVOICE_SQL}) select source, 'invoice date' as field from i where date is null union all select source, 'date' from i where date is null union all select source, 'total' from i where source::BIGINT % 7 = 0
  union all select source, 'total' from i where off union all select source, 'invoice number' from i where reference = '' union all select source, 'total' from i where coalesce(total, 0) = 0""")
def invoice_flags(spark, d):
    return invoices.parse_invoices(whole_invoices(spark, d), 2026)[1].select("source", "field")


@query(f"select record_id::VARCHAR as source, replace(vendor, ' ', ' No') as vendor from ({b.INVOICES})")
def invoice_vendors(spark, d):
    return invoices.vendors(whole_invoices(spark, d))


@query(f"select record_id::VARCHAR as source, case when record_id % 5 = 0 then null else date end as date, case when record_id % 5 = 0 then 'soon enough' end as unread from ({b.INVOICES})")
def invoice_dates(spark, d):
    return invoices.invoice_dates(whole_invoices(spark, d), 2026)


@query(f"select record_id::VARCHAR as source, 'Goods K' || record_id || '|Carriage' as items from ({b.INVOICES})")
def invoice_items(spark, d):
    return invoices.line_items(whole_invoices(spark, d)).select("source", F.array_join("line_items", "|").alias("items"))


@query("select 'p' || page_id || '.pdf' as source from pages where page_id % 3 = 0")
def scan_flags(spark, d):
    """Every third page is a file without words."""
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("p"), "page_id", F.lit(".pdf")).alias("source"), "page_id")
    return documents.scan_flags(p, p.where("page_id % 3 <> 0").select("source")).select("source")
