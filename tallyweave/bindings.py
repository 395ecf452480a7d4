"""The test tables as ledger data, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TXN = """select event_id, user_id, ts, cast(ts as date) as date, event_type || ' user ' || cast(user_id as string) as description,
  cast(case when event_type = 'purchase' then -value else value end as decimal(18,2)) as amount from events"""

#: Even events are the book's rows; some have a reference, some no readable amount.
EXISTING = f"""select cast(event_id as bigint) as row, date, description,
  case when event_id % 14 = 0 then 'REF ' || cast(event_id as string) else '' end as reference,
  case when event_id % 22 = 0 then null else cast(abs(amount) * 100 as bigint) end as amount_cents from ({TXN}) t where event_id % 2 = 0"""

#: Odd events are new; every tenth is an even one replayed with other signs, days, wording, references or no amount.
RECORDS = f"""select event_id as record_id, event_id as input_ord, 'transaction' as kind, 'file' || cast(event_id % 5 as string) as source, date, description, '' as reference, amount,
  case when amount > 0 then amount end as deposit, case when amount < 0 then cast(-amount as decimal(18,2)) end as withdrawal, cast(null as decimal(18,2)) as total, '' as vendor, '' as payee, 1 as page from ({TXN}) t where event_id % 2 = 1
union all
select event_id + 1000000, event_id + 1000000, 'transaction', 'replay', cast(date + interval '1' day * (event_id % 4) as date),
  case when event_id % 3 = 0 then upper(description) || ' - PAYMENT' when event_id % 7 = 0 then 'unrelated wording' else description end,
  case when event_id % 14 = 0 then 'ref-' || cast(event_id as string) when event_id % 16 = 0 then 'ref ' || cast(event_id as string) else '' end,
  case when event_id % 60 = 0 then null when event_id % 210 = 0 then cast(-amount - 1 as decimal(18,2)) else cast(-amount as decimal(18,2)) end, null, null, cast(null as decimal(18,2)), '', '', 2 from ({TXN}) t where event_id % 10 = 0"""

#: Some records are invoices: one an order.
INVOICES = """select o.o_orderkey as record_id, o.o_orderkey as input_ord, 'invoice' as kind, 'orders' as source, cast(o.o_orderdate as date) as date, '' as description,
  'INV-' || cast(o.o_orderkey as string) as reference, cast(null as decimal(18,2)) as amount, cast(null as decimal(18,2)) as deposit, cast(null as decimal(18,2)) as withdrawal,
  cast(o.o_totalprice as decimal(18,2)) as total, 'Customer ' || cast(o.o_custkey as string) as vendor, '' as payee, 1 as page,
  cast(round(o.o_totalprice / 1.1, 2) as decimal(18,2)) as subtotal,
  cast(case when o.o_orderkey % 9 = 0 then 0 else round(o.o_totalprice - round(o.o_totalprice / 1.1, 2), 2) end as decimal(18,2)) as tax from orders o"""

MONEY_TEXT = """select event_id, cents, case event_id % 10 when 0 then d when 1 then '$' || d when 2 then '(' || d || ')' when 3 then d || '-' when 4 then d || ' CR' when 5 then d || ' DR'
  when 6 then '-' || d when 7 then '1,' || lpad(cast(cents % 1000 as string), 3, '0') || '.00' when 8 then replace(d, '.', ',') else 'x' || d end as said from (
  select event_id, cents, cast(cents // 100 as string) || '.' || lpad(cast(cents % 100 as string), 2, '0') as d from (select event_id, cast(round(value * 100) as bigint) as cents from events) a) b"""

DATE_TEXT = """select o_orderkey, cast(o_orderdate as date) as day, case o_orderkey % 4
  when 0 then cast(cast(o_orderdate as date) as string)
  when 1 then cast(month(o_orderdate) as string) || '/' || cast(day(o_orderdate) as string) || '/' || cast(year(o_orderdate) as string)
  when 2 then lpad(cast(month(o_orderdate) as string), 2, '0') || '-' || lpad(cast(day(o_orderdate) as string), 2, '0') || '-' || cast(year(o_orderdate) as string)
  else cast(o_orderkey % 5000 as string) end as said from orders"""

#: One sheet a supplier-like group of orders: a title, a header in row 3, data from row 4, a blank row, totals. Every fifth reference is a number.
SHEET_ORDERS = """select o_orderkey, o_custkey % 7 as s, cast(o_orderdate as date) as day, o_totalprice, o_orderpriority from orders"""
NUMBERED_ORDERS = SHEET_ORDERS.replace(" from orders", ", row_number() over (partition by o_custkey % 7 order by o_orderkey) as n from orders")
CELLS_OF_ORDERS = """h as (select distinct s from o), m as (select s, max(n) as last from o group by s),
c as (
  select s, 1 as row, 1 as col, 's' as vtype, 'Ledger ' || cast(s as string) as v_str, cast(null as double) as v_num, cast(null as date) as v_date, cast(null as string) as formula, 'General' as number_format from h
  union all select s, 3, col, 's', header, null, null, null, 'General' from h cross join (values (1, 'Date'), (2, 'Description'), (3, 'Deposit'), (4, 'Withdrawal'), (5, 'Net'), (6, 'Invoice No')) v(col, header)
  union all select s, 3 + n, case when col = 3 and o_orderkey % 3 = 0 then 4 else col end, case when col = 1 then 'd' when col = 6 and o_orderkey % 5 = 0 then 'n' when col in (2, 6) then 's' when col = 3 then 'n' else 'f' end,
    case when col = 2 then o_orderpriority || ' customer' when col = 6 and o_orderkey % 5 <> 0 then 'REF' || cast(o_orderkey as string) end, case when col = 3 then o_totalprice when col = 6 and o_orderkey % 5 = 0 then cast(o_orderkey * 1000000 as double) end, case when col = 1 then day end,
    case when col = 5 then '=C' || cast(3 + n as string) || '-D' || cast(3 + n as string) end, case when col = 1 then 'yyyy-mm-dd' when col in (3, 5) then '#,##0.00' else 'General' end
    from o cross join (values (1), (2), (3), (5), (6)) v(col)
  union all select s, 5 + last, 2, 's', 'TOTAL', null, null, null, 'General' from m
  union all select s, 5 + last, 3, 'f', null, null, null, '=SUM(C4:C' || cast(3 + last as string) || ')', '#,##0.00' from m)
select 'S' || cast(s as string) as sheet, cast(row as int) as row, cast(col as int) as col, vtype, v_str, v_num, v_date, formula, number_format, number_format || '/' || cast(col as string) as style_sig from c"""
CELLS = f"with o as ({NUMBERED_ORDERS}),\n{CELLS_OF_ORDERS}"

HEADERS = """select * from (values (1, 'Withdrawal'), (2, 'Money In'), (3, 'Invoice No'), (4, 'VAT'), (5, 'Widget colour'), (6, 'Remaining'), (7, 'Transaction Date'), (8, 'Grand Total'),
  (9, 'Company Name'), (10, 'Running Balance'), (11, 'Sub-total'), (12, ''), (13, 'Memo / Notes'), (14, 'Ref.')) h(id, header)"""

#: What a book has besides cells: a height every third row, widths, ranges of each kind and names, for the sheets S0 to S6.
ROW_DIMS = """select 'S' || cast(o_custkey % 7 as string) as sheet, cast(o_orderkey % 5000 as int) as row, min(12.0 + o_orderkey % 30) as height from orders group by o_custkey % 7, o_orderkey % 5000"""

RANGES = """select 'S' || cast(o_custkey % 7 as string) as sheet, case o_orderkey % 5 when 0 then 'merge' when 1 then 'validation' when 2 then 'filter' when 3 then 'print_area' else 'table' end as kind, 'n' || cast(o_orderkey as string) as name,
  case o_orderkey % 5 when 0 then 'A' || cast(1 + o_orderkey % 40 as string) || ':B' || cast(1 + o_orderkey % 40 as string)
    when 1 then 'C4:C' || cast(4 + o_orderkey % 20 as string) || ' E' || cast(12 + o_orderkey % 9 as string)
    when 2 then 'A3:G' || cast(5 + o_orderkey % 20 as string) when 3 then '$A$1:$G$' || cast(5 + o_orderkey % 20 as string) else 'A3:G11' end as ref from orders"""

STATEMENT = f"""select user_id, event_id, ts, amount, case when event_id % 11 = 0 then null else
  cast(sum(amount) over (partition by user_id order by ts, event_id) + case when event_id % 13 = 0 then 1 else 0 end as decimal(18,2)) end as balance from ({TXN}) t"""

FORMULAS = """select o_orderkey as id, case o_orderkey % 6 when 0 then 'D4:D' || cast(4 + o_orderkey % 20 as string) when 1 then 'B' || cast(1 + o_orderkey % 25 as string)
  when 2 then '$A$' || cast(1 + o_orderkey % 9 as string) || ':$G$' || cast(8 + o_orderkey % 12 as string) when 3 then 'C' || cast(12 + o_orderkey % 5 as string) || ':C' || cast(20 + o_orderkey % 5 as string)
  when 4 then 'AA11' else 'A1:B2' end as ref from orders"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def relation(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """A derived relation; tables, and those ``given``, are named with ``spark.sql``'s parameters, so no view is left behind."""
    import re

    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\bfrom {t}\b", sql)} | given
    text = sql.replace("//", " div ")
    for t in used:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **used)
