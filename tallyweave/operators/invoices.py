"""Invoices from lines of positioned words: one record a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import fingerprint, strip
from tallyweave.functions.values import dayfirst_of, infer_dayfirst, is_money_token, money_word, parse_any_date, parse_any_dates, parse_money
from tallyweave.scratch import written
from tallyweave.schema import DATE_LABEL, INVOICE_NUMBER, ITEM_HEADER, MOST_ITEMS, NEEDED, OTHER_DATE, TOTAL_LABELS, VENDOR_LINES, VENDOR_NOISE


def says(pattern: str) -> Column:
    """Whether the line has the pattern, which is only looked for where one of its words is."""
    low = F.lower("text")
    some = F.lit(False)
    for w in NEEDED[pattern]:
        some = some | low.contains(w)
    return some & F.col("text").rlike(pattern)


def invoice_number(body: Column | str) -> Column:
    """The first labelled id in the text."""
    b = F.col(body) if isinstance(body, str) else body
    return F.regexp_replace(F.regexp_extract(b, INVOICE_NUMBER, 1), "^[ .,:]+|[ .,:]+$", "")


def may_be_vendor(stripped: Column) -> Column:
    return (F.col("line_no") <= VENDOR_LINES) & (stripped != "") & ~stripped.rlike(VENDOR_NOISE)


def prominence() -> Column:
    return F.struct(F.coalesce("size", F.lit(0.0)).alias("size"), (-F.col("line_no")).alias("above"))


def vendors(lines: DataFrame) -> DataFrame:
    """(source, vendor): the largest of the first lines that is no heading, the first of equals."""
    return lines.where(may_be_vendor(strip("text"))).groupBy("source").agg(F.max_by(strip("text"), prominence()).alias("vendor"))


def dated() -> Column:
    """A line with a date label that is not a due date's."""
    return says(DATE_LABEL) & ~F.col("text").rlike(OTHER_DATE)


def said_date() -> Column:
    """What follows the date label."""
    return F.regexp_replace(F.regexp_extract("text", DATE_LABEL, 2), "^[ :#]+|[ :#]+$", "")


def invoice_dates(lines: DataFrame, as_of_year: int) -> DataFrame:
    """(source, date, unread): the first labelled date that is not a due date; else the last label's text that could not be read."""
    dayfirst = infer_dayfirst(lines.select("source", F.col("line_no").alias("ord"), F.col("text").alias("sample")), ["source"])
    labelled = lines.where(dated()).join(dayfirst, "source")
    read = labelled.withColumn("raw", said_date()).withColumn("date", parse_any_date(F.col("raw"), F.col("dayfirst"), F.lit(as_of_year)))
    got = read.groupBy("source").agg(F.min_by("date", F.when(F.col("date").isNotNull(), F.col("line_no"))).alias("date"), F.max_by("raw", F.when(F.col("date").isNull(), F.col("line_no"))).alias("raw"))
    return got.select("source", "date", F.when(F.col("date").isNull(), F.col("raw")).alias("unread"))


def money_of(words: str = "words") -> Column:
    """The amount that each word is, or null."""
    return F.transform(f"{words}.text", money_word)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; as a column of its own, a filter or several uses would compute it again."""
    return F.get(F.transform(F.array(value), use), 0)


def labelled_amount(text: str = "text", words: str = "words") -> Column:
    """(line_no, value, total, tax, subtotal) of a line with a totals label and an amount, else null."""
    def last(tokens: Column) -> Column:
        # nearly always the last such word is the amount; only else are those before it read
        before = F.filter(F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda w: parse_money(w)), lambda x: x.isNotNull())
        return F.coalesce(parse_money(F.try_element_at(tokens, F.lit(-1))), F.try_element_at(before, F.lit(-1)))

    def amount(k: Column) -> Column:
        value = bound(F.filter(F.transform(words, lambda w: w["text"]), is_money_token), last)
        return F.when(k["total"] | k["tax"] | k["subtotal"], bound(value, lambda v: F.when(v.isNotNull(), F.struct(F.col("line_no"), v.alias("value"), *(k[n].alias(n) for n, _ in TOTAL_LABELS)))))

    return bound(F.struct(*[F.col(text).rlike(p).alias(n) for n, p in TOTAL_LABELS]), amount)


def dealt(listed: Column | str) -> Column:
    """(total, tax, subtotal) of a document's labelled amounts in order."""
    none = F.lit(None).cast("decimal(38,6)")
    start = F.struct(none.alias("total"), none.alias("tax"), none.alias("subtotal"))

    def step(acc: Column, line: Column) -> Column:
        total = line["total"] & acc["total"].isNull()
        tax = line["tax"] & acc["tax"].isNull() & ~total
        sub = line["subtotal"] & acc["subtotal"].isNull() & ~total & ~tax
        return F.struct(F.when(total, line["value"]).otherwise(acc["total"]).alias("total"), F.when(tax, line["value"]).otherwise(acc["tax"]).alias("tax"), F.when(sub, line["value"]).otherwise(acc["subtotal"]).alias("subtotal"))

    return F.aggregate(listed, start, step)


def labelled_amounts(lines: DataFrame) -> DataFrame:
    """(source, total, tax, subtotal): each label once; a line gives its last amount to the first of its labels that is still open.

    Which label a line serves depends on the lines before, so a document's lines
    with amounts are folded in order.
    """
    # dealt by document first: a list is then made once, of what one pass over the lines found
    found = lines.select("source", labelled_amount().alias("amount")).repartition("source").groupBy("source").agg(F.sort_array(F.collect_list("amount")).alias("l"))
    return found.where(F.size("l") > 0).select("source", F.inline(F.array(dealt("l"))))  # a field of a struct each would fold anew


def without_trailing_amounts(said: Column, money: Column) -> Column:
    """Words, of which ``money`` tells the amounts, less the unbroken run of amounts at their end; as one text."""
    last = F.array_max(F.transform(money, lambda m, i: F.when(m.isNull(), i)))
    cut = bound(last, lambda n: F.when(n.isNull(), "").otherwise(F.array_join(F.slice(said, F.lit(1), n + 1), " ")))
    return F.when(F.try_element_at(money, F.lit(-1)).isNull(), F.array_join(said, " ")).otherwise(cut)


def undashed(item: Column) -> Column:
    return F.regexp_replace(item, "^[ –:-]+|[ –:-]+$", "")


def is_item_header() -> Column:
    return (F.length("text") < 90) & says(ITEM_HEADER)


def line_items(lines: DataFrame) -> DataFrame:
    """(source, line_items): rows between the first item header and the first totals label, 20 at most."""
    t = strip("text")
    label = F.lit(False)
    for _, p in TOTAL_LABELS:
        label = label | t.rlike(p)
    head = lines.where(is_item_header()).groupBy("source").agg(F.min("line_no").alias("first"))
    after = lines.join(head, "source").where("line_no > first").withColumn("t", t).where("t <> ''")
    stop = after.where(label).groupBy("source").agg(F.min("line_no").alias("stop"))
    item = undashed(bound(money_of(), lambda m: without_trailing_amounts(F.col("words.text"), m)))
    rows = after.join(stop, "source", "left").where("stop is null or line_no < stop").withColumn("item", item)
    named = F.when((F.col("item") != "") & ~F.col("item").rlike("^[0-9]+$"), F.struct("line_no", "item"))  # as a filter it would read the amounts again
    found = rows.groupBy("source").agg(F.slice(F.transform(F.array_sort(F.collect_list(named)), lambda s: s["item"]), 1, MOST_ITEMS).alias("line_items"))
    return found.where(F.size("line_items") > 0)


def items_among(listed: str, first: str) -> Column:
    """``line_items`` of a document's lines (line_no, row, label) in order, of which ``first`` is the number of the item header."""
    stop = F.array_min(F.transform(F.filter(listed, lambda x: x["label"] & (x["line_no"] > F.col(first))), lambda x: x["line_no"]))
    rows = bound(stop, lambda n: F.filter(listed, lambda x: (x["line_no"] > F.col(first)) & (n.isNull() | (x["line_no"] < n)) & x["row"].isNotNull()))
    named = F.filter(F.transform(rows, lambda x: undashed(x["row"])), lambda i: (i != "") & ~i.rlike("^[0-9]+$"))
    return F.slice(named, 1, MOST_ITEMS)


def arithmetic_off(subtotal: Column, tax: Column, total: Column) -> Column:
    """Subtotal and tax miss the total by over two cents."""
    return F.coalesce(F.abs(subtotal + tax - total) > 0.02, F.lit(False))


def by_document(lines: DataFrame, as_of_year: int) -> DataFrame:
    """(source, reference, vendor, date, unread, total, tax, subtotal, largest, line_items): a row a document.

    What a line can say alone is found in one pass, each word's amount once, and a document's lines then meet in one
    grouping. What depends on the lines before (the item rows, which label an amount serves, the day-first rule) is told
    from the grouped lists. The results are those of ``vendors``, ``invoice_dates``, ``labelled_amounts`` and ``line_items``.
    """
    names = [n for n, _ in TOTAL_LABELS]
    read = lines.select("source", "line_no", "text", "size", strip("text").alias("stripped"), F.col("words.text").alias("said"), money_of().alias("money"),
                        *[F.coalesce(says(p), F.lit(False)).alias(n) for n, p in TOTAL_LABELS])
    label = F.col(names[0]) | F.col(names[1]) | F.col(names[2])
    row = F.when(~label & (F.col("stripped") != ""), without_trailing_amounts(F.col("said"), F.col("money")))
    starts = F.when((F.col("text").contains("/") | F.col("text").contains("-")) & F.col("text").rlike(r"^\s*\d{1,2}[/-]"), dayfirst_of("text"))  # which few lines do
    read = read.select("source", "line_no", F.struct("line_no", "text", label.alias("label"), row.alias("row")).alias("line"),
                       F.when(may_be_vendor(F.col("stripped")), F.struct(prominence().alias("by"), F.col("stripped").alias("vendor"))).alias("vendor"),
                       F.when(dated(), F.struct("line_no", said_date().alias("raw"))).alias("dated"), starts.alias("dayfirst"),
                       F.when(label, bound(F.try_element_at(F.array_compact("money"), F.lit(-1)), lambda v: F.when(v.isNotNull(), F.struct("line_no", v.alias("value"), *names)))).alias("amount"),
                       F.array_max("money").alias("largest"), F.when(is_item_header(), F.col("line_no")).alias("head"))
    d = read.groupBy("source").agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.max("vendor")["vendor"].alias("vendor"), F.sort_array(F.collect_list("dated")).alias("dated"),
        F.coalesce(F.min_by("dayfirst", F.when(F.col("dayfirst").isNotNull(), F.col("line_no"))), F.lit(False)).alias("dayfirst"),
        F.sort_array(F.collect_list("amount")).alias("amounts"), F.max("largest").alias("largest"), F.min("head").alias("head"))
    d = d.select("source", invoice_number(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("reference"), "vendor", "largest",
                 F.transform("dated", lambda x: x["raw"]).alias("raw"), "dayfirst", dealt("amounts").alias("dealt"), items_among("lines", "head").alias("line_items"))
    d = d.withColumn("dates", parse_any_dates(F.col("raw"), F.col("dayfirst"), F.lit(as_of_year))).withColumn("date", F.get(F.array_compact("dates"), 0))
    return d.select("source", "reference", "vendor", "date", F.when(F.col("date").isNull(), F.try_element_at("raw", F.lit(-1))).alias("unread"), "dealt.*", "largest", "line_items")


def parse_invoices(lines: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """(records, flags) from the lines of invoices (see ``statements.lines_of``). What documents say is written once, for both."""
    d = written(by_document(lines, as_of_year), "invoices")
    money = "decimal(18,2)"
    d = (d.withColumn("guessed", F.col("total").isNull() & F.col("largest").isNotNull())
         .withColumn("total", F.coalesce("total", "largest")).withColumn("line_items", F.coalesce("line_items", F.array().cast("array<string>"))).withColumn("vendor", F.coalesce("vendor", F.lit("")))
         .withColumn("description", F.coalesce(F.nullif(F.array_join("line_items", "; "), F.lit("")), "vendor")).withColumn("kind", F.lit("invoice")).withColumn("amount", -F.col("total"))
         .withColumn("off", arithmetic_off(F.col("subtotal"), F.col("tax"), F.col("total"))).withColumn("key", fingerprint()))
    none = F.lit(None).cast(money)
    records = d.select(F.xxhash64("source").alias("record_id"), F.lit(0).cast("long").alias("input_ord"), "kind", "source", "date", "description", F.col("vendor").alias("payee"), F.col("amount").cast(money).alias("amount"),
                       none.alias("deposit"), none.alias("withdrawal"), none.alias("balance"), F.lit("").alias("category"), "reference", "vendor", *[F.col(c).cast(money).alias(c) for c in ("tax", "subtotal", "total")],
                       "line_items", F.lit(1).alias("page"), F.when(F.col("off"), "uncertain").otherwise("clear").alias("confidence"), F.create_map().cast("map<string,string>").alias("extra"))

    def said(when: Column, field: str, reason: str, raw: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.coalesce(F.lit("") if raw is None else raw, F.lit("")).alias("raw"), F.lit(reason).alias("reason")))

    def missing(c: Column) -> Column:
        return c.isNull() | (c == 0)

    flags = F.array_compact(F.array(
        said(F.col("unread").isNotNull(), "invoice date", "Date text next to the label could not be read.", F.col("unread")),
        said(F.col("guessed"), "total", "No labelled total was found; the largest amount on the page was taken.", F.col("largest").cast("string")),
        said(F.col("off"), "total", "Subtotal plus tax does not equal the total."),
        said(F.col("reference") == "", "invoice number", "Not found in the document."), said(F.col("date").isNull(), "date", "Not found in the document."), said(missing(F.col("total")), "total", "Not found in the document.")))
    exploded = d.select("source", "key", F.explode(flags).alias("f"))
    return records, exploded.select("source", F.lit("document").alias("location"), "f.field", "f.raw", "f.reason", F.col("key").alias("row_key"))
