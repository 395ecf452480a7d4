"""Bank statements from lines of positioned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.functions.text import fingerprint, reference_in, strip, year_in
from tallyweave.functions.values import dayfirst_of, is_money_token, parse_any_date, parse_money
from tallyweave.schema import (ANCHOR_LINES, COLUMN_ROLES, CURRENCY_SHAPED, DATE_AT_START, DATED_ROW, INVOICE_HINTS, LEAST_OVERLAP, LEFT_MARGIN,
                               MONEY_ROLES, RIGHT_MARGIN, STATEMENT_HINTS, STATEMENT_NOISE)

LINE = ["source", "page", "line"]


def group_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with ``line``: in order of rounded top, a word joins a line if within ``tolerance`` of the line's first word.

    The rule looks back to a line's first word, so it is a fold over one page's
    words: an array, as a page has few of them.
    """
    word = F.struct(F.bround("top", 1).alias("t"), "x0", "word_id", "text", "x1", "top", "size")
    pages = words.groupBy("source", "page").agg(F.array_sort(F.collect_list(word)).alias("w"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, w: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(w["top"] - acc["anchor"]) > tolerance)
        line = acc["line"] + F.when(new, 1).otherwise(0)
        return F.struct(line.alias("line"), F.when(new, w["top"]).otherwise(acc["anchor"]).alias("anchor"), F.array_append(acc["lines"], line).alias("lines"))

    dealt = pages.select("source", "page", "w", F.aggregate("w", start, step, lambda acc: acc["lines"]).alias("line"))
    return dealt.select("source", "page", F.explode(F.arrays_zip("w", "line")).alias("x")).select(
        "source", "page", "x.w.word_id", "x.w.text", "x.w.x0", "x.w.x1", "x.w.top", "x.w.size", "x.line")


def lines_of(words: DataFrame) -> DataFrame:
    """One row a line: its words in x order, text, largest size, and ``line_no`` through the document."""
    got = words.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("x0", "word_id", "x1", "text"))).alias("words"), F.max("size").alias("size"))
    return got.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).withColumn("line_no", F.row_number().over(W.partitionBy("source").orderBy("page", "line")))


def classify(documents: DataFrame, body: str = "text") -> DataFrame:
    """``documents`` with ``doc_kind``: more statement than invoice words, where four or more dated lines count half each."""
    dated = F.regexp_count(F.col(body), F.lit(DATED_ROW))
    statement = F.regexp_count(F.col(body), F.lit(STATEMENT_HINTS)) + F.when(dated >= 4, F.floor(dated / 2)).otherwise(0)
    return documents.withColumn("doc_kind", F.when(statement > F.regexp_count(F.col(body), F.lit(INVOICE_HINTS)), "statement").otherwise("invoice"))


def bodies(lines: DataFrame) -> DataFrame:
    """(source, text): a document's lines as one text."""
    return lines.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"))


def role_of(word: Column | str) -> Column:
    key = F.trim(F.regexp_replace(F.lower(F.col(word) if isinstance(word, str) else word), "[^a-z ]", ""))
    table = F.create_map(*[F.lit(x) for kv in COLUMN_ROLES.items() for x in kv])
    return F.element_at(table, key)


def find_anchors(lines: DataFrame) -> DataFrame:
    """(source, role, x0, x1, ord): column captions of the header line among the first lines, widened to bands.

    Neighbouring captions of one role merge. The header has a date and a money
    column; most captions win, the first of equals.
    """
    top = lines.where(F.col("line_no") <= ANCHOR_LINES).select("source", "line_no", F.explode("words").alias("w")).select("source", "line_no", "w.*").withColumn("role", role_of("text")).where("role is not null")
    in_line = W.partitionBy("source", "line_no").orderBy("x0", "word_id")
    run = top.withColumn("new", (F.col("role") != F.coalesce(F.lag("role").over(in_line), F.lit(""))).cast("int")).withColumn("run", F.sum("new").over(in_line))
    merged = run.groupBy("source", "line_no", "run", "role").agg(F.min_by("x0", F.struct("x0", "word_id")).alias("x0"), F.max_by("x1", F.struct("x0", "word_id")).alias("x1"))
    captions = merged.groupBy("source", "line_no").agg(F.count("*").alias("n"), F.collect_set("role").alias("roles"), F.collect_list(F.struct("role", "x0", "x1")).alias("c"))
    ok = captions.where(F.array_contains("roles", "date") & F.arrays_overlap("roles", F.array(*map(F.lit, MONEY_ROLES))))
    best = ok.groupBy("source").agg(F.max_by("c", F.struct("n", -F.col("line_no"))).alias("c"))
    return widen(best.select("source", F.explode("c").alias("c")).select("source", "c.*"))


def widen(anchors: DataFrame) -> DataFrame:
    """Each band reaches half-way to its neighbours' captions."""
    w = W.partitionBy("source").orderBy("x0")
    left = F.coalesce(F.lag("x1").over(w), F.col("x0") - LEFT_MARGIN)
    right = F.coalesce(F.lead("x0").over(w), F.col("x1") + RIGHT_MARGIN)
    return anchors.select("source", "role", ((left + F.col("x0")) / 2).alias("x0"), ((F.col("x1") + right) / 2).alias("x1"), F.row_number().over(w).alias("ord"))


def best_role(word: Column) -> Column:
    """The band of column ``bands`` that covers most of the word, above a quarter; the leftmost of equals."""
    span = F.greatest(word["x1"] - word["x0"], F.lit(0.1))

    def step(best: Column, band: Column) -> Column:
        o = F.greatest(F.lit(0.0), F.least(band["b"], word["x1"]) - F.greatest(band["a"], word["x0"])) / span
        return F.when(o > best["o"], F.struct(o.alias("o"), band["role"].alias("role"))).otherwise(best)

    start = F.struct(F.lit(0.0).alias("o"), F.lit(None).cast("string").alias("role"))
    bands = F.coalesce("bands", F.array().cast("array<struct<ord:int,role:string,a:double,b:double>>"))
    return F.aggregate(bands, start, step, lambda best: F.when(best["o"] > LEAST_OVERLAP, best["role"]))


def with_money(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """``lines`` with has_anchors and ``words`` of (text, role, money): the role of each word, and its value if it counts as an amount.

    A number counts in a money column, or outside all columns if written like
    currency; where a column has several, those written like currency win. A
    document's bands are few: they join as one array a document.
    """
    bands = anchors.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "role", F.col("x0").alias("a"), F.col("x1").alias("b")))).alias("bands"))
    placed = lines.join(bands, "source", "left").withColumn("placed", F.transform("words", lambda w: F.struct(
        w["text"].alias("text"), best_role(w).alias("role"), F.when(is_money_token(w["text"]), parse_money(w["text"])).alias("value"), w["text"].rlike(CURRENCY_SHAPED).alias("shaped"))))

    def counts(w: Column) -> Column:
        return w["value"].isNotNull() & F.coalesce(w["role"].isin(*MONEY_ROLES), w["shaped"])

    def beaten(w: Column) -> Column:
        return ~w["shaped"] & F.exists("placed", lambda v: counts(v) & v["shaped"] & v["role"].eqNullSafe(w["role"]))

    words = F.transform("placed", lambda w: F.struct(w["text"].alias("text"), w["role"].alias("role"), F.when(counts(w) & ~beaten(w), w["value"]).alias("money")))
    return placed.withColumn("words", words).withColumn("has_anchors", F.col("bands").isNotNull()).drop("placed", "bands")


def description_of(words: Column, leading: Column) -> Column:
    """Words that are no amounts, less as many date words as the leading date has; dashes and spaces at the ends go."""
    dates = F.split(F.trim(leading), r"\s+")
    start = F.struct(F.lit(0).alias("skipped"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, w: Column) -> Column:
        skip = (acc["skipped"] < F.size(dates)) & F.array_contains(dates, w["text"])
        kept = F.when(w["money"].isNotNull() | skip, acc["parts"]).otherwise(F.array_append(acc["parts"], w["text"]))
        return F.struct((acc["skipped"] + F.when(w["money"].isNull() & skip, 1).otherwise(0)).alias("skipped"), kept.alias("parts"))

    return F.regexp_replace(F.aggregate(words, start, step, lambda acc: F.array_join(acc["parts"], " ")), "^[ –-]+|[ –-]+$", "")


def single(words: Column, role: str) -> Column:
    """The one amount of a column; none or several give null."""
    own = F.filter(words, lambda w: w["money"].isNotNull() & (w["role"] == role))
    return F.when(F.size(own) == 1, own[0]["money"])


def net_amount(amount: Column, deposit: Column, withdrawal: Column) -> Column:
    """Positive in, negative out. (A balance can decide nothing here: it is asked only for amounts of 0.)"""
    return F.when(deposit.isNotNull() & withdrawal.isNotNull(), deposit - withdrawal).when(deposit.isNotNull(), deposit).when(withdrawal.isNotNull(), -withdrawal).otherwise(amount)


def parse_statements(words: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """(records, flags) of statements whose words have lines.

    All per-line work is set-based: which rows are accepted never depends on a
    running balance, so that balance and the lines that continue a description
    are windows over a document's lines. The year for dates without one is the
    document's first year, else ``as_of_year``.
    """
    numbered = lines_of(words).withColumn("lead", F.regexp_extract("text", DATE_AT_START, 1))
    year, says = year_in("text"), dayfirst_of("lead")
    hints = numbered.groupBy("source").agg(F.coalesce(F.min_by(year, F.when(year.isNotNull(), F.col("line_no"))), F.lit(as_of_year)).alias("year"),
                                           F.coalesce(F.min_by(says, F.when(says.isNotNull(), F.col("line_no"))), F.lit(False)).alias("dayfirst"))
    lines = with_money(numbered, find_anchors(numbered)).join(hints, "source")
    live = lines.where((strip("text") != "") & ~F.col("text").rlike(STATEMENT_NOISE))
    money = F.filter("words", lambda w: w["money"].isNotNull())
    loose = F.filter("words", lambda w: w["money"].isNotNull() & w["role"].isNull())
    r = live.withColumn("dated", F.col("lead") != "").withColumn("when", F.when(F.col("dated"), parse_any_date(F.col("lead"), F.col("dayfirst"), F.col("year")))).withColumn("n_money", F.size(money))
    for c in ("deposit", "withdrawal", "balance", "amount"):
        r = r.withColumn(c, single(F.col("words"), c))
    fallback = ~F.col("has_anchors") | (F.col("deposit").isNull() & F.col("withdrawal").isNull() & F.col("amount").isNull())
    values = F.transform(F.when(F.col("has_anchors"), loose).otherwise(money), lambda w: w["money"])
    n = F.size(values)
    r = (r.withColumn("_values", values).withColumn("_fallback", fallback)
         .withColumn("amount", F.when(fallback, F.when(n > 0, F.element_at(values, 1))).otherwise(F.col("amount")))
         .withColumn("balance", F.when(F.col("_fallback") & (F.size("_values") > 1), F.element_at("_values", -1)).otherwise(F.col("balance"))))
    r = r.withColumn("deposit", F.abs("deposit")).withColumn("withdrawal", F.abs("withdrawal")).withColumn("net", net_amount(F.col("amount"), F.col("deposit"), F.col("withdrawal")))
    accepted = F.col("dated") & F.col("when").isNotNull() & (F.col("n_money") > 0) & F.col("net").isNotNull()
    r = r.withColumn("accepted", accepted).withColumn("description", F.when(accepted, description_of(F.col("words"), F.col("lead"))))
    w = W.partitionBy("source").orderBy("line_no")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    r = (r.withColumn("owner", F.last(F.when(F.col("accepted"), F.col("line_no")), ignorenulls=True).over(w))
         .withColumn("previous_balance", F.last(F.when(F.col("accepted"), F.col("balance")), ignorenulls=True).over(before)))
    more = (r.where(~F.col("dated") & F.col("owner").isNotNull() & (F.col("n_money") == 0) & (F.length(strip("text")) < 80))
            .groupBy("source", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", strip("text").alias("t")))), lambda s: s["t"]), " ").alias("more")))
    rows = r.where("accepted").join(more, ["source", "owner"], "left")
    money_type = "decimal(18,2)"
    implied = F.col("balance") - F.col("previous_balance")
    off = F.coalesce(F.col("amount").isNotNull() & (F.abs(F.abs(implied) - F.abs("net")) > 0.01), F.lit(False))
    one_sided = F.col("deposit").isNull() & F.col("withdrawal").isNull()
    records = rows.select(
        F.xxhash64("source", "line_no").alias("record_id"), F.col("line_no").cast("long").alias("input_ord"), F.lit("transaction").alias("kind"), "source", F.col("when").alias("date"),
        F.trim(F.concat_ws(" ", "description", "more")).alias("description"), F.col("description").alias("payee"), F.col("net").cast(money_type).alias("amount"),
        F.when(one_sided, F.when(F.col("net") > 0, F.col("net"))).otherwise(F.col("deposit")).cast(money_type).alias("deposit"),
        F.when(one_sided, F.when(F.col("net") < 0, -F.col("net"))).otherwise(F.col("withdrawal")).cast(money_type).alias("withdrawal"),
        F.col("balance").cast(money_type).alias("balance"), F.lit("").alias("category"), reference_in("description").alias("reference"), F.lit("").alias("vendor"),
        *[F.lit(None).cast(money_type).alias(c) for c in ("tax", "subtotal", "total")], F.array().cast("array<string>").alias("line_items"), "page",
        F.when(off, "uncertain").otherwise("clear").alias("confidence"), F.create_map().cast("map<string,string>").alias("extra"))
    where = F.concat(F.lit("page "), F.col("page"), F.lit(", '"), F.substring("text", 1, 60), F.lit("'"))

    def flag(df: DataFrame, field: str, raw: Column, reason: Column, key: Column | None = None) -> DataFrame:
        return df.select("source", where.alias("location"), F.lit(field).alias("field"), raw.alias("raw"), reason.alias("reason"), (F.lit("") if key is None else key).alias("row_key"))

    unread = flag(r.where("dated and when is null"), "date", F.col("lead"), F.lit("No date can be read here."))
    crowd = flag(r.where("accepted").where(F.col("_fallback") & (F.size("_values") > 2)), "amount", F.substring("text", 1, 80), F.concat(F.size("_values"), F.lit(" amounts in one line, and no captions that say which is which.")))
    keyed = rows.where(off).withColumn("kind", F.lit("transaction")).withColumn("vendor", F.lit("")).withColumn("reference", reference_in("description"))
    wrong = flag(keyed, "amount", F.substring("text", 1, 80), F.concat(F.lit("The balance does not move by "), F.col("net").cast(money_type), F.lit(" but by "), implied.cast(money_type), F.lit(".")),
                 fingerprint(date="when", amount="net", total="net"))
    return records, unread.unionByName(crowd).unionByName(wrong)


def reconcile(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` (amount, balance) with previous_balance, implied change and ``off``: magnitudes differ by over a cent."""
    before = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    r = rows.withColumn("previous_balance", F.last("balance", ignorenulls=True).over(before)).withColumn("implied", F.col("balance") - F.col("previous_balance"))
    return r.withColumn("off", F.coalesce(F.abs(F.abs("implied") - F.abs("amount")) > 0.01, F.lit(False)))


