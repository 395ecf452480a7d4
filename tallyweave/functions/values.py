"""Money and dates."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tallyweave.functions.text import col, strip
from tallyweave.schema import MONEY_PATTERN, MONEY_TOKEN, PLAIN_MONEY


def parse_money(c: Column | str, eu_format: bool = False) -> Column:
    """decimal(38,6) of a money text, or null: signs, parentheses, CR/DR, grouping, a lone decimal comma."""
    raw = strip(col(c))
    # one match gives all groups; texts that don't match give a single part
    parts = F.split(F.regexp_replace(raw, MONEY_PATTERN, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001")

    def value(g: Column) -> Column:
        num = g[2]
        if eu_format:
            plain = F.replace(F.replace(F.replace(num, F.lit("."), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
        else:
            comma, dot = num.contains(","), num.contains(".")
            no_commas = F.replace(num, F.lit(","), F.lit(""))
            tail = F.substring_index(num, ",", -1)
            head = F.replace(num.substr(F.lit(1), F.length(num) - F.length(tail) - 1), F.lit(","), F.lit(""))
            plain = F.when(comma & dot, no_commas).when(comma & F.length(tail).isin(1, 2), F.concat(head, F.lit("."), tail)).when(comma, no_commas).otherwise(num)
            plain = F.replace(plain, F.lit(" "), F.lit(""))
        amount = plain.try_cast("decimal(38,6)")
        suffix = F.upper(g[4])
        negative = ((g[0] != "") & (g[3] != "")) | (g[1] == "-") | suffix.isin("DR", "-")
        return F.when(negative & (suffix != "CR"), -amount).otherwise(amount)

    # bound by a lambda, so that the match is made once even inside other lambdas
    matched = F.filter(F.array(F.when(~raw.contains("\u0001"), parts)), lambda g: F.size(g) == 5)
    read = F.get(F.transform(matched, value), 0)
    if eu_format:
        return read
    return F.when(col(c).rlike(PLAIN_MONEY), _plain(col(c))).otherwise(read)


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(38,6)")


def is_money_token(c: Column | str) -> Column:
    """The looser shape that words of a statement are tested for."""
    return col(c).rlike(MONEY_TOKEN)


def money_word(w: Column) -> Column:
    """``parse_money`` of a word that has the looser shape, else null. No such word begins with a letter, and nearly all others are plain."""
    return F.when(F.shiftright(F.ascii(w), 6) != 1, F.when(w.rlike(PLAIN_MONEY), _plain(w)).when(is_money_token(w), parse_money(w)))


def looks_like_money(c: Column | str) -> Column:
    return parse_money(c).isNotNull()


def cents(c: Column | str) -> Column:
    """Absolute value in whole cents, halves to even; doubles go through their shortest text."""
    return F.bround(F.abs(col(c).cast("string").try_cast("decimal(38,6)")) * 100, 0).cast("long")


def number_text(c: Column | str) -> Column:
    """A stored number as its cell reads it: whole numbers without a point, none with an exponent."""
    n = col(c)
    whole = n.try_cast("decimal(38,0)")
    plain = F.regexp_replace(n.try_cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    said = n.cast("string")
    return F.when(n == whole.cast("double"), whole.cast("string")).otherwise(F.when(said.contains("E"), plain).otherwise(said))


def numeric_cell(vtype: Column | str, v_num: Column | str) -> Column:
    """Numbers only: a text that looks like money is not read from a stored cell."""
    return F.when(col(vtype) == "n", col(v_num).cast("string").try_cast("decimal(38,6)"))


MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy")
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy")
EITHER = ("yyyy-MM-dd", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def parse_date_listed(c: Column | str, dayfirst: bool = False) -> Column:
    """Dates in the listed formats, without Python. Bare numbers are no dates."""
    raw = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    tries = [F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in ((DAY_FIRST + MONTH_FIRST) if dayfirst else (MONTH_FIRST + DAY_FIRST)) + EITHER]
    return F.when(raw.rlike(r"^\d{1,4}$"), None).otherwise(F.coalesce(*tries))


def read_date(s: str | None, d: bool, y: int) -> dt.date | None:
    """Any date that dateutil reads (not fuzzily); missing parts come from 1 January of ``y``."""
    from dateutil import parser

    s = " ".join(s.split()) if s else ""
    if not s or s.isdigit() and len(s) <= 4:
        return None
    try:
        return parser.parse(s, dayfirst=bool(d), fuzzy=False, default=dt.datetime(int(y), 1, 1)).date()
    except (ValueError, OverflowError, TypeError):
        return None


@F.pandas_udf(T.DateType())
def parse_date(raw: pd.Series, dayfirst: pd.Series, year: pd.Series) -> pd.Series:
    """``read_date``; ``year`` is always given."""
    asked = list(zip(raw, dayfirst, year))
    known = {x: read_date(*x) for x in set(asked) if x[0]}
    return pd.Series([known.get(x) for x in asked], dtype="object")


@F.pandas_udf(T.ArrayType(T.DateType()))
def parse_dates(raws: pd.Series, dayfirst: pd.Series, year: pd.Series) -> pd.Series:
    """``read_date`` of each text of a list, or null for no list."""
    asked = [None if r is None else [(s, d, y) for s in r] for r, d, y in zip(raws, dayfirst, year)]
    known = {x: read_date(*x) for x in {x for r in asked if r for x in r}}
    return pd.Series([None if r is None else [known[x] for x in r] for r in asked], dtype="object")


def plain_date(raw: Column, dayfirst: Column) -> tuple[Column, Column]:
    """(whether, date): a date of two numbers and a year of four digits, read without Python."""
    said = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    plain = said.rlike(r"^[0-9]{1,2}([/-])[0-9]{1,2}\1[0-9]{4}$")
    slashed = F.translate(said, "-", "/")
    month_first, day_first = (F.try_to_timestamp(slashed, F.lit(f)).cast("date") for f in ("M/d/yyyy", "d/M/yyyy"))
    return plain, F.when(plain, F.when(dayfirst, F.coalesce(day_first, month_first)).otherwise(F.coalesce(month_first, day_first)))


def parse_any_date(raw: Column, dayfirst: Column, year: Column) -> Column:
    """``parse_date``, with plain dates read without Python."""
    plain, read = plain_date(raw, dayfirst)
    return F.coalesce(read, parse_date(F.when(~plain, raw), dayfirst, year))


def parse_any_dates(raws: Column, dayfirst: Column, year: Column) -> Column:
    """``parse_any_date`` of each text of a list. Lists of plain dates alone don't reach Python."""
    def other(raw: Column) -> Column:
        return ~F.coalesce(plain_date(raw, dayfirst)[0], F.lit(True))

    read = F.transform(raws, lambda r: plain_date(r, dayfirst)[1])
    others = parse_dates(F.when(F.exists(raws, other), F.transform(raws, lambda r: F.when(other(r), r))), dayfirst, year)
    return F.coalesce(F.zip_with(read, others, lambda a, b: F.coalesce(a, b)), read)


def dayfirst_of(sample: Column | str) -> Column:
    """What one sample says: true, false, or null if it is not decisive."""
    a = F.nullif(F.regexp_extract(col(sample), r"^\s*(\d{1,2})[/-](\d{1,2})[/-]", 1), F.lit("")).cast("int")
    b = F.nullif(F.regexp_extract(col(sample), r"^\s*(\d{1,2})[/-](\d{1,2})[/-]", 2), F.lit("")).cast("int")
    return F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False)


def infer_dayfirst(samples: DataFrame, by: list[str], sample: str = "sample", order: str = "ord") -> DataFrame:
    """Per group of samples: the first decisive sample's answer, else false."""
    says = dayfirst_of(sample)
    return samples.groupBy(*by).agg(F.coalesce(F.min_by(says, F.when(says.isNotNull(), F.col(order))), F.lit(False)).alias("dayfirst"))


def coerce_date(vtype: Column | str, v_date: Column | str, v_str: Column | str, year: int) -> Column:
    """A stored cell as a date; a text is judged alone, so 03/07/2026 is month-first even in a day-first book."""
    return F.when(col(vtype) == "d", col(v_date)).when(col(vtype) == "s", parse_date(col(v_str), F.coalesce(dayfirst_of(v_str), F.lit(False)), F.lit(year)))


def money_text(c: Column | str) -> Column:
    """For display: grouped, two decimals."""
    return F.format_number(col(c), 2)
