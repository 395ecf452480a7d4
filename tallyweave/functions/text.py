"""Text: normalisers, tokens, similarity, references, fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tallyweave.schema import NOISE_TOKENS, REFERENCE_PATTERN, YEAR_PATTERN


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null as empty."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (trim takes off spaces only)."""
    first, last = F.ascii(col(c)), F.ascii(F.substring(col(c), -1, 1))
    # most texts have nothing to take off: both ends are printable ASCII
    return F.when(first.between(33, 126) & last.between(33, 126), col(c)).otherwise(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""))


def blank(c: Column | str) -> Column:
    return text(strip(col(c))) == ""


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns], F.lit(""))


def squeezed_upper(c: Column | str) -> Column:
    """White space runs as one space, upper case: the normaliser of fingerprints."""
    return F.upper(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")))


def normalize(c: Column | str) -> Column:
    """ASCII letters, digits and single spaces, upper case: the normaliser of matching."""
    return F.trim(F.regexp_replace(F.upper(F.regexp_replace(text(c), "[^A-Za-z0-9 ]+", " ")), " +", " "))


def header_key(c: Column | str) -> Column:
    """Lower-case letters and digits only: the normaliser of headers."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def tokens(c: Column | str) -> Column:
    """Distinct identifying words: no noise words, no numbers, no single characters."""
    words = F.array_distinct(F.split(normalize(c), " "))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*NOISE_TOKENS) & ~w.rlike("^[0-9]+$"))


def token_key(c: Column | str) -> Column:
    """What the token score can tell apart: the identifying words in order, or without any the normal form. It may stand for the text in ``wording``."""
    def key(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(normalize(c))

    # bound by a lambda, so that the words are found once
    return F.get(F.transform(F.array(F.array_sort(tokens(c))), key), 0)


def wording(c: Column | str) -> Column:
    """What scores are made of: ``norm`` and ``words``. Best kept as a column where a description meets many."""
    return F.struct(normalize(c).alias("norm"), tokens(c).alias("words"))


def token_score(x: Column, y: Column) -> Column:
    """The part of a score that needs no Python: equality, Jaccard and 0.9 x containment of tokens."""
    both = F.size(F.array_intersect(x["words"], y["words"]))
    n, m = F.size(x["words"]), F.size(y["words"])
    share = F.greatest(F.try_divide(both, n + m - both), F.try_divide(both, F.least(n, m)) * 0.9)  # as conditions don't keep Spark from dividing
    return (F.when((x["norm"] == "") | (y["norm"] == ""), 0.0).when(x["norm"] == y["norm"], 1.0)
            .when((n > 0) & (m > 0), share).otherwise(0.0))


def token_similarity(left: Column | str, right: Column | str) -> Column:
    return token_score(wording(left), wording(right))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series, at_least: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two normalised texts, not symmetric; 0 where common letters show that it is below ``at_least``."""
    from difflib import SequenceMatcher

    def ratio(a: str, b: str, floor: float) -> float:
        s = SequenceMatcher(None, a, b)
        return s.ratio() if s.quick_ratio() >= floor else 0.0

    pairs = list(zip(left, right, at_least))
    known = {p: ratio(*p) for p in set(pairs) if p[0] is not None}
    return pd.Series([known.get(p, 0.0) for p in pairs], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the sequence ratio of two texts that aren't empty: twice the characters of either that the other has too, over both lengths."""
    def shared(x: Column, y: Column) -> Column:
        return F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))

    return F.try_divide(2.0 * F.least(shared(a, b), shared(b, a)), F.length(a) + F.length(b))


def with_token_score(pairs: DataFrame, x: str, y: str, at_least: Column | float = 0.0) -> DataFrame:
    """``pairs`` with ``score``, the token score of two wordings: exact, whatever is asked for."""
    return pairs.withColumn("score", token_score(F.col(x), F.col(y)))


def with_score(pairs: DataFrame, x: str, y: str, at_least: Column | float = 0.0) -> DataFrame:
    """``pairs`` with ``score``: how alike two wordings are, 0 to 1, the largest of sequence ratio and token scores; and ``compared``.

    Scores of ``at_least`` and more are exact; of others only the token score need be given. So Python sees the
    pairs whose sequence ratio may beat their token score and reach ``at_least`` (``compared``), and nulls for the
    others. Steps are columns of their own, so each is computed once.
    """
    a, b = F.col(x)["norm"], F.col(y)["norm"]
    pairs = with_token_score(pairs, x, y).withColumnRenamed("score", "_known")
    pairs = pairs.withColumn("_floor", F.greatest("_known", F.lit(at_least) if isinstance(at_least, float) else at_least))
    pairs = pairs.withColumn("_bound", F.when((a == "") | (b == "") | (a == b), -1.0).otherwise(ratio_bound(a, b)))
    pairs = pairs.withColumn("compared", F.col("_bound") >= F.col("_floor"))
    open_ = F.col("compared")
    pairs = pairs.withColumn("_ratio", sequence_ratio(F.when(open_, a), F.when(open_, b), F.when(open_, F.col("_floor"))))
    return pairs.withColumn("score", F.greatest("_known", "_ratio")).drop("_known", "_floor", "_bound", "_ratio")


def reference_in(c: Column | str) -> Column:
    """The first token after REF, CHQ, TXN and the like."""
    return F.regexp_extract(text(c), REFERENCE_PATTERN, 1)


def year_in(c: Column | str) -> Column:
    """The first standalone number 1900 to 2099, or null."""
    return F.nullif(F.regexp_extract(text(c), YEAR_PATTERN, 1), F.lit("")).cast("int")


def fingerprint(kind="kind", date="date", description="description", vendor="vendor", reference="reference", amount="amount", total="total") -> Column:
    """First 16 hexadecimal digits of SHA-1 over kind, date, description or vendor, reference and headline amount."""
    headline = F.coalesce(col(amount), col(total))
    parts = (text(kind), F.coalesce(F.date_format(col(date), "yyyy-MM-dd"), F.lit("")), squeezed_upper(first_filled(description, vendor)),
             squeezed_upper(reference), F.coalesce(F.bround(headline, 2).cast("decimal(38,2)").cast("string"), F.lit("")))
    return F.substring(F.sha1(F.encode(F.concat_ws("|", *parts), "UTF-8")), 1, 16)
