"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over its
size. A document's count is the Poisson quantile of a uniform number hashed from
its id, so it is the same on every run and machine. Documents are exploded by
their counts and shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rates of up to so many sources are broadcast; beyond, a shuffled join (split where skewed by AQE).
BROADCAST_SOURCES = 10_000
UNIT = "({} + 0.5) / 4503599627370496.0"
SPARK_LONG, DUCK_LONG = "cast(conv({}, 16, 10) as bigint)", "cast(('0x' || {}) as bigint)"


def uniform_sql(seed: str, key: str, to_long: str = SPARK_LONG) -> str:
    """A number in (0, 1) with 52 bits, from the MD5 of seed and key."""
    return UNIT.format(to_long.format(f"substr(md5(concat('{seed}:', {key})), 1, 13)"))


def repetition_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict[str, float] | None = None,
                     alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: source, size (UTF-8 bytes + 1 for each row), rate, cdf.

    Target shares come from ``weights`` (by source; sources not listed get 0), or
    else are proportional to size ** alpha. The output is meant to have
    ``epochs`` times the input's bytes. ``cdf[k]`` is P(count <= k).
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("double").alias("size"))
    if weights is None:
        target = sizes.withColumn("w", F.pow("size", F.lit(float(alpha))))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        target = sizes.withColumn("w", F.coalesce(known[F.col("mix_source")], F.lit(0.0)))
    total = target.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rate = "case when all_w > 0 then w / all_w * all_size * {} / size else 0.0 end".format(float(epochs))
    return (target.join(F.broadcast(total)).selectExpr("mix_source", "size", f"{rate} as rate")
            .withColumn("cdf", F.expr(CDF)))


#: Up to 12 standard deviations and 30 counts beyond the mean, in logarithms so that large rates don't underflow.
TERMS = "cast(ceil(rate + 12 * sqrt(rate) + 30) as int)"
CDF = f"""case when rate > 0 then aggregate(sequence(1, {TERMS}),
  struct(-rate as lp, array(exp(-rate)) as c),
  (a, k) -> struct(a.lp + ln(rate) - ln(k) as lp, concat(a.c, array(element_at(a.c, -1) + exp(a.lp + ln(rate) - ln(k)))) as c),
  a -> a.c) else array(1.0D) end"""


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str, float] | None = None,
        alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """All columns of ``docs``, a row for each copy, with ``mix_copy`` (from 0) and ``mix_order``.

    Rows come in a global random order: sorted by ``mix_order``, a hash of seed,
    key and copy, within hash partitions of it. Sorting all by ``mix_order``
    gives one total order. A null source is a source of its own, a null key is a
    key like another, a null text has size 1; rows that repeat a key get the same
    count. A source of any share stays spread: the join adds a rate per source
    (broadcast, as its size is checked) and copies are dealt by hash.
    Columns named mix_* in ``docs`` are replaced.
    """
    docs = docs.drop("mix_copy", "mix_order", "mix_source")
    rates = repetition_rates(docs, source, text, weights, alpha, epochs)
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    cdfs = rates.select("mix_source", "cdf")
    name = f"coalesce(cast(`{key}` as string), 'null')"
    u = F.expr(uniform_sql(seed, name))
    joined = docs.join(F.broadcast(cdfs) if small else cdfs, F.col(source).eqNullSafe(F.col("mix_source")))
    copies = joined.withColumn("mix_copy", F.aggregate("cdf", F.lit(0), lambda n, c: n + F.when(c < u, 1).otherwise(0)))
    out = (copies.where("mix_copy > 0").drop("cdf", "mix_source")
           .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copy") - 1)))
           .withColumn("mix_order", F.expr(f"md5(concat('{seed}:order:', {name}, ':', mix_copy))")))
    return out.repartition(F.col("mix_order")).sortWithinPartitions("mix_order")


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def op8_sql(alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> str:
    name = "coalesce(cast(doc_id as varchar), 'null')"
    return f"""
with sizes as (select source as mix_source, sum(coalesce(octet_length(encode(text)), 0) + 1)::DOUBLE as size from documents group by 1),
target as (select *, pow(size, {alpha}) as w from sizes),
rates as (select mix_source, w / (select sum(w) from target) * (select sum(size) from target) * {epochs} / size as rate from target),
terms as (select mix_source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by mix_source order by k) as c
  from rates, lateral (select unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) as k)),
cdfs as (select mix_source, list(c order by k) as cdf from terms group by 1),
counted as (select d.*, len(list_filter(cdf, lambda c: c < {uniform_sql(seed, name, DUCK_LONG)})) as n
  from documents d join cdfs on d.source is not distinct from mix_source),
copies as (select * exclude (n), unnest(range(n)) as mix_copy from counted)
select doc_id, text, lang, source, n_chars, mix_copy::INT as mix_copy, md5(concat('{seed}:order:', {name}, ':', mix_copy)) as mix_order from copies
"""
