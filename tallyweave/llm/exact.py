"""Exact dedup: rows grouped by a 128-bit hash of their content, bytes compared inside the groups.

Only ids and hashes of all rows are shuffled. Texts are moved where a hash occurs
more than once, and there one for each map task and text, as grouping by the
text's bytes combines copies before the shuffle. A hash that several texts share
is taken apart by the texts themselves.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import Tables
from tallyweave.llm.secrets import LEAST_BITS, as_bitmap

#: Bytes of the hash that groups rows: 128 bits.
WIDTH = 16


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and everything else as it is; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``raw`` is an ``id`` of ``ids``, and by chance some others. ``df`` is not shuffled: of the ids
    a bitmap of at most 64 MB is broadcast, in which bits are shared where there are very many."""
    bitmap, bits = as_bitmap(ids)
    spot = F.pmod("_at", F.lit(LEAST_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("secret_bits", F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("_at", F.pmod("raw", F.lit(bits))).join(F.broadcast(bitmap), (F.col("_at") / LEAST_BITS).cast("int") == F.col("secret_bucket"))
    return joined.where(F.getbit(byte, F.pmod(spot, F.lit(8))) == 1).drop("_at", "secret_bucket", "secret_bits")


def groups(rows: DataFrame, order: Column, *by: str) -> DataFrame:
    """The groups of more than one row: size, key and place of the row that stays."""
    first = F.coalesce(F.min_by("at", order), F.min("at")).alias("first")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("id", order).alias("keep_id"), first).where("n > 1")


def judged(rows: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """A group's one row meets all its rows: a join that Spark splits where a group is large."""
    alone = F.col("n").isNull()
    return rows.join(found, [*by], "left").select(
        "id", "sha", "hash", "raw", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.when(alone, True).otherwise(F.col("at") == F.col("first")).alias("kept"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", normal: Column | None = None, largest: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts have the same bytes; ``normal`` is
    that text (default: as it is, null as empty). The row with the smallest key
    stays (with the largest, where ``largest`` is given), and keep_id names it.
    Keys are longs. A null key stays only where its group has no other; of rows that
    repeat key and text exactly one stays, and each counts. Empty texts are equal to
    each other, long texts are hashed and compared whole, a table without rows gives
    none, and other columns of ``docs``, whatever their names, are not looked at.
    """
    order = F.bitwise_not("id") if largest else F.col("id")  # turns longs around without overflow
    normal = F.coalesce(F.col(text), F.lit("")) if normal is None else normal
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("raw"), normal.alias("text"))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")
    hashed = texts.select("id", "raw", "text", sha).withColumn("hash", F.substring("sha", 1, WIDTH))
    with Tables() as t:
        rows = t.written(hashed.drop("text").withColumn("at", F.monotonically_increasing_id()), "hashes")
        found = t.written(groups(rows, order, "hash"), "groups")  # written, as Spark splits a join's large partitions of plain shuffles only
        out = t.written(judged(rows, found, "hash"), "judged")
        # each text that may have an equal, once a map task: equal bytes make one row, so a hash with two rows is shared
        variants = among(texts, out.where("group_size > 1").select(F.col("raw").alias("id")).distinct())
        variants = variants.select("text", sha).groupBy(F.substring("sha", 1, WIDTH).alias("hash"), "text").agg(F.count("*").alias("n"))
        shared = t.written(variants.groupBy("hash").count().where("count > 1").select("hash"), "shared")
        if not shared.isEmpty():
            apart = t.written(hashed.join(shared, "hash", "left_semi").withColumn("at", F.monotonically_increasing_id()), "apart")
            found = t.written(groups(apart, order, "hash", "text"), "groups")
            out = out.join(shared, "hash", "left_anti").unionByName(judged(apart, found, "hash", "text"))
        out = t.result(out.drop("hash", "raw"), "exact")
    return out.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", normal: Column | None = None, largest: bool = False) -> DataFrame:
    """``docs``, with all their columns, without the rows that another one of equal text stands for; keys are unique and not null."""
    out = classes(docs, key, text, normal, largest).where("kept").select(key)
    return docs.join(out, key, "left_semi")


def op13(docs: DataFrame) -> DataFrame:
    return classes(docs, normal=lower_ascii(F.col("text")), largest=True)


def op13_sql() -> str:
    return f"""
with d as (select doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') as t from documents),
g as (select t, count(*) as group_size, max(doc_id) as keep_id from d group by t)
select doc_id, keep_id, group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d join g using (t)
"""
