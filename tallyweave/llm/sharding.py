"""Sharding with a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each node every child draws an
exponential waiting time from the key's hash, divided by the child's weight; the
shortest wins, so a child gets keys in proportion to its weight. A changed weight
changes that child's draw alone: keys move into or out of its subtree and nowhere
else.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Node:
    """A leaf carries its shard number, an inner node its children."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()

    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total() for c in self.children)

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]


def build_tree(regions: int, racks: int, shards: int) -> Node:
    """``regions`` x ``racks`` x ``shards`` shards of weight 1, numbered from 0 in that order."""
    number = iter(range(regions * racks * shards))
    return Node("root", children=tuple(
        Node(f"r{i}", children=tuple(
            Node(f"r{i}k{j}", children=tuple(Node(f"r{i}k{j}s{k}", shard=next(number)) for k in range(shards)))
            for j in range(racks)))
        for i in range(regions)))


def grow(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own, so it takes keys only into itself.

    (Added to an old rack, it would also draw keys to that rack's other shards:
    the rack's weight rises and some keys that move there land beside it.)
    """
    n, i = max(tree.shards()) + 1, len(tree.children)
    leaf = Node(f"r{i}k0s0", weight, n)
    return replace(tree, children=(*tree.children, Node(f"r{i}", children=(Node(f"r{i}k0", children=(leaf,)),))))


def reweigh(tree: Node, shard: int, weight: float) -> Node:
    """The tree with another weight for one shard."""
    if tree.shard is not None:
        return replace(tree, weight=weight) if tree.shard == shard else tree
    return replace(tree, children=tuple(reweigh(c, shard, weight) for c in tree.children))


def draw_sql(key: str, name: str, weight: float, to_long: str) -> str:
    """Waiting time of one child: -ln(u)/weight, u from the first 13 hex digits (52 bits) of an MD5."""
    digits = f"substr(md5(concat({key}, ':{name}')), 1, 13)"
    return f"(-ln(({to_long.format(digits)} + 0.5) / 4503599627370496.0) / {weight!r})"


SPARK_LONG, DUCK_LONG = "cast(conv({}, 16, 10) as bigint)", "cast(('0x' || {}) as bigint)"


def place_sql(tree: Node, key: str, to_long: str = SPARK_LONG) -> str:
    """SQL for the shard of ``key`` (a string expression): nested CASEs, one per inner node."""
    if tree.shard is not None:
        return str(tree.shard)
    live = [c for c in tree.children if c.total() > 0]
    if not live:
        raise ValueError(f"{tree.name} has no weight")
    if len(live) == 1:
        return place_sql(live[0], key, to_long)
    draws = [draw_sql(key, c.name, c.total(), to_long) for c in live]
    least = f"least({', '.join(draws)})"
    arms = " ".join(f"when {d} <= {least} then {place_sql(c, key, to_long)}" for d, c in zip(draws[:-1], live))
    return f"(case {arms} else {place_sql(live[-1], key, to_long)} end)"


KEY = "coalesce(cast({} as string), 'null')"


def place(tree: Node, key_column: str) -> Column:
    return F.expr(place_sql(tree, KEY.format(f"`{key_column}`")))


def shard(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """Each row's shard under ``tree`` and under ``grow(tree)``, and its slot in the shard.

    Returns key, size (UTF-8 bytes plus 1), text_crc32, shard, grown_shard, slot.
    Slots are gapless from 0 in the order of (bucket, key, text_crc32, size), where
    ``buckets`` hash buckets split every shard: a shard is never sorted as one
    group. Raise ``buckets`` with rows per shard. Only these short columns are
    shuffled, never texts. A null key is a key like another; a null text has no
    bytes; repeated rows take a slot each; other columns are not carried.
    """
    from tallyweave.llm.common import written

    data = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("key"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        place(tree, key).cast("int").alias("shard"), place(grow(tree), key).cast("int").alias("grown_shard"),
        F.expr(bucket_sql(KEY.format(f"`{key}`"), buckets)).alias("bucket"))
    base = written(base, "shards")
    starts = base.groupBy("shard", "bucket").agg(F.count("*").alias("n")).selectExpr(
        "shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as first_slot")
    ranked = base.selectExpr("*", "row_number() over (partition by shard, bucket order by key, text_crc32, size) - 1 as rank")
    if len(tree.shards()) * buckets <= 1 << 17:  # at most one row per shard and bucket
        starts = F.broadcast(starts)
    return (ranked.join(starts, ["shard", "bucket"])
            .select(F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard",
                    (F.col("first_slot") + F.col("rank")).cast("long").alias("slot")))


def bucket_sql(key: str, buckets: int, to_long: str = SPARK_LONG) -> str:
    digits = f"substr(md5(concat({key}, ':bucket')), 1, 13)"
    return f"{to_long.format(digits)} % {buckets}"


#: 16 shards: 4 regions of 2 racks of 2 shards.
PRODUCTION = (4, 2, 2)


def op6(docs: DataFrame) -> DataFrame:
    out = shard(docs, build_tree(*PRODUCTION))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_sql() -> str:
    tree = build_tree(*PRODUCTION)
    key = KEY.format("doc_id").replace("string", "varchar")
    # DuckDB has no CRC-32, so a table and a list fold over the bytes compute it
    return f"""
with crc_table as (
  with recursive step(b, k, c) as (
    select range, 0, range::BIGINT from range(256)
    union all
    select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::BIGINT) else c >> 1 end from step where k < 8)
  select list(c order by b) as tab from step where k = 8),
d as (select doc_id, coalesce(text, '') as t from documents),
p as (select doc_id, octet_length(encode(t)) + 1 as size,
  xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[xor(a & 255, b)::INT + 1]))) as text_crc32,
  {place_sql(tree, key, DUCK_LONG)} as shard,
  {place_sql(grow(tree), key, DUCK_LONG)} as grown_shard,
  {bucket_sql(key, 1024, DUCK_LONG)} as bucket
  from d, crc_table)
select doc_id, size::BIGINT as size, text_crc32, 'key' as law, shard::INT as shard,
  row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size) - 1 as slot,
  grown_shard::INT as grown_shard from p
"""
