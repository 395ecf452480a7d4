"""Connected components of graphs that are tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.scratch import discard, written

#: Nodes with more neighbours than this, or than a CENTRES-th of all ends, are joined by broadcast: at most CENTRES rows.
CROWD, CENTRES = 20_000, 20_000


def with_least(rows: DataFrame, low: DataFrame, centres: DataFrame | None) -> DataFrame:
    """``rows`` (u, v) with the m of their u. What a crowded u has doesn't gather in one task: such u are few and broadcast."""
    if centres is None:
        return rows.join(low, "u")
    few = F.broadcast(centres)
    return (rows.join(F.broadcast(low.join(few, "u", "left_semi")), "u")
            .unionByName(rows.join(few, "u", "left_anti").join(low.join(few, "u", "left_anti"), "u")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with long columns ``u``, ``v``: rows ``(node, component)``.

    ``component`` is the smallest node reachable. Alternates two steps until
    nothing changes: each node points its larger neighbours at the smallest
    neighbour (large star), then its smaller neighbours (small star). Rounds grow
    with the logarithm of the longest path, so a long chain ends too. Minima are
    plain aggregates, and the few nodes with very many neighbours are joined by
    broadcast. Nodes without an edge to another node are not returned. Null ends
    and self links are ignored.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        *after, most = degrees.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if after == before or most is None:
            break
        before = after
        crowd = max(CROWD, after[0] // CENTRES)
        # a node has no more neighbours after the large star than before it, as far as it is joined by them
        centres = written(degrees.where(F.col("n") > crowd).select("u"), "centres") if most > crowd else None
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_least(both.where("v > u"), low, centres).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u keeps its smallest neighbour m, and the other smaller ones point at m
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (with_least(large, least, centres).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        new = written(small, "edges")
        discard(e, *([centres] if centres is not None else []))
        e = new
    own = e.groupBy("u").agg(F.min("v").alias("component"))
    return (own.select(F.col("u").alias("node"), "component")
            .union(own.select(F.col("component").alias("node"), "component").distinct()))
