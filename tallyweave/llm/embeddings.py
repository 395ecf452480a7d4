"""Embedding near-dedup with an inverted multi-index.

Each half of a unit vector has a codebook of its own; their product is a grid of
cells. A vector is stored in the cell of its nearest codewords. As a query it
visits cells in the order of the multi-sequence traversal (summed distance of
both halves) until the target recall is reached, and what it finds is verified by
exact cosines, in blocks. Links are counted and joined to components without ever
writing out all pairs. Grids have more cells the more vectors there are, so that
what a cell holds stays about the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import Tables, connected_components, discard

#: Vectors of one length that codebooks are fitted on, at most; from LENGTHS lengths on, a share of LENGTHS times as many.
SAMPLE, LENGTHS = 8192, 16
#: Vectors of a group in a cell, about, and the least and most codewords a half (beyond the most, about 2**26 vectors of a group, cells grow).
CELL, LEAST, MOST = 64, 4, 1024
#: Share of links just at the threshold, in whichever kind of direction has fewest, of which one end visits the other's cell.
RECALL = 0.997
#: Vectors in a block of the verification.
BLOCK = 512


@dataclass
class Grid:
    """Codebooks of both halves and how far beyond the nearest cell the traversal goes."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return tuple(((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)) for y, c in ((x[:, :h], self.first), (x[:, h:], self.second)))

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits: a multi-sequence traversal by rank in the first codebook. Each step takes
        of the second, nearest first, what the summed distance leaves within reach; it ends where nothing is."""
        a, b = self.distances(x)
        ra, rb = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, ra, 1), np.take_along_axis(b, rb, 1)
        a, b = a - a[:, :1], b - b[:, :1]
        rows, cells = [], []
        for i in range(a.shape[1]):
            active = np.flatnonzero(a[:, i] <= self.reach)
            if not len(active):
                break
            row, j = np.nonzero(b[active] <= self.reach - a[active, i][:, None])
            rows.append(active[row])
            cells.append(ra[active[row], i] * len(self.second) + rb[active[row], j])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(row, kind="stable")
        return row[order], cell[order]


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; fewer distinct points give fewer codewords, and points of no dimension one."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def codewords(members: float) -> int:
    """Codewords a half for groups of so many vectors: the grid has the square of it in cells."""
    return int(min(MOST, max(LEAST, round((members / CELL) ** 0.5))))


def directions(x: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(vectors, direction of a near copy of each) by kind, for rows ``own`` of a sample ``x``: any direction, towards other
    vectors, towards one of the nearest, and along the axes in which the sample, or what surrounds the vector, varies most."""
    n = max(4000, len(own))
    sign = lambda: rng.choice([-1.0, 1.0], (n, 1))
    y = x[rng.choice(own, n)]
    out = {"any": (y, rng.standard_normal(y.shape)), "other": (y, sign() * (x[rng.integers(len(x), size=n)] - y))}
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    out["axes"] = y, sign() * axes[rng.integers(min(3, len(axes)), size=n)]
    if len(x) > 2:
        probe = rng.permutation(own)[:512]
        product = x[probe] @ x.T
        product[np.arange(len(probe)), probe] = -np.inf
        near = np.argsort(-product, 1)[:, :min(32, len(x) - 1)]
        local = np.stack([np.linalg.svd(x[i] - x[i].mean(0), full_matrices=False)[2][:3] for i in near])
        k = rng.integers(len(probe), size=n)
        y = x[probe[k]]
        out["near"] = y, sign() * (x[near[k, rng.integers(near.shape[1], size=n)]] - y)
        out["around"] = y, sign() * local[k, rng.integers(local.shape[1], size=n)]
    return out


def fit_grid(x: np.ndarray, threshold: float, k: int, seed: int = 5) -> Grid:
    """Codebooks from three quarters of a sample of unit vectors. ``reach`` is measured on the rest, as fitted ones lie
    closer to their codewords: they get neighbours at exactly the threshold in each kind of ``directions``, and of the
    kind that needs most, RECALL of the links must be found."""
    rng = np.random.default_rng(seed)
    h = x.shape[1] // 2
    rest = rng.permutation(len(x))[:len(x) // 4] if len(x) >= 32 else np.arange(len(x))
    fitted = np.delete(x, rest, 0) if len(x) >= 32 else x
    grid = Grid(codebook(fitted[:, :h], k, rng), codebook(fitted[:, h:], k, rng), 0.0)
    for y, side in directions(x, rest, rng).values():
        side = side - (side * y).sum(1)[:, None] * y
        size = np.linalg.norm(side, axis=1)
        y, side = y[size > 1e-9], side[size > 1e-9] / size[size > 1e-9][:, None]
        if len(y):
            ends = [grid.distances(v) for v in (y, threshold * y + np.sqrt(1 - threshold**2) * side)]
            homes = [(a.argmin(1), b.argmin(1)) for a, b in ends]
            rows = np.arange(len(y))
            # a link is found where either end visits the other's cell
            excess = np.minimum(*(a[rows, i] + b[rows, j] - a.min(1) - b.min(1) for (a, b), (i, j) in zip(ends, homes[::-1])))
            grid.reach = max(grid.reach, float(np.quantile(excess, RECALL)) + 1e-9)
    return grid


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled first, so that huge and tiny vectors neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(threshold: float):
    """For the vectors stored in one block of a cell and the queries of one block that visit it:
    (id, node, links, other): links found, weighted by copies, and with ``other`` a link of a spanning forest."""

    def run(stored: pa.Table, asking: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(stored) and len(asking):
            m, q = unit(matrix(stored["vector"])), unit(matrix(asking["vector"]))
            mid, qid = stored["id"].to_numpy(), asking["id"].to_numpy()
            mn, qn = stored["node"].to_numpy(), asking["node"].to_numpy()
            link = (q @ m.T >= threshold) & (qid[:, None] != mid)
            copies, ask_copies = stored["copies"].to_numpy(), asking["copies"].to_numpy()
            counts = link @ copies
            i = np.flatnonzero(counts)
            rows += [(*x, None) for x in zip(qid[i].tolist(), qn[i].tolist(), counts[i].tolist())]
            # a stored vector that does not visit the query's home counts the link here, others count it there
            home = asking["home"].to_numpy()
            back = np.zeros(len(m), np.int64)
            away = np.flatnonzero(link.any(0))
            visited = stored["visited"].take(pa.array(away)).to_pylist()
            for j, cells in zip(away.tolist(), visited):
                k = np.flatnonzero(link[:, j])
                back[j] = ask_copies[k[~np.isin(home[k], cells)]].sum()
            j = np.flatnonzero(back)
            rows += [(*x, None) for x in zip(mid[j].tolist(), mn[j].tolist(), back[j].tolist())]
            rows += [(int(qid[a]), int(qn[a]), 0, int(mn[b])) for a, b in forest(link)]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "node", "links", "other"])

    return run


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that span the same components as the bipartite graph ``link``."""
    edges, rows_left, columns_left = [], link.any(1), link.any(0)
    while rows_left.any():
        r = int(rows_left.argmax())
        rows_left[r] = False
        front = [r]
        while front:
            columns: list[int] = []
            for a in front:
                for b in np.flatnonzero(link[a] & columns_left).tolist():
                    columns_left[b] = False
                    edges.append((a, b))
                    columns.append(b)
            front = []
            for b in columns:
                for a in np.flatnonzero(link[:, b] & rows_left).tolist():
                    rows_left[a] = False
                    edges.append((a, b))
                    front.append(a)
    return edges


def near_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Rows link when ``group`` is equal and the cosine of their vectors, in double
    precision, is at least ``threshold`` and the index finds the pair. n_links
    counts linked other rows, component_id is the smallest key reachable, kept
    says whether it is the row's own. Vectors that are null, empty, zero or hold
    null or non-finite numbers, rows with a null group or key, link with nothing
    (a null key has a null component and kept false). Vectors of different
    lengths don't link; of one number, those of the same sign do. Equal vectors
    are stored once with their number; rows that share a key are one node of the
    graph. Keys are whole numbers, others an error. Other columns are not
    carried; a table without rows gives none.
    """
    if not isinstance(vectors.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is {vectors.schema[key].dataType.simpleString()}, not a whole number")
    v = F.col("vector")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(group).alias("grp"), F.col(vector).alias("vector"))
    big = F.array_max(F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), float("inf")).otherwise(F.abs(x))))
    usable = F.coalesce(F.col("key").isNotNull() & F.col("grp").isNotNull() & (F.size(v) > 0) & (big > 0) & (big < float("inf")), F.lit(False))
    # vectors of one number are their sign, so all of them are copies of two
    alike = F.when(F.size(v) == 1, F.transform(v, lambda x: F.signum(x).cast(vectors.schema[vector].dataType.elementType))).otherwise(v)
    coded = (rows.withColumn("vector", F.when(usable, alike)).withColumn("dim", F.size("vector"))
             .withColumn("code", F.when(usable, F.xxhash64("vector"))).withColumn("check", F.when(usable, F.xxhash64(F.lit(7), "vector"))))
    by = ["grp", "dim", "code", "check"]
    with Tables() as t:
        classes = coded.where("code is not null").groupBy(*by, "vector").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
        classes = t.written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        links = _links(classes.select("id", "grp", "dim", "node", "copies", "vector"), threshold, t)
        counts = links.groupBy("id").agg(F.sum("links").alias("links"))
        edges = links.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
        named = classes.select("id", *by, "node", "copies").join(counts, "id", "left").select(*by, "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        rows = t.written(coded.select("key", *by).join(t.written(named, "named"), by, "left").select("key", "node", "n_links"), "rows")
        # copies stay out of the graph: only a key that has several vectors links them
        several = rows.where("node is not null").select("key", "node").distinct().groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1").select("key")
        own = rows.join(several, "key", "left_semi").select(F.col("key").alias("u"), F.col("node").alias("v")).where("u <> v")
        found = connected_components(edges.union(own))
        components = t.written(found.select(F.col("node").alias("reached"), "component"), "components")
        discard(found)
        out = rows.join(components, F.col("node") == F.col("reached"), "left").withColumn("component", F.coalesce("component", "node", "key"))
        return t.result(out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"),
                                   F.coalesce(F.col("component") == F.col("key"), F.lit(False)).alias("kept")), "near")


def _grids(classes: DataFrame, threshold: float) -> dict[int, Grid]:
    """A grid for each length, from a bounded sample of its vectors: those whose hash is below a bound set by their number.

    It has the cells that the groups call for in which the average vector is.
    """
    size = classes.groupBy("grp", "dim").count().groupBy("dim").agg((F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).alias("members"), F.sum("count").alias("n"))
    lengths = {r["dim"]: r for r in size.collect()}  # a row for each length
    most = SAMPLE if len(lengths) <= LENGTHS else max(64, SAMPLE * LENGTHS // len(lengths))
    # hashes are even, so about ``most`` of a length are below the bound; no vector is moved to be sorted
    bounds = [(d, min(2**63 - 1, -2**63 + int(2**64 * min(1.0, most / r["n"])))) for d, r in lengths.items()]
    below = classes.sparkSession.createDataFrame(bounds, "dim int, bound long")
    sample = classes.join(F.broadcast(below), "dim").where(F.xxhash64("node", "vector") <= F.col("bound")).select("dim", "vector").toPandas()
    few = classes.groupBy("dim").agg(F.min_by("vector", "id").alias("vector")).where(~F.col("dim").isin(*set(sample["dim"].tolist()))) if set(lengths) - set(sample["dim"]) else None
    sample = sample if few is None else pd.concat([sample, few.toPandas()])
    return {int(d): fit_grid(unit(np.array(part["vector"].tolist(), np.float64)), threshold, codewords(lengths[d]["members"])) for d, part in sample.groupby("dim")}


def _links(classes: DataFrame, threshold: float, t: Tables) -> DataFrame:
    held = classes.sparkSession.sparkContext.broadcast(_grids(classes, threshold))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for d in set(t["dim"].to_pylist()):
                part = t.filter(pa.compute.equal(t["dim"], d))
                grid = held.value[d]
                step = max(16, (1 << 20) // (len(grid.first) + len(grid.second)))
                for at in range(0, len(part), step):
                    p = part.slice(at, step)
                    x = unit(matrix(p["vector"]))
                    row, cell = grid.visits(x)
                    visited = np.split(cell, np.searchsorted(row, np.arange(1, len(p))))
                    yield from p.append_column("home", pa.array(grid.home(x), pa.int64())).append_column("visited", pa.array(list(visited), pa.list_(pa.int64()))).combine_chunks().to_batches()

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    placed = t.written(classes.mapInArrow(visit, f"{ddl}, home long, visited array<long>"), "placed")
    asking = placed.withColumn("cell", F.explode("visited"))
    cell = ["grp", "dim", "cell"]
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = (placed.groupBy("grp", "dim", F.col("home").alias("cell")).agg(F.count("*").alias("n_stored"))
             .join(asking.groupBy(*cell).agg(F.count("*").alias("n_asking")), cell)
             .select(*cell, blocks("n_stored").alias("stored_blocks"), blocks("n_asking").alias("asking_blocks")))
    sizes = t.written(sizes, "sizes")  # so that joins with it can be split where a cell is crowded
    deal = F.xxhash64("id", "cell")

    def part(n: str):
        return F.pmod(deal, F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (placed.withColumn("cell", F.col("home")).join(sizes, cell)
            .select("id", "grp", "dim", "node", "vector", "copies", "visited", "cell", part("stored_blocks").alias("s"), every("asking_blocks").alias("a")))
    right = (asking.join(sizes, cell)
             .select("id", "grp", "dim", "node", "vector", "copies", "home", "cell", part("asking_blocks").alias("a"), F.col("stored_blocks"))
             .select("id", "grp", "dim", "node", "vector", "copies", "home", "cell", every("stored_blocks").alias("s"), "a"))
    right = right.toDF(*right.columns)  # columns of its own for the cogroup
    by = [*cell, "s", "a"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(block_links(threshold), "id long, node long, links long, other long")
    out = t.written(found, "links")
    t.drop(placed, sizes)
    held.unpersist()
    return out
