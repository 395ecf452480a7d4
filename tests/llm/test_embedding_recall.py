"""Recall of the embedding index where near copies lie in the directions in which the data varies."""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import embeddings
from tests.llm.test_exact import tables_left

KINDS = ("clusters", "random")


def vectors(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "random":
        return embeddings.unit(rng.standard_normal((n, 64)))
    centres = embeddings.unit(np.random.default_rng(1).standard_normal((40, 64)))
    return embeddings.unit(centres[rng.integers(40, size=n)] + 0.15 * rng.standard_normal((n, 64)) * np.linspace(1, 0.02, 64))


def copies(y, x, direction, rng):
    """A near copy of each row of ``y``, at a cosine just above 0.98, where ``x`` is what else there is."""
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2]
    side = {"axes": axes[rng.integers(3, size=len(y))], "other": x[rng.integers(len(x), size=len(y))] - y, "any": rng.standard_normal(y.shape)}[direction]
    side = side - (side * y).sum(1)[:, None] * y
    c = rng.uniform(0.9801, 0.9805, (len(y), 1))
    return c * y + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1)[:, None]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("k", [12, 100, 300])
def test_recall_of_grids(kind, k):
    rng, sample = np.random.default_rng(k), vectors(kind, 8192, 5)
    grid = embeddings.fit_grid(sample, 0.98, k)
    for direction in ("axes", "other", "any"):
        y = vectors(kind, 1500, 6)
        z = copies(y, sample, direction, rng)
        found = np.zeros(len(y), bool)
        for v, home in ((y, grid.home(z)), (z, grid.home(y))):
            row, cell = grid.visits(v)
            found[row[cell == home[row]]] = True
        print(f"{kind}, {k} codewords, {direction}: recall {found.mean():.4f}, {len(grid.visits(y)[0]) / len(y):.1f} cells visited")
        assert found.mean() >= 0.99


@pytest.mark.parametrize("kind", KINDS)
def test_recall_of_the_operator(spark, monkeypatch, kind):
    """6000 vectors of one group in a grid of 100 codewords a half, against all cosines."""
    monkeypatch.setattr(embeddings, "CELL", 0.6)
    x = vectors(kind, 3000, 7)
    x = np.concatenate([x, copies(x, x, "axes", np.random.default_rng(9))])
    want = (x @ x.T >= 0.98).sum(1) - 1
    before = tables_left(spark)
    got = embeddings.near_dedup(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4))
    have = {r["vec_id"]: r["n_links"] for r in got.collect()}
    assert len(tables_left(spark) - before) == 1
    found = sum(have.values()) / want.sum()
    print(f"{kind}: recall {found:.4f} of {want.sum()} links")
    assert found >= 0.99 and all(have[i] <= n for i, n in enumerate(want))


def test_sample_without_a_shuffle_of_vectors(spark, monkeypatch):
    """Whatever number of vectors there is, no exchange that gathers a length carries them."""
    monkeypatch.setattr(embeddings, "SAMPLE", 100)
    x = vectors("random", 3000, 2)
    rows = [(i, 0, 64, i, 1, r.tolist()) for i, r in enumerate(x)] + [(5000, 0, 3, 5000, 1, [1.0, 2.0, 3.0])]
    classes = spark.createDataFrame(rows, "id long, grp int, dim int, node long, copies long, vector array<double>")
    said, taken = [], []
    frame = type(classes)
    to_pandas = frame.toPandas

    def spy(self):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            self.explain()
        said.append(text.getvalue())
        taken.append(out := to_pandas(self))
        return out

    monkeypatch.setattr(frame, "toPandas", spy)
    grids = embeddings._grids(classes.withColumn("vector", F.col("vector")), 0.98)
    assert set(grids) == {64, 3} and 50 <= len(taken[0]) <= 200
    assert "Window" not in said[0] and "hashpartitioning" not in said[0]
