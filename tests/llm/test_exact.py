"""Exact dedup against brute force, with hashes that collide, and with awkward tables."""

from __future__ import annotations

import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave import scratch
from tallyweave.llm import exact

DOCS = "doc_id long, text string, id string, hash string, n long, kept string"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 7, "z") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["", None, " ", "É a", "é a", "É A", "İ", "ſ", "K", "k", "K", "ab\0c", "AB\0C", "x" * 400_000, "X" * 400_000, "x" * 399_999 + "y"]
    texts += [rng.choice(["Hot copy", "hot COPY", "HOT copy"]) for _ in range(300)] + [rng.choice("abAB") * rng.randrange(1, 4) for _ in range(60)]
    rng.shuffle(texts)
    out = [(i * 7 - 900, t) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "hot copy"), (None, "only one"), (None, None), (None, "twice"), (None, "twice"), (2**63 - 1, "edge"), (-2**63, "EDGE")]


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        stays = False
        for i in ids:
            kept = i == keep and not stays
            stays |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("width", [16, 1])
@pytest.mark.parametrize("largest", [True, False])
def test_classes(spark, rows, monkeypatch, width, largest):
    """Hashes of one byte collide: the texts themselves then tell rows apart."""
    monkeypatch.setattr(exact, "WIDTH", width)
    got = exact.classes(table(spark, rows), normal=exact.lower_ascii(F.col("text")), largest=largest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert ordered(map(tuple, got.collect())) == ordered(brute(rows, largest))


def tables_left(spark):
    folder = scratch.shared_dir(spark)
    return {*os.listdir(folder)} if os.path.isdir(folder) else set()


def test_op13_is_native_and_leaves_one_table(spark, rows):
    before = tables_left(spark)
    got = exact.op13(table(spark, rows))
    assert ordered(map(tuple, got.collect())) == ordered(brute(rows, True))
    assert len(tables_left(spark) - before) == 1
    assert exact.op13(table(spark, [])).collect() == []
    before = tables_left(spark)
    with pytest.raises(Exception, match="broken"):
        exact.op13(table(spark, rows).select("doc_id", F.raise_error(F.lit("broken")).cast("string").alias("text")))
    assert len(tables_left(spark) - before) <= 1  # what the failed write itself began


def test_exact_texts_and_whole_rows(spark):
    rows = [(1, "a"), (2, "A"), (3, "a"), (4, None), (5, ""), (6, "b")]
    assert {tuple(r)[:4] for r in exact.classes(table(spark, rows)).collect()} == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True)}
    left = exact.deduplicated(table(spark, rows), normal=exact.lower_ascii(F.col("text")), largest=True)
    assert left.columns == ["doc_id", "text", "id", "hash", "n", "kept"] and {r["doc_id"] for r in left.collect()} == {3, 5, 6}
