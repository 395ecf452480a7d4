"""Cross-tokenizer alignment against a plain loop, with small blocks and slices, and with awkward tables."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark import cloudpickle

from tallyweave.llm import alignment
from tests.llm.test_exact import ordered, tables_left

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, block long, kind string, n_a long, rows string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, "r") for i, t in rows], DOCS).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "und", "été", "ﬁ", "１２", "日本語", "don't", "x" * 40, "<s>", "<|endoftext|>", "<0x41>", "😀", "naïve", "12345", "é", "\x1c", "a b", "ß."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(70)]
    texts += ["", None, " ", "  two  spaces ", "\n\n\t", "▁", "a▁b", "\x00", "the", "﻿x", "a\r\nb", "é ́", "the " * 300]
    texts += [" ".join(rng.choice(words) for _ in range(40_000)), " ".join(rng.choice(words) for _ in range(30_000)) + " a▁b", "x" * 200_000]
    out = [*enumerate(texts)]
    return [*out, out[5], out[5], (None, texts[6]), (None, None)]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(x) for x, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    found, total, memo = [], Counter(), {}
    for key, text in rows:
        if text not in memo:
            links, groups, n_a, n_b = [], [], 0, 0
            if text:
                a = ta.encode(" " + text, add_special_tokens=False).ids
                b = sp.encode(text)
                said_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
                if b"".join(ranks[i] for i in a) == b"".join(said_b) == (" " + text).encode():
                    ends, at = {}, 0
                    for i, x in zip(b, said_b, strict=True):
                        at += len(x)
                        ends[at] = i
                    left, at, k, end_b, n_a, n_b = [], 0, 0, 0, len(a), len(b)
                    for i in a:
                        at += len(ranks[i])
                        left.append(i)
                        if at in ends:
                            right = []
                            while end_b < at:
                                end_b += len(said_b[k])
                                right.append(b[k])
                                k += 1
                            groups.append((left, right))
                            links.append((i, ends[at]))
                            left = []
            memo[text] = links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), n_a, n_b, len(groups)
        found.append((key, memo[text]))
        total.update(memo[text][0])
    top = defaultdict(int)
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    out = []
    for key, (links, groups, n_a, n_b, n) in found:
        out.append((key, n_a, n_b, n, len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups))
    return out, total, top


@pytest.fixture(scope="module")
def want(rows):
    return brute(rows)


def test_alignment(spark, rows, want):
    before = tables_left(spark)
    got = alignment.align(make(spark, rows), A, B, groups=True)
    assert ordered(map(tuple, got.collect())) == ordered(want[0])
    assert len(tables_left(spark) - before) == 1
    assert alignment.align(make(spark, []), A, B).collect() == []
    assert [tuple(r) for r in alignment.align(make(spark, [(1, None), (1, "")]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_small_blocks_and_slices(spark, rows, want, monkeypatch, aqe):
    """Frequent ids are dealt over many slices, documents over many blocks, and sums leave before all are known."""
    for name, value in {"DOCS": 3, "PAIRS": 50, "SLICE": 8, "HELD": 40, "CHUNK": 500, "CALL": 3000}.items():
        monkeypatch.setattr(alignment, name, value)
    cloudpickle.register_pickle_by_value(alignment)  # so that workers see the small sizes
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = alignment.align(make(spark, rows), A, B).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(alignment)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered(map(tuple, got)) == ordered(r[:-1] for r in want[0])


def test_pair_counts(spark, rows, want):
    _, total, top = want
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.pair_counts(make(spark, rows), A, B).collect()}
    assert got == {x: (n, n == top[x[1]]) for x, n in total.items()}


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(alignment, "CHUNK", 20)
    a, b = alignment.Side(A), alignment.Side(B)
    for _ in range(200):
        text = "".join(rng.choice(["a", "été ", " ", "  ", "\n", "1", "x y", "▁", "don't ", "　", ". "]) for _ in range(rng.randrange(200)))
        parts = alignment.pieces(text)
        assert " ".join(parts) == text
        for s in (a, b):
            assert [i for x in s.encode(parts) for i in x] == s.encode([text])[0]
