"""Substring dedup by level-wise doubling.

Windows of a short length are counted first; only what repeats is extended to
twice the length and counted again, until the asked length is reached or no
candidate is left. Below the asked length one window stands for a whole
neighbourhood: each window of the asked length is represented by the smallest
hash of the short windows in it. Equal long windows have equal representatives at
the same offset, so none is lost, and only about one short window in ten is
counted. At the asked length every candidate is counted, with 128-bit keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.common import written
from tallyweave.llm.windows import ASKED, REPLIES, Batched, answer, ask, chunks, longer, mixed, parts, texts_of, told, totals_of


def lengths(window: int, least: int = 8) -> list[int]:
    """Lengths of the levels, each twice the one before (the last is ``window``)."""
    out = [window]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def least_in(x: np.ndarray, n: int) -> np.ndarray:
    """Where the smallest of each run of ``n`` values stands (the first, among equals), by doubling."""
    at, have = np.arange(len(x)), 1
    while have < n:
        step = min(have, n - have)
        a, b = at[:-step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        have += step
    return at


class Candidates:
    """Windows of ``window`` words in one part of a batch that may still repeat."""

    def __init__(self, words: np.ndarray, counts: list[int], window: int):
        ok = np.zeros(words.shape[1], bool)
        a = 0
        for n in counts:
            ok[a:a + max(0, n - window + 1)] = True
            a += n
        self.window, self.live = window, np.flatnonzero(ok)  # where they start
        self.x, self.check = mixed(words)
        self.have = 1

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Hashes and checks of the places that stand for the candidates, and which place each candidate has."""
        if not len(self.live):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64) if n == self.window else None, np.zeros(0, np.int64)
        self.x, self.have = longer(self.x, self.have, n), n
        if n == self.window:
            return self.x[self.live], longer(self.check, 1, n)[self.live], np.arange(len(self.live))
        place, of = np.unique(least_in(self.x, self.window - n + 1)[self.live], return_inverse=True)
        return self.x[place], None, of

    def keep(self, n: int, level: int, part: int, answers: dict) -> None:
        """Drop the candidates whose representative occurs once."""
        hashes, checks, of = self.level(n)
        if checks is None:
            keys, back = np.unique(hashes, return_inverse=True)
        else:
            order = np.lexsort((checks, hashes))
            new = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0)])[:len(hashes)]
            back = np.empty(len(hashes), np.int64)
            back[order] = np.cumsum(new) - 1
            keys = hashes[order][new]
        totals = totals_of(answers, level, part, keys)
        self.live = self.live[(totals >= 2)[back][of]] if len(of) else self.live


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 and, if asked, kept_text.

    A word goes if some window of ``window`` words covers it whose word sequence
    starts anywhere else too, in the same text or another (exact copies of a text
    included). Windows are judged on the input. Kept words are joined by one
    space. A null or empty text has no words; null and repeated keys are rows
    like others; other columns are not carried; a table without rows gives none.
    What a frequent window costs does not grow with its number but with the
    batches that have it. A very long text is a batch of its own, hashed in parts.
    """
    spark = docs.sparkSession
    held = Batched(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"))
    rows, buckets = held.rows, held.buckets
    steps = lengths(window)
    none = spark.createDataFrame([], REPLIES)
    replies = none

    def candidates(t: pa.Table, answers: dict, level: int) -> Iterator[tuple[int, Candidates, list[tuple[int, int, int]]]]:
        """Of each part, those that the levels before ``level`` left, and its pieces."""
        for k, (words, pieces) in enumerate(parts(texts_of(t), window - 1)):
            c = Candidates(words, [n for _, _, n in pieces], window)
            for done in range(level):
                c.keep(steps[done], done, k, answers)
            yield k, c, pieces

    def questions(level: int):
        def run(t: pa.Table, replies: pa.Table) -> pa.Table:
            asked = [ask(0, 0, np.zeros(0, np.uint64), buckets)]
            for k, c, _ in candidates(t, told(replies), level):
                hashes, checks, _ = c.level(steps[level])
                asked.append(ask(t["batch"][0].as_py(), k, hashes, buckets, checks))
            return pa.concat_tables(asked)

        return run

    for level in range(len(steps)):
        asked = rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(questions(level), ASKED)
        replies = replies.union(answer(asked, level))

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text).fields])

    def finish(t: pa.Table, replies: pa.Table) -> pa.Table:
        texts = texts_of(t)
        last: dict[int, int] = {}  # words of each text
        covered: list[tuple[int, np.ndarray]] = []  # text, numbers of the words where its removed windows start
        for _, c, pieces in candidates(t, told(replies), len(steps)):
            a = 0
            for i, first, n in pieces:
                last[i] = first + n
                own = c.live[slice(*np.searchsorted(c.live, [a, a + n]))]
                if len(own):
                    covered.append((i, own - a + first))
                a += n
        keep = {}
        for i, starts in covered:
            change = keep.setdefault(i, np.zeros(last[i] + 1, np.int32))
            np.add.at(change, starts, 1)
            np.add.at(change, starts + window, -1)
        out = []
        for i, x in enumerate(texts):
            k = np.cumsum(keep.pop(i))[:-1] == 0 if i in keep else np.ones(last[i], bool)
            digest, kept, at, sep = hashlib.sha256(), [], 0, b""
            for chunk in chunks(x):
                words = chunk.split()
                left = list(compress(words, k[at:at + len(words)].tolist()))
                at += len(words)
                if left:
                    joined = sep + b" ".join(left)
                    sep = b" "
                    digest.update(joined)
                    if with_text:
                        kept.append(joined)
            out.append((at, at - int(np.count_nonzero(k)), digest.hexdigest(), *([b"".join(kept).decode()] if with_text else ())))
        columns = list(zip(*out)) if out else [()] * len(schema.names[1:])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([t["key"].combine_chunks(), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    out = written(rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(finish, schema), "kept")
    held.discard()
    return out
