"""Hashes of words and windows of text batches, and exact counts of hashes over all batches.

Texts are dealt into batches of about equal bytes. A batch asks how often its
distinct hashes occur in all batches: it sends them by hash range, with its
own counts (so what is frequent is summed before the shuffle), and each range's
answer comes back in the order asked. Nothing goes through the driver, and a hash
that every text has costs one entry a batch. Long texts are hashed in overlapping
parts, so what a task holds is a few times its largest text and no more.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.common import delete, shared_dir, written

#: Bytes at which a batch is closed, and of text that is hashed at a time; batches for each hash range.
BYTES, BATCHES = 1 << 21, 8
ASKED = "batch long, part int, bucket int, hashes binary, checks binary, counts binary"
REPLIES = "batch long, level int, part int, bucket int, totals binary"
#: Counts end here; nothing asks for more than whether tokens are equally frequent beyond it.
MOST = 65535

U = np.uint64
TIMES = U(0x9E3779B97F4A7C15)
WHITE = re.compile(rb"[\t-\r ]")
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BLOCK_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of the longest word that is hashed together with others.
LONG = 64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves all bits of the output."""
    x = x + U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word (2 x words), and where words start: runs of bytes other than space and 9 to 13.

    A word is taken in blocks of 8 bytes; after each, both halves are mixed in ways
    of their own. Mixing is no linear map, so no two words agree for reasons of algebra.
    """
    b = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[b], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    size = end - start
    blocks = np.ndarray((len(b) + 1,), "<u8", text + bytes(8), strides=(1,))
    h = mixed(np.stack([size.astype(np.uint64), ~size.astype(np.uint64)]))
    live = np.flatnonzero(size <= LONG)
    at, left = start[live], size[live]
    while len(live):
        x = blocks[at] & BLOCK_MASK[np.minimum(left, 8)]
        h[0, live] = mixed(h[0, live] ^ x)
        h[1, live] = mixed((h[1, live] + x) * TIMES, 1)
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        h[:, k] = np.frombuffer(xxhash.xxh3_128_digest(text[start[k]:end[k]], seed=35), "<u8")
    return h, start


def longer(x: np.ndarray, have: int, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words from those of ``have`` words, by doubling: two windows, overlapping at last, make one."""
    if len(x) < n - have + 1:
        return np.zeros(0, np.uint64)
    while have < n:
        step = min(have, n - have)
        x = mixed(x[:-step] * TIMES + x[step:])
        have += step
    return x


def chunks(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about BYTES, cut at white space."""
    at = 0
    while len(text) - at > BYTES and (m := WHITE.search(text, at + BYTES)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def parts(texts: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Word hashes of a batch, some BYTES of text at a time, and the pieces among them: (text, number of its first word, words).

    Where a text is cut, its next piece begins with the last ``overlap`` words of
    the one before: every window of ``overlap + 1`` words is in just one piece.
    Every text has a piece, if an empty one.
    """
    held: list[tuple[int, int, np.ndarray, bytes]] = []
    size = 0
    none = np.zeros((2, 0), np.uint64)

    def hashed() -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        h, start = word_hashes(b"\n".join(c for *_, c in held))
        cut = np.searchsorted(start, np.cumsum([0, *(len(c) + 1 for *_, c in held)])).tolist()
        pieces = [(i, first, tail.shape[1] + z - a) for (i, first, tail, _), a, z in zip(held, cut, cut[1:])]
        if any(tail.shape[1] for _, _, tail, _ in held):
            h = np.concatenate([x for (_, _, tail, _), a, z in zip(held, cut, cut[1:]) for x in (tail, h[:, a:z])], axis=1)
        return h, pieces

    for i, text in enumerate(texts):
        first, tail = 0, none
        for chunk in chunks(text):
            held.append((i, first, tail, chunk))
            size += len(chunk)
            if size >= BYTES or len(chunk) < len(text):
                h, pieces = hashed()
                yield h, pieces
                n = pieces[-1][2]
                tail = h[:, h.shape[1] - min(n, overlap):]
                first += n - tail.shape[1]
                held, size = [], 0
    if held:
        yield hashed()


def by_bytes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column ``batch``: neighbouring rows whose ``column`` (text, or lists of long) has about BYTES together.

    A batch is closed once it has as many, so it exceeds that by less than one row.
    """
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, first = 0, TaskContext.get().partitionId() << 36
        for b in batches:
            values = b.column(at)
            size = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
            size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            sums = before + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + (sums - size) // BYTES, pa.int64())], names=schema.names)
            before = int(sums[-1]) if len(sums) else before

    return df.mapInArrow(deal, schema)


class Batched:
    """``docs`` with a fixed column ``batch``, kept by it in the shared folder: later passes
    read a batch's rows together without another shuffle."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.spark = docs.sparkSession
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"batches_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        (by_bytes(docs, text).repartition(n, "batch").write.bucketBy(n, "batch").sortBy("batch").option("path", self.path).saveAsTable(self.name))
        self.rows = self.spark.table(self.name)
        #: Hash ranges: as many as there are shuffle partitions, or more where the input has more batches.
        self.buckets = max(n, self.rows.select("batch").distinct().count() // BATCHES)

    def discard(self) -> None:
        """Forget the table and delete its files, once nothing reads it any more."""
        self.spark.sql(f"drop table if exists {self.name}")
        delete(self.spark, self.path)


#: Hashes that were chosen for being small would crowd the first ranges, so ranges are of hashes mixed once more.
SPREAD = 1


def ask(batch: int, part: int, hashes: np.ndarray, buckets: int, checks: np.ndarray | None = None) -> pa.Table:
    """Rows of ASKED for the hashes of a batch's part (any order, repeated ones too); with ``checks``, keys have 128 bits."""
    hashes = mixed(hashes, SPREAD)
    if checks is None:
        keys, counts = np.unique(hashes, return_counts=True)
    else:
        order = np.lexsort((checks, hashes))
        keys, checks = hashes[order], checks[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])) if len(keys) else np.zeros(0, int)
        counts = np.diff(first, append=len(keys))
        keys, checks = keys[first], checks[first]
    at = edges(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    counts = np.minimum(counts, MOST).astype("<u2")

    def cut(x: np.ndarray | None) -> list[bytes]:
        return [b"" if x is None else x[at[k]:at[k + 1]].tobytes() for k in full]

    return pa.table({"batch": pa.array([batch] * len(full), pa.int64()), "part": pa.array([part] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
                     "hashes": pa.array(cut(keys), pa.binary()), "checks": pa.array(cut(checks), pa.binary()), "counts": pa.array(cut(counts), pa.binary())})


def edges(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each range of sorted hashes starts."""
    return np.searchsorted(keys, np.array([-(-(k << 64) // buckets) for k in range(buckets)] or [0], dtype=np.uint64)).tolist() + [len(keys)]


def answer(asked: DataFrame, level: int) -> DataFrame:
    """Rows of REPLIES: how often each asked hash occurs over all batches (at most MOST), in the order asked."""

    def totals(t: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(t["hashes"].to_pylist()), np.uint64)
        checks = np.frombuffer(b"".join(t["checks"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(t["counts"].to_pylist()), "<u2").astype(np.int64)
        if len(checks):
            order = np.lexsort((checks, keys))
            new = np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)])
            group = np.empty(len(keys), np.int64)
            group[order] = np.cumsum(new) - 1
        else:
            group = np.unique(keys, return_inverse=True)[1]
        total = np.minimum(np.bincount(group, weights=counts), MOST).astype("<u2")[group].tobytes()
        cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in t["hashes"].to_pylist()])])
        return pa.table({"batch": t["batch"].combine_chunks(), "level": pa.array([level] * len(t), pa.int32()), "part": t["part"].combine_chunks(), "bucket": t["bucket"].combine_chunks(),
                         "totals": pa.array([total[a:b] for a, b in zip(cut, cut[1:])], pa.binary())})

    return written(asked.groupBy("bucket").applyInArrow(totals, REPLIES), "replies")


def told(replies: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """A batch's answers by level and part, each in the order of the mixed hashes."""
    found = defaultdict(list)
    for level, part, _, x in sorted(zip(*(replies[c].to_pylist() for c in ("level", "part", "bucket", "totals")))):
        found[level, part].append(x)
    return {k: np.frombuffer(b"".join(x), "<u2") for k, x in found.items()}


def totals_of(answers: dict[tuple[int, int], np.ndarray], level: int, part: int, keys: np.ndarray) -> np.ndarray:
    """The totals of ``keys``, the sorted distinct hashes that the part asked for at ``level``."""
    got = answers.get((level, part), np.zeros(0, "<u2"))
    if len(got) != len(keys):
        raise RuntimeError(f"{len(got)} answers to {len(keys)} questions")
    out = np.empty_like(got)
    out[np.argsort(mixed(keys, SPREAD), kind="stable")] = got
    return out


def texts_of(t: pa.Table, column: str = "text") -> list[bytes]:
    """UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in t[column].cast(pa.binary()).to_pylist()]
