"""Packing documents into fixed-length training sequences, keeping their order.

Dynamic programming chooses the cuts of the token stream: windows of at most
``capacity`` tokens, cut at document or sentence boundaries, so that padding plus
truncation penalties are least. The best earlier cut for each boundary is the
minimum of a sliding range, which a monotone queue gives in constant time.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.windows import BYTES, chunks

#: Penalties, in tokens of padding, for a cut at a sentence's end inside a document and anywhere else in it.
SENTENCE_CUT, TOKEN_CUT = 8, 48
#: Sentences closer together than this share one place to cut; stretches without sentences get one every GAP tokens.
LEAST_GAP, GAP = 16, 64
#: Tokens planned at a time; all windows but the last are then final, so memory stays bounded. A plan
#: made so is at most the cost of one window (``capacity`` plus a cut's penalty) for each PLAN tokens above
#: the best one: the best plan can be cut where a stretch ends by adding one window there.
PLAN = 1 << 18
#: Bytes of words and their ids that a task remembers, what an entry takes about besides its word, the longest word among them, and bytes of text encoded in one go.
MEMORY, ENTRY, LONG_WORD, STEP = 3 << 25, 180, 32, 1 << 20


#: A control character that stands as a word between words; words that hold it are encoded singly.
MARK = b"\x01"
#: Letters, then a run of signs: letters of one byte, or also the accented ones of Latin-1.
PLAIN = re.compile(rb"([A-Za-z]+)([.,!?;:*$#%&@]*)")
ACCENTED = re.compile(rb"((?:[A-Za-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:*$#%&@]*)")
#: Byte-level vocabularies write a byte as a character: printable ones of Latin-1 as themselves, the others from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTER = [chr(i) if i in PRINTABLE else chr(256 + sum(k not in PRINTABLE for k in range(i))) for i in range(256)]


class WordEncoder:
    """Token ids by a tokenizers file that ignores white space: each distinct word is encoded once.

    Normalisation and splitting never look across ASCII white space in such a
    tokenizer, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        one, two = (self.t.encode(x, add_special_tokens=False).ids for x in ("a b", "a \n\t b"))
        self.by_word = one == two == [i for x in ("a", "b") for i in self.t.encode(x, add_special_tokens=False).ids]
        mark = self.t.encode(f"a {MARK.decode()} b", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 else None
        self.stops: dict[bytes, bytes] = {}  # stops after words: 1000 short ones at most
        # letters, then signs: does this tokenizer take them as two pieces, lower-cased, and nothing more?
        self.simple = self.by_word and all(
            b"".join(self.one(x) for x in parts) == np.array(self.t.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            for w, parts in (("Reading", [b"reading"]), ("XYLOPHONES.", [b"xylophones", b"."]), ("qzj?!..", [b"qzj", b"?!.."]), ("don,;", [b"don", b",;"]),
                ("Émeuß.%%%", ["émeuß".encode(), b".%%%"]), ("ÀÑÿø@*$#&", ["àñÿø".encode(), b"@*$#&"])))
        self.words: dict[bytes, bytes] = {}
        self.held = 0  # bytes of ``words``, about
        size = self.t.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size + 1, bool)
        for piece, i in self.t.get_vocab(with_added_tokens=True).items():
            if i <= size:
                self.ends[i] = piece.removesuffix("</w>").endswith((".", "!", "?"))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.t.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if max(map(len, texts), default=0) > 2 * BYTES:  # long texts part by part
            return [np.concatenate([x for chunk in chunks(t) for x in self.ids([chunk])]) if len(t) > 2 * BYTES else self.ids([t])[0] for t in texts]
        split = [t.split() for t in texts]
        words = self.words
        new = set().union(*split).difference(words)
        self.learn(new)
        out = [np.frombuffer(b"".join(map(words.__getitem__, x)), "<u4") for x in split]
        self.held += sum(map(len, new)) + ENTRY * len(new)
        for w in new:
            if len(w) > LONG_WORD:
                del words[w]
        if self.held > MEMORY:
            self.forget()
        return out

    def forget(self) -> None:
        self.words.clear()
        self.held = 0

    def one(self, piece: bytes) -> bytes:
        """Ids of a piece that is not split further."""
        said = piece.decode() if piece.isascii() else "".join(map(BYTE_CHARACTER.__getitem__, piece))
        ids = [t.id for t in self.t.model.tokenize(said)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, new: set[bytes]) -> None:
        """Put the ids of ``new`` words into ``words``, and those of the bare words that stand before stops."""
        words, rest = self.words, new
        if self.simple:
            rest = []
            for w in new:
                if m := PLAIN.fullmatch(w):
                    bare, stops = m[1].lower(), m[2]
                elif m := ACCENTED.fullmatch(w):
                    bare, stops = m[1].decode().lower().encode(), m[2]
                else:
                    rest.append(w)
                    continue
                ids = words.get(bare)
                if ids is None:
                    ids = words[bare] = self.one(bare)
                    self.held += len(bare) + ENTRY
                if stops:
                    tail = self.stops.get(stops)
                    if tail is None:
                        tail = self.one(stops)
                        if len(stops) <= LONG_WORD and len(self.stops) < 1000:
                            self.stops[stops] = tail
                    ids += tail
                words[w] = ids
        plain = [w for w in rest if MARK not in w] if self.mark is not None else []
        for i in range(0, len(plain), 4096):  # many words in one call, with a mark between them
            part = plain[i:i + 4096]
            ids = np.array(self.t.encode_batch_fast([(b" " + MARK + b" ").join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            words.update(zip(part, (raw[4 * a:4 * z] for a, z in zip([0, *(x + 1 for x in at)], [*at, len(ids)])), strict=True))
        rest = [w for w in rest if w not in words]
        for w, e in zip(rest, self.t.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            words[w] = np.array(e.ids, "<u4").tobytes()


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker keeps the vocabulary of one file, and no words from task to task."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def places(ids: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a document may be cut (tokens before the cut) and at what penalty; its end costs nothing."""
    n = len(ids)
    found = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    at, cost, last = [], [], 0
    for p in [*found.tolist(), n]:
        if p - last < LEAST_GAP and p < n:
            continue
        while p - last > 2 * GAP:
            last += GAP
            at.append(last)
            cost.append(TOKEN_CUT)
        at.append(p)
        cost.append(0 if p == n else SENTENCE_CUT)
        last = p
    return at, cost


def cuts(at: list[int], cost: list[int], capacity: int, more: bool = False) -> list[int]:
    """The chosen cuts among ``at`` (increasing, gaps of at most ``capacity``), the last always included.

    best(j) = min over i with at[j] - at[i] <= capacity of best(i) + padding + cost[j].
    If there are ``more`` tokens to come, the last window's padding doesn't count.
    """
    place = [0, *at]
    value, back = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best(i) + at[i], i), increasing
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0][1]] < p - capacity:
            queue.popleft()
        v, back[j] = queue[0]
        value[j] = v - p + capacity + cost[j - 1]
        g = value[j] + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    if more:
        back[-1] = min((i for i in range(bisect_left(place, place[-1] - capacity), len(place) - 1)), key=value.__getitem__)
    out, j = [], len(place) - 1
    while j > 0:
        out.append(place[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs a stream of (key, ids) in order; rows are pieces."""

    def __init__(self, first_sequence: int, capacity: int, ends: np.ndarray):
        self.sequence, self.capacity, self.ends = first_sequence, capacity, ends
        self.open: list[list] = []  # [key, ids, tokens already placed]
        self.tokens = 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        self.open.append([key, ids, 0])
        self.tokens += len(ids)
        return self.plan(False) if self.tokens >= PLAN else []

    def plan(self, final: bool) -> list[tuple]:
        at, cost, base = [], [], 0
        for _, ids, done in self.open:
            a, c = places(ids[done:], self.ends)
            at += [base + x for x in a]
            cost += c
            base += len(ids) - done
        if not at:
            return []
        chosen = cuts(at, cost, self.capacity, not final)
        if not final:
            chosen.pop()  # the last window may still grow
        rows: list[tuple] = []
        k, inside = 0, 0
        for a, b in pairwise([0, *chosen]):
            offset, left = 0, b - a
            while left:
                key, ids, done = self.open[k]
                n = min(left, len(ids) - done)
                rows.append((key, done, n, zlib.crc32(ids[done:done + n].astype("<u4").tobytes()), len(ids), self.sequence, offset))
                self.open[k][2] = done + n
                offset, left = offset + n, left - n
                if done + n == len(ids):
                    k += 1
            self.sequence += 1
            inside = b
        self.open = self.open[k:]
        self.tokens -= inside
        return rows


def parts(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts of runs of rows with about STEP bytes; a null text is empty."""
    keys, texts, size = [], [], 0
    for key, text in zip(b.column(0), b.column(1).cast(pa.binary())):
        keys.append(key.as_py())
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= STEP:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of documents in sequences: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Order-preserving: every partition of ``docs`` is packed as one stream in the
    order of its rows, in one narrow stage without a shuffle; only a partition's
    last sequence is short for want of documents. sequence_id is the partition's
    number times 2**32 plus a running number. A null or empty text is its end token alone;
    null and repeated keys are packed like others; other columns are not carried.
    A text of any length is cut over as many sequences as it takes.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, e.ends)
        out = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], out), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        try:
            for b in batches:
                out = b.column(0).type
                rows: list[tuple] = []
                for keys, texts in parts(b):
                    for key, ids in zip(keys, e.ids(texts), strict=True):
                        rows += packer.add(key, np.append(ids, np.array([end_id], "<u4")))
                    if len(rows) > 20_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)
            if out is not None and (rows := packer.plan(True)):
                yield batch(rows)
        finally:
            e.forget()  # workers are used again, by other stages too

    return docs.select(key, text).mapInArrow(run, schema)
