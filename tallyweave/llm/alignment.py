"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte, and how often corpus-wide.

A postings cogroup in three shuffles, none of which carries a text:

1. Documents are encoded once, in blocks. Of a block, each id of side B gets one
   posting list: its pairs' A ids, and for each the documents and multiplicities.
2. Pair counts are summed (first in the block, then in the map task), and an id's
   counts meet its posting lists in streams sorted by B id. Lists of a frequent id
   are dealt over slices, each of which gets the id's counts: at most one for each
   A id, however large the corpus is. A stream emits what each document gets.
3. These contributions, summed where they arise, meet the block's documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import Tables

#: Characters after which a text is cut at the next safe space, and bytes that are encoded in one call.
CHUNK, CALL = 1 << 16, 1 << 20
#: Units that are encoded in one call, joined by spaces.
JOINED = 4096
#: Bytes of units, and what is known of them, that a task remembers.
REMEMBERED = 96 << 20
#: A block ends with so many documents, pairs or bytes of group texts.
DOCS, PAIRS, SAID = 32_767, 1 << 21, 32 << 20
#: Pairs in one slice of a frequent id's lists, at least; more where the id has very many partners. Sums held before they go out.
SLICE, HELD = 1 << 20, 1 << 20

LONG, INT = T.LongType(), T.IntegerType()
LISTS = {"block": LONG, "b": INT, "a_ids": T.ArrayType(INT), "a_docs": T.ArrayType(INT), "a_counts": T.ArrayType(LONG), "rows": T.ArrayType(T.ShortType()), "times": T.ArrayType(INT)}
DOCUMENT = {"doc": LONG, "n_a": LONG, "n_b": LONG, "n_groups": LONG, "sha": T.StringType(), "groups": T.StringType()}


def schema(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields.items()])


ENCODED = schema({**LISTS, **{n: T.ArrayType(t) for n, t in DOCUMENT.items()}})
SUMS = schema({"block": LONG, "rows": T.ArrayType(T.ShortType()), "best": T.ArrayType(LONG), "sums": T.ArrayType(LONG)})


def listed(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def batch(kind: T.StructType, n: int, **columns: pa.Array) -> pa.RecordBatch:
    at = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in at], schema=at)


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: ``encode`` gives ids of texts, ``said`` the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: sp.encode(texts, num_threads=1)
            pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            self.said = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
            code, vocabulary = byte_level(), t.get_vocab(with_added_tokens=False)
            self.said = [b""] * (1 + max(vocabulary.values()))
            for entry, i in vocabulary.items():
                self.said[i] = bytes(code[c] for c in entry) if all(c in code for c in entry) else entry.encode()
        if not all(self.said):
            raise ValueError(f"{path} has ids without bytes")
        self.lengths = np.array([len(x) for x in self.said], np.int64)


_loaded: dict[str, Side] = {}


def side(path: str) -> Side:
    if path not in _loaded:
        _loaded[path] = Side(path)
    return _loaded[path]


#: A space between characters that are none: both tokenizers start a token with it, whatever stands around.
SAFE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


def pieces(text: str) -> list[str]:
    """Parts of a text; the space between two of them is the one that either side puts before each."""
    out, start = [], 0
    while len(text) - start > CHUNK and (m := SAFE.search(text, start + CHUNK)):
        out.append(text[start:m.start()])
        start = m.end()
    return [*out, text[start:]]


class Document:
    """What is known of one text while its pieces come."""

    def __init__(self, key: int | None, keep: bool):
        self.key, self.whole, self.n_a, self.n_b, self.n_groups = key, True, 0, 0, 0
        self.sha, self.pairs, self.groups = hashlib.sha256(), [], [] if keep else None

    def add(self, n_a: int, n_b: int, n_groups: int, groups: bytes) -> None:
        if self.n_a:
            self.sha.update(b";")
        self.sha.update(groups)
        if self.groups is not None:
            self.groups.append(groups.decode())
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups

    def row(self) -> tuple:
        if not self.whole or not self.n_a:
            return self.key, 0, 0, 0, "", None if self.groups is None else ""
        return self.key, self.n_a, self.n_b, self.n_groups, self.sha.hexdigest(), None if self.groups is None else ";".join(self.groups)


class Aligner:
    """Encodes units, the parts of a text between safe spaces, and cuts both sides into groups at the bytes where tokens of both end.

    What a unit gives does not depend on what stands around it, so it is remembered for the next text, up to REMEMBERED bytes.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.width = a, b, len(b.said)
        text = lambda n, end: np.array([f"{i}{end}".encode() for i in range(n)], object)
        self.inner, self.last_a, self.last_b = text(max(len(a.said), len(b.said)), ","), text(len(a.said), "|"), text(len(b.said), ";")
        self.forget()

    def forget(self) -> None:
        self.plain: dict[str, int] = {}  # of texts split at every space; -1: not a unit, as its ends are not safe
        self.odd: dict[str, int] = {}
        self.sizes = np.zeros((0, 3), np.int64)  # tokens of A and B, groups; of a unit that either side does not give back, no groups
        self.groups: list[bytes] = []
        self.pairs, self.first, self.held = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def call(self, parts: list[tuple[Document, str]]) -> None:
        split = [(p.split(" "), self.plain) for _, p in parts]
        self.learn(dict.fromkeys(u for units, _ in split for u in units if u not in self.plain), self.plain)
        for i, (units, known) in enumerate(split):
            if -1 in map(known.__getitem__, units):
                split[i] = SAFE.split(parts[i][1]), self.odd
        self.learn(dict.fromkeys(u for units, known in split if known is self.odd for u in units if u not in known), self.odd)
        for (doc, _), (units, known) in zip(parts, split, strict=True):
            at = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            sizes = self.sizes[at]
            if not sizes[:, 2].all():
                doc.whole = False
                continue
            doc.add(*map(int, sizes.sum(0)), b";".join([self.groups[i] for i in at.tolist()]))
            unit, times = np.unique(at, return_counts=True)
            n = self.first[unit + 1] - self.first[unit]
            pairs = self.pairs[np.repeat(self.first[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            doc.pairs.append(summed([(pairs, np.repeat(times, n))]))
            if len(doc.pairs) > 8:
                doc.pairs = [summed(doc.pairs)]
        if self.held > REMEMBERED:
            self.forget()

    def encode(self, units: list[str], said: list[bytes], ids: list[list], counts: list[list]) -> None:
        """Adds the ids of both sides and how many each unit has. Units are joined for one call, as long as it gives their bytes back."""
        whole, ends = b"".join(said), np.cumsum([len(x) for x in said])
        found = []
        for s in (self.a, self.b):
            own = s.encode([" ".join(units)])[0]
            if b"".join([s.said[k] for k in own]) != whole:
                if len(units) == 1:
                    found = [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2
                    break
                for u, x in zip(units, said, strict=True):
                    self.encode([u], [x], ids, counts)
                return
            own = np.array(own, np.int64)
            found.append((own, np.diff(np.searchsorted(np.cumsum(s.lengths[own]), ends) + 1, prepend=0)))
        for k, (own, n) in enumerate(found):
            ids[k].append(own)
            counts[k].append(n)

    def learn(self, units: dict[str, None], known: dict[str, int]) -> None:
        if known is self.plain:
            for u in units:
                if not u or u[0].isspace() or u[-1].isspace() or u[0] == "▁" or u[-1] == "▁":
                    known[u] = -1
            units = [u for u in units if u not in known]
        if not units:
            return
        units = list(units)
        known.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        said = [b" " + u.encode() for u in units]
        ids, counts = [[], []], [[], []]
        step = JOINED if known is self.plain else 1
        for i in range(0, len(units), step):
            self.encode(units[i:i + step], said[i:i + step], ids, counts)
        ids, counts = [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts]
        (a, b), (end_a, end_b) = ids, (np.cumsum(s.lengths[i]) for s, i in zip((self.a, self.b), ids, strict=True))
        at = np.searchsorted(end_b, end_a)  # both end with the last byte
        shared_a = end_b[at] == end_a
        shared_b = np.zeros(len(b), bool)
        shared_b[at[shared_a]] = True
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        text = np.empty(len(a) + len(b), object)  # a group's A ids, then its B ids
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(shared_a, self.last_a[a], self.inner[a])
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(shared_b, self.last_b[b], self.inner[b])
        text = text.tolist()
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in counts)
        links = np.concatenate([[0], np.cumsum(shared_a)])[first_a]
        ends = (first_a + first_b).tolist()
        groups = [b"".join(text[i:j])[:-1] for i, j in pairwise(ends)]
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, np.stack([*counts, np.diff(links)], 1)])
        self.pairs = np.concatenate([self.pairs, b[at[shared_a]] + self.width * a[shared_a]])
        self.first = np.concatenate([self.first, self.first[-1] + links[1:]])
        self.held += sum(map(len, said)) + sum(map(len, groups)) + 300 * len(units)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, np.concatenate([n for _, n in parts]))
    return keys, out


class Block:
    """Consecutive documents of one task, and their pairs."""

    def __init__(self, width: int):
        self.width, self.number = width, TaskContext.get().partitionId() << 20
        self.clear()

    def clear(self) -> None:
        self.docs, self.keys, self.times, self.rows, self.n, self.size = [], [], [], [], 0, 0

    def add(self, doc: Document) -> None:
        row = doc.row()
        self.docs.append(row)
        self.size += len(row[5] or "")
        if row[1]:
            keys, times = summed(doc.pairs)
            self.keys.append(keys)
            self.times.append(times)
            self.rows.append(np.full(len(keys), len(self.docs) - 1, np.int16))
            self.n += len(keys)

    def full(self) -> bool:
        return len(self.docs) >= DOCS or self.n >= PAIRS or self.size >= SAID

    def batches(self) -> Iterator[pa.RecordBatch]:
        one = {n: pa.array([[d[i] for d in self.docs]], pa.list_(to_arrow_schema(schema(DOCUMENT)).field(n).type)) for i, n in enumerate(DOCUMENT)}
        yield batch(ENCODED, 1, block=pa.array([self.number]), **one)
        if self.n:
            keys, rows, times = np.concatenate(self.keys), np.concatenate(self.rows), np.concatenate(self.times)
            keys = keys % self.width * (1 << 32) + keys // self.width  # by B id, then A id, then document
            order = np.argsort(keys, kind="stable")
            keys, rows, times = keys[order], rows[order], times[order]
            pair = np.flatnonzero(np.diff(keys, prepend=-1))
            docs, counts = np.diff(np.append(pair, len(keys))), np.add.reduceat(times, pair)
            a, b = keys[pair] & (1 << 32) - 1, keys[pair] >> 32
            own = np.flatnonzero(np.diff(b, prepend=-1))
            yield batch(ENCODED, len(own), block=pa.array(np.full(len(own), self.number)), b=pa.array(b[own]), a_ids=listed(a, own),
                        a_docs=listed(docs, own), a_counts=listed(counts, own), rows=listed(rows, pair[own]), times=listed(times, pair[own]))
        self.number += 1
        self.clear()


def encoder(a_path: str, b_path: str, keep: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(side(a_path), side(b_path))
        block, parts, held, waiting = Block(aligner.width), [], 0, []

        def call() -> None:
            nonlocal parts, held
            if parts:
                aligner.call(parts)
            parts, held = [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            call()
            for doc in waiting:
                block.add(doc)
                if block.full():
                    yield from block.batches()
            waiting = []

        for rows in batches:
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                doc, text = Document(key, keep), text.as_py()
                for p in pieces(text) if text else ():
                    if not doc.whole:  # nothing more is looked at
                        break
                    parts.append((doc, p))
                    held += len(p)
                    if held >= CALL:
                        call()
                waiting.append(doc)
                if not parts:  # all that wait are done
                    yield from settle()
            yield from settle()
        if block.docs:
            yield from block.batches()

    return encode


def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams by B id and slice, counts before posting lists: what each document gets, summed by block as far as it is held."""
    keys, counts, tops = (np.zeros(0, np.int64) for _ in range(3))
    held: list[np.ndarray] = []
    n = 0

    def combined() -> np.ndarray:
        docs, best, sums = (np.concatenate(x) for x in zip(*held, strict=True))
        at, back = np.unique(docs, return_inverse=True)
        out = np.zeros((3, len(at)), np.int64)
        out[0] = at
        np.add.at(out[1], back, best)
        np.add.at(out[2], back, sums)
        return out

    def emit(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = x[0] >> 15
        first = np.flatnonzero(np.diff(block, prepend=-1))
        if len(first):
            yield batch(SUMS, len(first), block=pa.array(block[first]), rows=listed(x[0] & 32767, first), best=listed(x[1], first), sums=listed(x[2], first))

    for rows in batches:
        kind = rows.column("kind").to_numpy()
        flat = lambda name: rows.column(name).flatten().to_numpy().astype(np.int64)
        size = lambda name: np.diff(rows.column(name).offsets.to_numpy())
        pairs, b = size("a_ids"), rows.column("b").to_numpy().astype(np.int64)
        key, value = np.repeat(b, pairs) << 32 | flat("a_ids"), flat("a_counts")  # posting lists have no counts
        told = np.repeat(kind == 0, pairs)
        top = np.repeat(np.where(kind == 0, rows.column("top").to_numpy(), 0), pairs)[told]
        # of earlier batches only the last B id can still be asked for
        last = slice(np.searchsorted(keys, keys[-1] >> 32 << 32), None) if len(keys) else slice(0)
        keys, counts, tops = (np.concatenate([x[last], y]) for x, y in ((keys, key[told]), (counts, value), (tops, top)))
        docs = flat("a_docs")
        if not len(docs):
            continue
        order = np.argsort(keys, kind="stable")
        keys, counts, tops = keys[order], counts[order], tops[order]
        at = np.searchsorted(keys, key[~told])
        count, best = (np.repeat(x, docs) for x in (counts[at], counts[at] == tops[at]))
        times = flat("times")
        place = np.repeat(rows.column("block").to_numpy(zero_copy_only=False).astype(np.int64), size("rows")) << 15 | flat("rows")
        held.append((place, times * best, times * count))
        n += len(place)
        if n >= HELD:
            x = combined()
            held, n = [x], x.shape[1]
            if n >= HELD // 2:
                yield from emit(x)
                held, n = [], 0
    if held:
        yield from emit(combined())


def finisher(out: T.StructType):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams by block, documents before sums."""
        known = best = sums = None

        def end() -> Iterator[pa.RecordBatch]:
            if known is not None:
                n, links = len(known["doc"]), known["n_groups"]
                columns = [known["doc"], known["n_a"], known["n_b"], links, links, best, sums, known["sha"], known["groups"]][:len(out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(out), strict=True)], schema=to_arrow_schema(out)) if n else batch(out, 0)

        for rows in batches:
            kind = rows.column("kind").to_numpy()
            for i in range(rows.num_rows):
                if kind[i] == 0:
                    yield from end()
                    known = {n: rows.column(n)[i].as_py() for n in DOCUMENT}
                    best, sums = (np.zeros(len(known["doc"]), np.int64) for _ in range(2))
                else:
                    at = rows.column("rows")[i].values.to_numpy()
                    np.add.at(best, at, rows.column("best")[i].values.to_numpy())
                    np.add.at(sums, at, rows.column("sums")[i].values.to_numpy())
        yield from end()

    return finish


def encoded(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, groups: bool) -> DataFrame:
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(encoder(a_path, b_path, groups), ENCODED)


def counted(lists: DataFrame) -> DataFrame:
    """(b, a, n): how often a pair of ids ends together in all documents. Added up in map tasks before the shuffle."""
    pair = lists.where("b is not null").select("b", F.explode(F.arrays_zip("a_ids", "a_counts")).alias("x"))
    return pair.groupBy("b", F.col("x.a_ids").alias("a")).agg(F.sum("x.a_counts").alias("n"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n, best): the pairs of ids of all documents, how often each is linked, and whether its B id has no pair with more."""
    with Tables() as t:
        found = t.result(counted(encoded(docs, a_path, b_path, key, text, False)), "pairs")
    best = found.groupBy("b").agg(F.max("n").alias("top"))
    return found.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    Side A encodes a space and the text, side B the text, to which it adds the space
    itself; each side may be a ``.json`` of tokenizers or a ``.model`` of sentencepiece.
    Special tokens' strings are plain text. Null and empty texts, and those whose
    bytes either side does not give back, have no tokens: zeros and empty texts.
    Keys are longs and may be null or repeat; every row counts. Texts of any length
    are encoded whole, in parts between which no token can lie. Other columns,
    whatever their names, are not looked at; a table without rows gives none.
    """
    fields = {key: LONG, **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), LONG), "groups_sha256": T.StringType()}
    out = schema({**fields, "groups": T.StringType()} if groups else fields)
    with Tables() as t:
        blocks = t.written(encoded(docs, a_path, b_path, key, text, groups), "encoded")
        lists = blocks.where("b is not null").select(*LISTS)
        pairs = t.written(counted(lists), "pairs")
        size = lists.groupBy("b").agg(F.sum(F.size("rows")).alias("n_rows"))
        # at most one count for each id of A, and one row for each id of B
        totals = pairs.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("x"), F.max("n").alias("top"))
        slices = F.ceil(F.col("n_rows") / F.greatest(F.lit(SLICE), 16 * F.size("x"))).cast("int")
        totals = t.written(totals.join(size, "b").select("b", "x", "top", slices.alias("slices")), "totals")
        told = totals.select("b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"),
                             F.col("x.a").alias("a_ids"), F.col("x.n").alias("a_counts"), "top", F.array().cast("array<int>").alias("a_docs"),
                             F.array().cast("array<smallint>").alias("rows"), F.array().cast("array<int>").alias("times"))
        dealt = lists.join(F.broadcast(totals.where("slices > 1").select("b", "slices")), "b", "left")
        dealt = dealt.select("b", F.coalesce(F.pmod(F.hash("block"), "slices"), F.lit(0)).alias("slice"), F.lit(1).alias("kind"), "block", "a_ids",
                             F.array().cast("array<bigint>").alias("a_counts"), F.lit(0).cast("long").alias("top"), "a_docs", "rows", "times")
        streams = told.unionByName(dealt).repartition("b", "slice").sortWithinPartitions("b", "slice", "kind")
        sums = streams.mapInArrow(contributions, SUMS).select("block", F.lit(1).alias("kind"), "rows", "best", "sums")
        heads = blocks.where("b is null").select("block", F.lit(0).alias("kind"), *DOCUMENT)
        both = heads.unionByName(sums, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
        return t.result(both.mapInArrow(finisher(out), out), "aligned")


def op11(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return align(docs, a_path, b_path)
