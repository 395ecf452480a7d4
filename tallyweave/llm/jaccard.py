"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A document is the set of its hashed 5-word shingles (tokens). Two that link share
at least 80 % of the larger one, so:

1. In any global order of tokens, a document shares many of its first tokens (a
   prefix extended by a tenth of the set) with every partner. Tokens are counted
   over all documents' extended prefixes; a document with too few that occur
   twice has no partner and is done.
2. Among the rest tokens are counted in full and ordered rare first. Rare tokens
   of the prefix are indexed singly. Frequent ones are indexed by combinations:
   the prefix is extended by g tokens, tokens fall into g classes, so partners
   without a common rare token share two of one class.
3. Few documents share a rare token: their pairs are verified.
4. Partners that share combinations alone have no rare token in common, so their
   intersection is that of their frequent tokens. Documents with the same
   frequent tokens and size are one kind, and kinds are verified: within a
   combination that few have all pairs, within a common one each with the
   smallest. Links found make components; only combinations that still hold
   several components are left, and of those, blocks of kinds that share one are
   verified, except blocks of one and the same component. A block gives a
   spanning forest of its links.

Everything counts and verifies exactly; no partner or candidate is capped. Tokens
have 64 bits, from 128-bit word hashes: that one of n tokens of a text equals one
of another text by chance has a probability of about n * n / 2**64.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import connected_components, discard, written
from tallyweave.llm.embeddings import forest
from tallyweave.llm.windows import ASKED, REPLIES, TIMES, Batched, answer, ask, longer, mixed, parts, texts_of, told, totals_of

SHINGLE = 5
#: A token in more documents is frequent; rare ones have at most RARE * (RARE - 1) / 2 pairs, a fixed number.
RARE = 16
#: Kinds, and tokens, that a block of the verification has about at most.
BLOCK, TOKENS = 256, 500_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def token_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than ``n`` make one, none make none."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    short: dict[int, np.ndarray] = {}
    for words, pieces in parts([t.translate(LOWER) for t in texts], n - 1):
        x = mixed(words[0] ^ (words[1] * TIMES))
        windows, a = longer(x, 1, n), 0
        for i, first, m in pieces:
            if m >= n:
                found[i].append(windows[a:a + m - n + 1])
            elif m and not first:  # all words of the text so far
                short[i] = mixed(longer(x[a:a + m], 1, m), salt=m)
            a += m
    return [np.unique(np.concatenate(x)) if x else short.get(i, np.zeros(0, np.uint64)) for i, x in enumerate(found)]


def shared_least(n: int) -> int:
    """Tokens that a set of ``n`` shares at least with a partner: 80 % of it, rounded up."""
    return -(-4 * n // 5)


def extended(x: np.ndarray) -> np.ndarray:
    """The smallest tokens of a set: its prefix, extended so that each partner shares many of them."""
    n = len(x)
    return x[:n - shared_least(n) + max(1, n // 10)] if n else x


def enough(n: int) -> int:
    """How many tokens of its extended prefix a set of ``n`` shares at least: a partner has 0.8 n tokens or more, and extends by a tenth of its own."""
    return max(1, shared_least(n) // 10)


def index_keys(tokens: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(single, combined) index keys of a set, given in how many sets each token is.

    Sets whose sizes may link fall into the same or neighbouring size classes
    (powers of 5/4), so each set is indexed for its own class and the next.
    """
    n = len(tokens)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    prefix = n - shared_least(n) + 1
    size, bound = 0, 1.25
    while n >= bound:
        size, bound = size + 1, bound * 1.25
    combined, widest = [], prefix
    for c in (size, size + 1):
        g = max(1, int(0.2 * 1.25**c / 8))
        end = min(n, prefix + g)
        widest = max(widest, end)
        often = tokens[:end][df[:end] > RARE]
        part = (often >> np.uint64(17)) % np.uint64(g)
        for k in np.unique(part).tolist():
            own = np.sort(often[part == k])
            if len(own) > 1:
                i, j = np.array(list(combinations(range(len(own)), 2))).T
                combined.append(mixed(own[i] + mixed(own[j]), salt=c + 1))
    single = tokens[:widest][(df[:widest] > 1) & (df[:widest] <= RARE)]
    return single, np.concatenate(combined) if combined else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, digest, tokens): tokens only where a partner is possible."""
    spark = docs.sparkSession
    held = Batched(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    rows, buckets = held.rows, held.buckets

    def prefixes(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(t):
            return ask(0, 0, np.zeros(0, np.uint64), buckets)
        return ask(t["batch"][0].as_py(), 0, np.concatenate([extended(x) for x in token_sets(texts_of(t))]), buckets)

    def possible(t: pa.Table, replies: pa.Table) -> pa.Table:
        sets = token_sets(texts_of(t))
        heads = [extended(x) for x in sets]
        keys = np.unique(np.concatenate([*heads, np.zeros(0, np.uint64)]))
        twice = totals_of(told(replies), 0, 0, keys) > 1
        tokens = [x if len(x) and np.count_nonzero(twice[np.searchsorted(keys, h)]) >= enough(len(x)) else None for x, h in zip(sets, heads)]
        digest = [None if x is None else hashlib.md5(x.tobytes()).digest() for x in tokens]
        return pa.table({"key": t["key"].combine_chunks(), "n": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array(digest, pa.binary()), "tokens": lists(tokens)})

    none = spark.createDataFrame([], REPLIES)
    replies = answer(rows.groupBy("batch").cogroup(none.groupBy("batch")).applyInArrow(prefixes, ASKED), 0)
    found = rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(possible, "key long, n long, digest binary, tokens array<long>")
    sets = written(found, "sets")
    held.discard()
    discard(replies)
    return sets


def lists(tokens: list[np.ndarray | None]) -> pa.ListArray:
    """Token sets as lists of long; None as null."""
    size = np.array([0 if x is None else len(x) for x in tokens], np.int64)
    values = np.concatenate([np.zeros(0, np.uint64), *(x for x in tokens if x is not None)]).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in tokens], pa.bool_()))


def tokens_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Token sets from lists of long, none of them null."""
    out = []
    for c in column.chunks:
        at, values = c.offsets.to_numpy().tolist(), c.values.to_numpy().view(np.uint64)
        out += [values[a:z] for a, z in zip(at, at[1:])]
    return out


def _index(solo: DataFrame) -> DataFrame:
    """(rep, n, single, combined, kind, often) of the distinct sets: index keys, and the frequent tokens of sets with combinations, with their digest."""
    held = Batched(solo.select("rep", "tokens"), "tokens")
    rows, buckets = held.rows, held.buckets

    def questions(t: pa.Table) -> pa.Table:
        return ask(t["batch"][0].as_py(), 0, np.concatenate(tokens_of(t["tokens"])), buckets)

    def keys(t: pa.Table, replies: pa.Table) -> pa.Table:
        sets = tokens_of(t["tokens"])
        known = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        totals = totals_of(told(replies), 0, 0, known).astype(np.int64)
        single, combined, often = [], [], []
        for x in sets:
            df = totals[np.searchsorted(known, x)]
            one, two = index_keys(x, df)
            single.append(one)
            combined.append(two)
            often.append(x[df > RARE] if len(two) else None)
        kind = [None if x is None else hashlib.md5(x.tobytes()).digest() for x in often]
        return pa.table({"rep": t["rep"].combine_chunks(), "n": pa.array([len(x) for x in sets], pa.int64()), "single": lists(single), "combined": lists(combined), "kind": pa.array(kind, pa.binary()), "often": lists(often)})

    replies = answer(rows.groupBy("batch").applyInArrow(questions, ASKED), 0)
    found = rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(keys, "rep long, n long, single array<long>, combined array<long>, kind binary, often array<long>")
    index = written(found, "index")
    held.discard()
    discard(replies)
    return index


def _pairs(keys: DataFrame) -> DataFrame:
    """Distinct pairs (u, v), u < v, that share a key and whose sizes may link; ``keys`` (k, u, n) has RARE rows a key at most."""
    other = keys.select("k", F.col("u").alias("v"), F.col("n").alias("nv"))
    return keys.join(other, "k").where("u < v and 5 * least(n, nv) >= 4 * greatest(n, nv)").select("u", "v").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose ``sets`` (u, n, tokens) link. Row by row in the JVM, so a set that many pairs have costs no memory."""
    left = pairs.join(sets.select("u", F.col("n").alias("nu"), F.col("tokens").alias("tu")), "u")
    full = left.join(sets.select(F.col("u").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv")), "v")
    both = F.size(F.array_intersect("tu", "tv"))
    return full.where(100 * both >= 80 * (F.col("nu") + F.col("nv") - both)).select("u", "v")


def linked(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Does an intersection of ``both`` make sets of ``n`` and ``m`` tokens link?"""
    return 100 * both >= 80 * (n + m - both)


def block_edges(t: pa.Table) -> pa.Table:
    """Spanning links between the kinds of two blocks (or within one), from a product of their token matrices."""
    side, u, n = (t[c].to_numpy() for c in ("side", "u", "n"))
    sets = tokens_of(t["tokens"])
    # only tokens of two kinds count; columns are taken in parts, so memory stays bounded
    _, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kind = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    use = often[inverse] > 1
    number = np.cumsum(often > 1) - 1
    column, kind = number[inverse[use]], kind[use]
    order = np.argsort(column, kind="stable")
    column, kind = column[order], kind[order]
    rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    both = np.zeros((len(rows), len(columns)), np.float32)
    width = 8192
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[kind[a:b], column[a:b] - at] = 1
        both += m[rows] @ m[columns].T
    link = linked(np.rint(both).astype(np.int64), n[rows][:, None], n[columns]) & (u[rows][:, None] != u[columns])
    found = [(int(u[rows[i]]), int(u[columns[j]])) for i, j in forest(link)]
    return pa.table([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _block_links(open_keys: DataFrame, kinds: DataFrame) -> DataFrame:
    """Links between different components of kinds that share one of ``open_keys`` (k, u, n, component).

    A kind's place is its smallest open key, so neighbours meet in few blocks. There
    a large component has blocks of its own, small ones share blocks.
    """
    member = open_keys.groupBy("u", "n", "component").agg(F.min("k").alias("home"))
    size = member.groupBy("home", "component").agg(F.count("*").alias("kinds"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.sum("kinds") / BLOCK), F.ceil(F.sum("tokens") / TOKENS)).cast("int")
    whose = F.when(F.col("kinds") >= BLOCK // 2, F.col("component")).alias("own")
    sized = size.select("home", "component", "kinds", "tokens", whose)
    shares = sized.groupBy("home", "own").agg(blocks.alias("blocks"))
    dealt = sized.select("home", "component", "own").join(shares.select("home", F.col("own").alias("o"), "blocks"), ["home"]).where("own <=> o").drop("o")
    named = (member.join(dealt, ["home", "component"])
             .withColumn("b", F.concat_ws(":", "home", F.coalesce(F.col("own").cast("string"), F.lit("*")), F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("component")).otherwise(F.col("u"))), F.col("blocks")).cast("string")))
             .select("u", "b", "own"))
    named = written(named, "blocks")
    at = open_keys.select("k", "u").join(named, "u").select("k", "b", "own").distinct()
    other = at.select("k", F.col("b").alias("b2"), F.col("own").alias("own2"))
    meets = at.join(other, "k").where("b <= b2 and not coalesce(own = own2, false)").select("b", "b2").distinct()
    sides = meets.select("b", "b2", F.explode(F.expr("case when b = b2 then array(named_struct('block', b, 'side', 2)) else array(named_struct('block', b, 'side', 0), named_struct('block', b2, 'side', 1)) end")).alias("x")).select("b", "b2", "x.*")
    full = sides.join(named.select("u", F.col("b").alias("block")), "block").join(kinds.select("u", "n", "tokens"), "u").select("b", "b2", "side", "u", "n", "tokens")
    return full.groupBy("b", "b2").applyInArrow(block_edges, "u long, v long")


def _kind_edges(index: DataFrame) -> DataFrame:
    """Links among documents that share combinations of frequent tokens, as edges between their reps."""
    held = index.where("often is not null")
    kinds = written(held.groupBy("kind", "n").agg(F.min("rep").alias("u"), F.count("*").alias("members"), F.first("often").alias("tokens"), F.first("combined").alias("combined")), "kinds")
    keys = kinds.select("u", "n", F.explode("combined").alias("k"))
    many = keys.groupBy("k").agg(F.count("*").alias("kinds"), F.min("u").alias("v")).where("kinds > 1")
    shared = written(keys.join(many, "k"), "shared")
    star = shared.where(f"kinds > {RARE} and u <> v").select("u", "v").distinct()
    found = written(_verified(_pairs(shared.where(f"kinds <= {RARE}").select("k", "u", "n")).union(star).distinct(), kinds), "found")
    # combinations that many have and that still hold several components
    components = written(connected_components(found), "components")
    large = shared.where(f"kinds > {RARE}").select("k", "u", "n").join(components.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    several = large.groupBy("k").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("k")
    left = written(large.join(several, "k", "left_semi"), "open")
    edges = found
    if not left.isEmpty():
        edges = found.union(_block_links(left, kinds))
    own = kinds.where("members > 1 and 100 * size(tokens) >= 80 * (2 * n - size(tokens))").select("u")
    edges = written(edges, "edges")
    # all documents of a kind that links, with others or itself, are one component
    hit = edges.select("u").union(edges.select("v")).union(own).distinct()
    members = held.select("rep", "kind", "n").join(kinds.where("members > 1").join(hit, "u", "left_semi").select("kind", "n", "u"), ["kind", "n"])
    return edges.union(members.where("rep <> u").select(F.col("rep"), "u"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased. Rows link when
    100 * intersection >= 80 * union of their shingle sets; component_id is the
    smallest key reachable. Null, empty and blank texts have 0 shingles and link
    with nothing; a row with a null key links with nothing and has a null
    component; rows that share a key are one node. Equal sets are verified once.
    Keys are whole numbers, others an error. Other columns are not carried; a
    table without rows gives none.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is {docs.schema[key].dataType.simpleString()}, not a whole number")
    sets = _sets(docs, key, text)
    same = sets.where("digest is not null and key is not null")
    # a number for each distinct set, fixed by writing it
    distinct = same.groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    solo = written(distinct.select(F.monotonically_increasing_id().alias("rep"), "digest", "n", "tokens"), "distinct")
    index = _index(solo)
    one = index.select("rep", "n", F.explode("single").alias("k")).select("k", F.col("rep").alias("u"), "n")
    edges = _verified(_pairs(one), solo.select(F.col("rep").alias("u"), "n", "tokens")).union(_kind_edges(index))
    # copies stay out of the graph: only a key that has several sets links them
    held = written(same.select("key", "digest").join(solo.select("digest", "rep"), "digest").select("key", "rep"), "held")
    several = held.distinct().groupBy("key").agg(F.count("*").alias("sets"), F.min("rep").alias("v")).where("sets > 1")
    own = held.join(several, "key").select(F.col("rep").alias("u"), "v")
    components = written(connected_components(written(edges.union(own), "links")), "components")
    # the smallest key of a component is its name
    member = held.join(components, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"))
    named = written(member.groupBy("component").agg(F.min("key").alias("name"), F.count("*").alias("rows")).where("rows > 1").select("component", "name"), "names")
    final = member.join(named, "component").select(F.col("key").alias("node"), "name").distinct()
    return (sets.select("key", "n").join(final, F.col("key") == F.col("node"), "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("name", "key").alias("component_id")))
