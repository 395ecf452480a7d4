"""Secret scans with a trigram inverted index, on DataFrame functions alone.

From each rule's regex a Boolean query over trigrams is derived: alternatives, each
a set of trigrams that any match must hold. For the trigrams that queries name the
index has posting lists, sorted ids of texts, cut into slices of the id range. The
lists of an alternative are intersected slice by slice; what any alternative of any
rule leaves are the candidates, and those are verified with the regexes. A rule with
an alternative that forces no trigram scans every text.

Only ids are shuffled, never texts: the candidates' ids become a bitmap of bounded
size, which is broadcast, so verification is one narrow pass.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import discard, written


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of the match, or of ``group`` if it is not 0.

    ``pattern`` must mean the same in Java's and RE2's syntax; letters of any
    case are written as classes, so that case rules of Unicode play no part.
    ``quick``: a cheaper regex that every text with a long enough match has.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str = ""


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key") + ")"
BASE_RULES = (
    Rule("assign", ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", "AKIA[A-Z0-9]+", least=16, quick="AKIA[A-Z0-9]{12}"),
    Rule("hex", "[0-9a-f]+", least=32, quick="[0-9a-f]{32}"),
)
#: Kinds beyond the base, by well-known public formats.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("gkey", "AIza[A-Za-z0-9_-]+", least=39),
)
RULES = BASE_RULES + MORE_RULES

MOST_STRINGS = 256
GAP = None  # stands for text that is not fixed


class FixedRuns:
    """Alternatives for a rule's pattern, each a sequence of fixed letters and gaps; too many make a single gap.

    Reads what rules are written in: letters, escapes, classes, groups,
    alternatives and the quantifiers ? * + {n,m}.
    """

    def __init__(self, pattern: str):
        self.rest = pattern

    def take(self, n: int = 1) -> str:
        got, self.rest = self.rest[:n], self.rest[n:]
        return got

    def until(self, end: str) -> str:
        got = self.take(self.rest.index(end))
        self.take()
        return got

    def branches(self) -> list[tuple]:
        found = self.sequence()
        while self.rest.startswith("|"):
            self.take()
            found = found + self.sequence()
        return list(dict.fromkeys(found))

    def sequence(self) -> list[tuple]:
        found: list[tuple] = [()]
        while self.rest and self.rest[0] not in "|)":
            found = [a + b for a, b in itertools.product(found, self.times(self.one()))]
            if len(found) > MOST_STRINGS:
                found = [(GAP,)]
        return found

    def one(self) -> list[tuple]:
        c = self.take()
        if c == "(":
            self.rest = self.rest.removeprefix("?:")
            if self.rest.startswith("?"):
                raise ValueError(f"a rule's group may not begin with {self.rest[:3]}")
            found = self.branches()
            self.take()
            return found
        if c == "[":
            letters = self.until("]")
            if len(letters) > 8 or any(x in letters for x in "\\^-"):
                return [(GAP,)]
            return [(x,) for x in sorted({*letters.lower()})]
        if c == "\\":
            c = self.take()
            if c == "x":
                return [(chr(int(self.take(2), 16)),)]
            return [(GAP,)] if c.isalnum() else [(c,)]
        return [(GAP,)] if c in ".^$" else [(c.lower(),)]

    def times(self, what: list[tuple]) -> list[tuple]:
        c = self.rest[:1]
        if c == "?":
            self.take()
            return [(), *what]
        if c and c in "*+{":
            self.take()
            least = int(self.until("}").split(",")[0]) if c == "{" else int(c == "+")
            return [(*r, GAP) for r in what] if least else [(GAP,)]
        return what


def trigram_query(pattern: str) -> list[tuple[str, ...]] | None:
    """Alternatives, each the lower-case trigrams a match must hold; None if one of them forces none.

    An alternative that demands more than another is dropped.
    """
    sets = set()
    for run in FixedRuns(pattern).branches():
        text = "".join("\0" if c is GAP else c.lower() for c in run)
        grams = frozenset(text[i:i + 3] for i in range(len(text) - 2) if "\0" not in text[i:i + 3])
        if not grams:
            return None
        sets.add(grams)
    return sorted(tuple(sorted(s)) for s in sets if not any(o < s for o in sets))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of the rule's leftmost non-overlapping matches that are long enough, in code points.

    Matches and the texts between them come from the same regex, so running
    sums of their lengths are the positions.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    asked = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else whole
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,asked:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + m["gap"]
        e = s + m["n"]
        one = F.struct(s.alias("start"), e.alias("end"), F.lit(rule.kind).alias("kind"), m["asked"].alias("asked"))
        return F.struct(e.alias("at"), F.when(m["asked"] >= rule.least, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("n"), asked.alias("asked"))
    return F.aggregate(zipped, start, step, lambda acc: F.transform(acc["spans"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))


#: Letters of running text, common first: a guess at which trigrams are rare. It decides nothing but the cost.
COMMON_FIRST = " etaoinshrdlcumwfgypbvkjxqz"


def leaders(alternatives: list[tuple[str, ...]]) -> dict[str, list[str]]:
    """A few trigrams of which every alternative has one, each with the other trigrams of its alternatives.

    Those of many alternatives first, then those of rare letters. A text without
    a leader has none of its alternatives, so the others are only looked up
    where the leader is.
    """
    rare = lambda g: sum(COMMON_FIRST.index(c) if c in COMMON_FIRST else 30 for c in g)
    left, found = list(alternatives), {}
    while left:
        first = max(sorted({g for a in left for g in a}), key=lambda g: (sum(g in a for a in left), rare(g)))
        found[first] = sorted({g for a in left if first in a for g in a} - {first})
        left = [a for a in left if first not in a]
    return found


#: Ids in a posting list of one slice, about; bits of the bitmap for each candidate, and at least and most (64 MB).
SLICE = 1 << 15
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 29


def postings(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """The inverted index: (slice, lists), with ``lists[g]`` the sorted ids of texts in the slice that have trigram number g.

    An id is a 64-bit hash of the text, so copies are one entry (two texts of one
    hash would only make a needless candidate), and a slice is a range of ids:
    however frequent a trigram is, its list comes in bounded pieces.
    """
    grams, lead = query_grams(rules)
    number = {g: i for i, g in enumerate(grams)}
    low = F.lower(F.col(text))

    def has(g: str) -> Column:
        return F.contains("low", F.lit(g))

    found = F.array_distinct(F.concat(*(
        F.when(has(first), F.array_compact(F.array(F.lit(number[first]), *(F.when(has(g), F.lit(number[g])) for g in more)))).otherwise(F.array().cast("array<int>"))
        for first, more in lead.items())))
    entries = written(docs.select(F.xxhash64(F.col(text)).alias("id"), low.alias("low")).select("id", F.explode(found).alias("gram")), "postings")
    slices = max(1, entries.count() // SLICE)
    part = F.pmod("id", F.lit(slices)).alias("slice")
    lists = entries.groupBy(part, "gram").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return lists.groupBy("slice").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))


def query_grams(rules: tuple[Rule, ...]) -> tuple[list[str], dict[str, list[str]]]:
    alternatives = sorted({a for r in rules for a in trigram_query(r.pattern) or ()})
    return sorted({g for a in alternatives for g in a}), leaders(alternatives)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ids of texts that may have a match of any of ``rules``: posting lists intersected for each alternative, then united."""
    number = {g: i for i, g in enumerate(query_grams(rules)[0])}
    none = F.array().cast("array<bigint>")

    def ids(alternative: tuple[str, ...]) -> Column:
        lists = [F.coalesce(F.try_element_at("lists", F.lit(number[g])), none) for g in alternative]
        out = lists[0]
        for more in lists[1:]:
            out = F.array_intersect(out, more)
        return out

    all_ids = F.flatten(F.array(*(ids(a) for r in rules for a in trigram_query(r.pattern)))) if rules else none
    return index.select(F.explode(F.array_distinct(all_ids)).alias("id"))


def as_bitmap(ids: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits) and the number of bits: bit ``id mod bits`` is set for each id.

    Its size grows with the ids up to MOST_BITS; where there are more, other
    texts share their bits and are verified in vain.
    """
    n = ids.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    at = F.pmod("id", F.lit(bits))
    return ids.groupBy((at / LEAST_BITS).cast("int").alias("secret_bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(LEAST_BITS))).alias("secret_bits")), bits


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, end, kind) in code points, by start, then in the rules' order.

    A null text counts as empty and has no spans. Texts of any length are scanned
    whole. All rows stay, repeated ones too, as do other columns; a column named
    secret_* of ours is replaced; a table without rows gives none. The index is
    kept in the shared folder while candidates are found; texts stay where they
    are, so neither copies nor frequent trigrams gather.
    """
    docs = docs.drop("secret_spans", "secret_bucket", "secret_bits", "secret_at")
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    lists = postings(docs, indexed, text)
    index = written(lists, "index")
    discard(lists)  # the entries that it was made from
    found = written(candidates(index, indexed), "candidates")
    bitmap, bits = as_bitmap(found)
    bitmap = written(bitmap, "bitmap")
    discard(index, found)
    keyed = docs.withColumn("secret_at", F.pmod(F.xxhash64(F.col(text)), F.lit(bits)))
    keyed = keyed.withColumn("secret_bucket", (F.col("secret_at") / LEAST_BITS).cast("int"))
    joined = keyed.join(F.broadcast(bitmap), "secret_bucket", "left")  # at most MOST_BITS / 8 bytes
    spot = F.pmod("secret_at", F.lit(LEAST_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("secret_bits", F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = joined.withColumn("secret_at", F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(spot, F.lit(8)))), F.lit(2)) == 1, F.lit(False)))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    body = F.col(text)
    parts = []
    for r in rules:
        look = F.col("secret_at") if r in indexed else F.lit(True)
        parts.append(F.when(look & body.rlike(r.quick or r.pattern), spans_of(body, r)).otherwise(none))
    rank = {r.kind: i for i, r in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    spans = F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order[a["kind"]] - order[b["kind"]]))
    return joined.withColumn("secret_spans", spans).drop("secret_at", "secret_bucket", "secret_bits")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, spans: str = "secret_spans", text: str = "text", mask: str = "[SECRET]") -> Column:
    """The text with each span replaced by ``mask`` (overlapping spans by one)."""
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.concat(body.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, step, lambda a: F.concat(a["out"], body.substr(a["at"] + 1, F.length(body))))).otherwise(body)


def op1(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("secret_spans")).alias("spans"))


def op1_sql() -> str:
    """The rules run on every text, without an index."""
    parts = []
    for i, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""
select row, {i} as rank, '{r.kind}' as kind, s as start, s + n as "end" from (
  select row, n, asked, sum(gap + n) over (partition by row order by k) - n as s from (
    select row, k, length(gaps[k]) as gap, length(whole[k]) as n, length(asked[k]) as asked from (
      select row, string_split_regex(t, {p}) as gaps, regexp_extract_all(t, {p}) as whole, regexp_extract_all(t, {p}, {r.group}) as asked from d),
      lateral (select unnest(range(1, len(whole) + 1)) as k))) where asked >= {r.least}""")
    names = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(parts)}),
said as (select *, kind || ':' || start || ':' || "end" as span from found),
by_row as (select row, {counts},
  coalesce(string_agg(span, ',' order by start, rank) filter (kind in ({names})), '') as base,
  string_agg(span, ',' order by start, rank) as spans from said group by row)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join by_row using (row)
"""
