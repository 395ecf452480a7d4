"""Conversation structure repair: a min-plus matrix scan over the turns.

A conversation should give role initials ``(s?(ua)+)?``. Its automaton has four
states: nothing yet (0), after a system turn (1), after a user turn (2), after an
assistant turn (3). Each turn is a 4x4 matrix over (cost, audit): the cheapest
edits, and of equally cheap ones the ASCII-least letters, that lead from one state
to another, with any insertions after the turn. Matrices multiply associatively:
of one pair of states and one run of turns, no cheapest audit is a prefix of
another, since what is longer has more insertions and costs more. So runs of turns
are folded where they lie, in range-sorted partitions, and a conversation that
spans partitions is combined in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import Tables

#: Costs of the edits, the letters in an audit, and what a row costs that stays truncated.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Faults of a row.
SOUND, GAP, TWICE, OPEN = 0, 1, 2, 3
#: Rows that are multiplied one by one before runs are combined in pairs, and runs that one step of the tree takes.
LEAF, FAN = 32, 8

#: From each state, the state that a user or an assistant turn leads to, and that turn's role.
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
Matrix = list[tuple[int, str] | None]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for k in range(4):
        row = [(j, b[4 * k + j]) for j in range(4) if b[4 * k + j]]
        for i in range(4):
            if (x := a[4 * i + k]):
                for j, y in row:
                    c, old = x[0] + y[0], out[4 * i + j]
                    if old is None or c < old[0] or c == old[0] and x[1] + y[1] < old[1]:
                        out[4 * i + j] = c, x[1] + y[1]
    return out


def closure() -> Matrix:
    """Any insertions: none, one or two, as more only come back to a state."""
    out: Matrix = [None] * 16
    for i in range(4):
        j = NEXT[i][0]
        out[4 * i + NEXT[j][0]] = 2 * INSERT, "II"
        out[4 * i + j] = INSERT, "I"
    for i in range(4):
        out[5 * i] = 0, ""
    return out


def turn(initial: str, fault: int) -> Matrix:
    """One row, then any insertions."""
    out: Matrix = [None] * 16
    more = TRUNCATED if fault == OPEN else 0
    for i in range(4):
        out[5 * i] = DELETE, "D"
        if fault in (SOUND, OPEN):
            j = NEXT[i][0]
            out[4 * i + j] = REROLE + more, "R"
            if initial == NEXT[i][1][0]:
                out[4 * i + j] = more, "K"
    if initial == "s" and fault in (SOUND, OPEN):
        out[1] = more, "K"
    return multiply(out, closure())


TURNS = {(initial, fault): turn(initial, fault) for initial in ("s", "u", "a", "") for fault in (SOUND, GAP, TWICE, OPEN)}
LONG, TEXT = T.LongType(), T.StringType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields.items()])


#: Sums of a run that add up, then first and last turn and initial, which tell what happens where two runs meet.
SUMS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
RUN = schema(conv_id=LONG, part=LONG, **dict.fromkeys(SUMS, LONG), low=LONG, high=LONG, head=TEXT, tail=TEXT, costs=T.ArrayType(LONG), audits=T.ArrayType(TEXT))


def meet(a: str, b: str) -> bool:
    """Whether turns of these initials may follow each other."""
    return a + b in ("su", "ua", "au")


class Run:
    """What is known of consecutive rows of one conversation."""

    def __init__(self, sums: list[int], low: int | None, high: int | None, head: str, tail: str, matrix: Matrix):
        self.sums, self.low, self.high, self.head, self.tail, self.matrix = sums, low, high, head, tail, matrix

    @classmethod
    def of(cls, turn: int | None, initial: str, fault: int) -> Run:
        return cls([1, fault == GAP, fault == TWICE, fault == OPEN, 0, turn is not None], turn, turn, initial, initial, TURNS[initial if initial in ("s", "u", "a") else "", fault])

    def __add__(self, other: Run) -> Run:
        sums = [x + y for x, y in zip(self.sums, other.sums, strict=True)]
        sums[4] += not meet(self.tail, other.head)
        sums[5] -= self.high is not None and self.high == other.low  # turns are sorted: only one can be common
        return Run(sums, other.low if self.low is None else self.low, self.high if other.high is None else other.high,
                   self.head, other.tail, multiply(self.matrix, other.matrix))

    def row(self) -> tuple:
        return (*map(int, self.sums), self.low, self.high, self.head, self.tail, [x and x[0] for x in self.matrix], [x and x[1] for x in self.matrix])

    @classmethod
    def read(cls, r: dict) -> Run | None:
        """None for a conversation of which nothing is left."""
        if not r["n"]:
            return None
        return cls([r[x] for x in SUMS], r["low"], r["high"], r["head"], r["tail"], [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)])


class Stack:
    """Adds runs in order as a balanced tree, so that long audits are not copied once a row."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Run]] = []

    def add(self, run: Run) -> None:
        size = 1
        while self.held and (self.held[-1][0] <= size or size < LEAF and self.held[-1][0] < LEAF):
            n, before = self.held.pop()
            run, size = before + run, n + size
        self.held.append((size, run))

    def total(self) -> Run | None:
        out = None
        for _, run in reversed(self.held):
            out = run if out is None else run + out
        return out


def batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    at = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(at)], schema=at)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition to a run for each conversation."""
    part, conv, stack, before, out = TaskContext.get().partitionId(), None, None, None, []

    def end() -> None:
        total = stack.total()
        out.append((conv, part, *(total.row() if total else (0, 0, 0, 0, 0, 0, None, None, None, None, None, None))))

    for b in batches:
        for c, turn, role, digest, copies, fault, later in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if stack is None or c != conv:
                if stack is not None:
                    end()
                conv, stack, before = c, Stack(), None
            for _ in range(copies):
                again = later or before == (turn, role, digest)
                before = (turn, role, digest)
                stack.add(Run.of(turn, role[:1], TWICE if again and fault != GAP else fault))
        if len(out) >= 1000:
            yield batch(out, RUN)
            out = []
    if stack is not None:
        end()
    if out:
        yield batch(out, RUN)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few runs of a conversation, by part, to one."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            total = None
            for x in r["runs"]:  # in order
                run = Run.read(x)
                total = run if total is None else total if run is None else total + run
            rows.append((r["conv_id"], r["part"], *(total.row() if total else (0, 0, 0, 0, 0, 0, None, None, None, None, None, None))))
        yield batch(rows, RUN)


AUDIT = schema(**dict.fromkeys(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), LONG), audit=TEXT)


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole conversation's matrix to the cheapest edits that end in an accepting state."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            run = Run.read(r)
            if run is None:
                rows.append((r["conv_id"], 0, 0, 0, 0, 0, 0, ""))
                continue
            whole = multiply(closure(), run.matrix)
            cost, audit = min(x for x in (whole[0], whole[3]) if x)
            gaps = 0 if run.low is None else run.high - run.low + 1 - run.sums[5]
            rows.append((r["conv_id"], gaps if gaps < 1 << 63 else None, *map(int, run.sums[1:5]), cost, audit))
        yield batch(rows, AUDIT)


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, digest; nulls of role and text are one space."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    out = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("copies"))
    return out.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` has conv_id, turn, role, text and, if wanted, ``copies``: how often the
    row stands there, 0 for a row that is gone but whose conversation is listed.
    Rows are taken by turn, nulls first; rows of one turn by role, then by the
    SHA-256 of their text. A null role or text counts as one space, rows without a
    conv_id are one conversation, and an initial other than s, u and a (also none,
    of an empty role) fits nowhere unless it is rewritten. A conversation with no
    rows has zeros and an empty audit. gaps is null beyond 2**63. Texts of any
    length are moved as hashes; a table without rows gives none; other columns,
    whatever their names, are not looked at.

    Audits have a letter for each row and insertion, so a conversation of n rows
    takes 16 n bytes in the last step of its tree.
    """
    all_rows = prepared(rows)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", GAP).when(last.isin(".", "!", "?"), SOUND).otherwise(OPEN)
    with Tables() as t:
        narrow = t.written(all_rows.select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault")), "turns")
        same = ["conv_id", "role", "digest"]
        first = (narrow.where("copies > 0").groupBy(*same).agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"))
                 .where("n > 1").select(*(F.col(x).alias(f"_{x}") for x in same), "least", "unnumbered"))
        later = F.coalesce(F.when(F.col("turn").isNull(), False).otherwise(F.col("unnumbered") | (F.col("turn") > F.col("least"))), F.lit(False))
        marked = narrow.join(first, narrow["conv_id"].eqNullSafe(first["_conv_id"]) & (narrow["role"] == first["_role"]) & (narrow["digest"] == first["_digest"]), "left")
        marked = t.written(marked.select("conv_id", "turn", "role", "digest", "copies", "fault", later.alias("later")), "marked")
        # equal rows have equal keys, so they lie in one partition; parts of a conversation are in order of the partitions
        runs = t.written(marked.orderBy("conv_id", *order()).mapInArrow(fold, RUN), "runs")
        parts = (runs.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            parts = -(-parts // FAN)
            at = F.floor(F.col("part") / FAN).alias("part")
            few = runs.groupBy("conv_id", at).agg(F.array_sort(F.collect_list(F.struct("part", *(f.name for f in RUN if f.name not in ("conv_id", "part"))))).alias("runs"))
            runs = t.written(few.mapInArrow(combine, RUN), "runs")
        return t.result(runs.mapInArrow(choose, AUDIT), "audits")


REPAIRED = schema(conv_id=LONG, position=LONG, role=TEXT, text=TEXT)
DIGEST = T.StructType([*AUDIT.fields, T.StructField("repaired_sha256", TEXT)])
#: Bytes of text in a batch that goes out.
BATCH = 8 << 20


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple]]:
    """("conversation", its audit row), then ("turn", (role, text)) for each turn of the repaired one."""
    letters, at, state = "", 0, 0

    def inserted() -> Iterator[tuple[str, tuple]]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state, role = NEXT[state]
            at += 1
            yield "turn", (role, "")

    names = [f"_{f.name}" for f in AUDIT]
    for b in batches:
        column = {n: b.column(n).to_pylist() for n in b.schema.names}
        for i, (kind, role, text, copies) in enumerate(zip(column["_kind"], column["role"], column["text"], column["copies"], strict=True)):
            if kind == 0:
                letters, at, state = column["_audit"][i], 0, 0
                yield "conversation", tuple(column["conv_id" if n == "_conv_id" else n][i] for n in names)
                yield from inserted()
                continue
            for _ in range(copies):
                edit = letters[at]
                at += 1
                if edit == "K":
                    state = 1 if role[0] == "s" else NEXT[state][0]
                    yield "turn", (role, text)
                elif edit == "R":
                    state, new = NEXT[state]
                    yield "turn", (new, text)
                yield from inserted()


def write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, conv, position = [], 0, None, 0
    for kind, x in edited(batches):
        if kind == "conversation":
            conv, position = x[0], 0
            continue
        rows.append((conv, position, *x))
        position, held = position + 1, held + len(x[1]) + 50
        if held >= BATCH:
            yield batch(rows, REPAIRED)
            rows, held = [], 0
    if rows:
        yield batch(rows, REPAIRED)


def write_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts pass by and are hashed; a conversation of any length takes a batch's memory and its audit."""
    rows, audit, said, fresh = [], None, None, True
    for kind, x in edited(batches):
        if kind == "conversation":
            if audit is not None:
                rows.append((*audit, said.hexdigest()))
            audit, said, fresh = x, hashlib.sha256(), True
            if len(rows) >= 1000:
                yield batch(rows, DIGEST)
                rows = []
        else:
            said.update(("" if fresh else "\n").encode() + f"{x[0]}:{x[1]}".encode())
            fresh = False
    if audit is not None:
        rows.append((*audit, said.hexdigest()))
    if rows:
        yield batch(rows, DIGEST)


def walk(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows in order, in one sorted stream: the audit is not copied to every row."""
    heads = found.select("conv_id", F.lit(0).alias("_kind"), *(F.col(f.name).alias(f"_{f.name}") for f in AUDIT if f.name != "conv_id"))
    body = prepared(rows).where("copies > 0").withColumn("_kind", F.lit(1))
    return heads.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", *order())


def repair(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text; one whose rows all go has none. See ``audits``."""
    return walk(rows, audits(rows) if found is None else found).mapInArrow(write_rows, REPAIRED)


def digests(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``audits`` with the SHA-256 of the repaired ``role:text`` lines, joined by newlines.

    One stream for each conversation, as a hash has to see its lines in order.
    """
    return walk(rows, audits(rows) if found is None else found).mapInArrow(write_digests, DIGEST)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20, dropped rows with no copies."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.select("conv_id", "turn", "role", "text", (F.crc32(F.concat_ws(":", *said).cast("binary")) % 20).alias("_fate"))
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("_fate") == 0, 0).when(F.col("_fate") == 3, 2).otherwise(1).alias("copies"))


def op12(rows: DataFrame) -> DataFrame:
    return digests(damage(rows))


def op12_sql() -> str:
    """The same, turn by turn: of each conversation and state the cheapest edits so far, with the lines that they give."""
    return """
with recursive crc_table as (
  with recursive step(b, k, c) as (
    select range, 0, range::BIGINT from range(256)
    union all
    select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::BIGINT) else c >> 1 end from step where k < 8)
  select list(c order by b) as tab from step where k = 8),
fated as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[xor(a & 255, b)::INT + 1]))) % 20 as fate
  from conversations, crc_table),
damaged as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
  case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from fated, range(2) copy(k) where fate <> 0 and (k = 0 or fate = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as n,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as ending from damaged),
turns as (select *, case when ending = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when ending in ('.', '!', '?') then 'sound' else 'truncated' end as fault,
  lag(role[1]) over (partition by conv_id order by n) || role[1] as pair from placed),
next(state, after, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts(state, after, cost, audit, lines) as (
  select state, state, 0, '', [] from next union all
  select state, after, 5, 'I', [role || ':'] from next union all
  select a.state, b.after, 10, 'II', [a.role || ':', b.role || ':'] from next a join next b on b.state = a.after),
start as (select conv_id, count(*) as rows from turns group by conv_id),
walk(conv_id, n, rows, state, best) as (
  select conv_id, 0, rows, after, struct_pack(cost := cost, audit := audit, lines := lines) from start, inserts where state = 0
  union all
  select conv_id, n, rows, after, min(best) from (
    select w.conv_id, (w.n + 1)::INT as n, w.rows, i.after, struct_pack(cost := w.best.cost + e.cost + i.cost, audit := w.best.audit || e.audit || i.audit,
      lines := w.best.lines || case when e.audit = 'D' then [] else [e.role || ':' || t.text] end || i.lines) as best
    from walk w join turns t on t.conv_id is not distinct from w.conv_id and t.n = w.n + 1
    cross join lateral (
      select w.state as after, 2 as cost, 'D' as audit, '' as role
      union all
      select x.after, case when t.fault = 'truncated' then 6 else 1 end, 'R', x.role from next x where x.state = w.state and t.fault in ('sound', 'truncated')
      union all
      select x.after, case when t.fault = 'truncated' then 5 else 0 end, 'K', t.role from (select state, after, role[1] as initial from next union all select 0, 1, 's') x
      where x.state = w.state and x.initial = t.role[1] and t.fault in ('sound', 'truncated')) e
    join inserts i on i.state = e.after) options
  group by conv_id, n, rows, after),
done as (select conv_id, min(best) as best from walk where n = rows and state in (0, 3) group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from turns group by conv_id)
select a.conv_id, coalesce(gaps, 0)::BIGINT as gaps, coalesce(blank, 0)::BIGINT as blank, coalesce(duplicate, 0)::BIGINT as duplicate, coalesce(truncated, 0)::BIGINT as truncated,
  coalesce(illegal, 0)::BIGINT as illegal, coalesce(best.cost, 0)::BIGINT as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join counts c on c.conv_id is not distinct from a.conv_id left join done d on d.conv_id is not distinct from a.conv_id
"""
