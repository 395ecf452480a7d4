"""Conversation repair against an exhaustive search, a sequential programme, and over many partitions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyweave.llm import conversations
from tests.llm.test_exact import tables_left

TALK = "conv_id long, turn long, role string, text string, position string, audit string, _kind string, copies string"
GOOD = re.compile(r"(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fate = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults(talk):
    seen, out = set(), []
    for _, _, role, text in talk:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "sound" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(talk, found):
    """(cost, audit, lines), row by row over prefixes of the target; states are the initials so far, shortened."""
    after = {"": {"u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    def insertions(best):
        for _ in range(2):
            for state, (cost, audit, lines) in [*best.items()]:
                for i, new in after[state].items():
                    option = (cost + 5, audit + "I", [*lines, f"{full[i]}:"])
                    if new not in best or option[:2] < best[new][:2]:
                        best[new] = option
        return best

    best = insertions({"": (0, "", [])})
    for (_, _, role, text), fault in zip(talk, found, strict=True):
        options = defaultdict(list)
        for state, (cost, audit, lines) in best.items():
            options[state].append((cost + 2, audit + "D", lines))
            if fault in ("sound", "truncated"):
                more = 5 * (fault == "truncated")
                to = {**after[state], **({"s": "s"} if state == "" else {})}
                if role[:1] in to and role:
                    options[to[role[:1]]].append((cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for i, new in after[state].items():
                    options[new].append((cost + 1 + more, audit + "R", [*lines, f"{full[i]}:{text}"]))
        best = insertions({s: min(o, key=lambda x: x[:2]) for s, o in options.items()})
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def exhaustive(talk, found):
    """All edits with up to three insertions; whatever gives the target is compared."""
    best = None
    for edits in itertools.product("DKua", repeat=len(talk)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found, strict=True)):
            continue
        for n in range(4):
            for at in itertools.combinations_with_replacement(range(len(talk) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    cost, audit, initials, k = 5 * n, "", "", 0
                    for i in range(len(talk) + 1):
                        while k < n and at[k] == i:
                            audit, initials, k = audit + "I", initials + roles[k], k + 1
                        if i < len(talk):
                            e = edits[i]
                            audit += e if e in "DK" else "R"
                            cost += {"D": 2, "K": 0}.get(e, 1) + 5 * (e != "D" and found[i] == "truncated")
                            initials += "" if e == "D" else (talk[i][2][:1] or "?") if e == "K" else e
                    if GOOD.fullmatch(initials) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def brute(rows):
    talks = {r[0]: [] for r in rows}
    for r in damaged(rows):
        talks[r[0]].append(r)
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        found, turns = faults(talk), [r[1] for r in talk if r[1] is not None]
        cost, audit, lines = cheapest(talk, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def make(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", "r", "s") for r in rows], TALK).repartition(5)


def talk(rng, conv, n, roles=("user", "assistant", "system", "tool", "", None)):
    said = ["Yes.", "No", "Why?", "x ", "end. \n", "", " \t", None, "é!", "。", "Yes.\x1c"]
    return [(conv, rng.choice([k, k, k, k + 3, None]), rng.choice(roles), rng.choice(said)) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [r for conv in range(150) for r in talk(rng, conv, rng.randrange(1, 9))]
    out += [(200, k, "user" if k % 2 else "assistant", f"turn {k % 7}" + ".!?"[k % 3]) for k in range(60)] + [(201, 5, "system", "Only.")]
    out += [(None, k, "user", "Same.") for k in range(30)] + [(202, k, ("user", "assistant")[k % 2], "long " * 30_000 + f"{k}.") for k in range(4)]
    return [*out, *out[:5], (203, -2**63, "user", "a."), (203, 2**63 - 2, "assistant", "b.")]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_matrices_against_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        t = [(0, k, r or " ", x or " ") for k, (_, _, r, x) in enumerate(talk(rng, 0, rng.randrange(1, 5)))]
        found = faults(t)
        assert cheapest(t, found)[:2] == exhaustive(t, found)
        total = None
        for (_, k, role, _), f in zip(t, found, strict=True):
            run = conversations.Run.of(k, role[:1], {"sound": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f])
            total = run if total is None else total + run
        whole = conversations.multiply(conversations.closure(), total.matrix)
        assert min(x for x in (whole[0], whole[3]) if x) == exhaustive(t, found)


def test_matrices_are_associative():
    rng = random.Random(4)
    for _ in range(200):
        runs = [conversations.Run.of(rng.choice([None, k]), rng.choice("suat"), rng.randrange(4)) for k in range(9)]
        left, right, stack = runs[0], runs[-1], conversations.Stack()
        for r in runs[1:]:
            left = left + r
        for r in runs[-2::-1]:
            right = r + right
        for r in runs:
            stack.add(r)
        assert left.matrix == right.matrix == stack.total().matrix


def test_repair(spark, rows):
    before = tables_left(spark)
    got = conversations.op12(make(spark, rows))
    want = [tuple(None if i == 1 and x >= 1 << 63 else x for i, x in enumerate(r)) for r in brute(rows)]
    assert ordered(map(tuple, got.collect())) == ordered(want)
    assert len(tables_left(spark) - before) == 1
    assert conversations.op12(make(spark, [])).collect() == []


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """A third of all rows are one conversation: its runs lie in several partitions and meet in a tree."""
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"{rng.randrange(9**9)}{rng.choice(['.', '!', ''])}") for k in range(6000)]
    rows += [r for conv in range(100, 1600) for r in talk(rng, conv, 8, ("user", "assistant"))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    seen = []
    monkeypatch.setattr(conversations, "FAN", 2)
    written = conversations.Tables.written
    monkeypatch.setattr(conversations.Tables, "written", lambda self, df, name: seen.append((name, out := written(self, df, name), out.where("conv_id = 7").count())) or out)
    try:
        got = conversations.op12(make(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    parts = [n for name, _, n in seen if name == "runs"]
    assert len(parts) >= 4 and parts[0] >= 6 and parts[-1] == 1
    assert ordered(map(tuple, got)) == ordered(brute(rows))


def test_repaired_rows(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    table = make(spark, rows)
    found = conversations.audits(table.drop("copies"))
    lines = defaultdict(list)
    for r in conversations.repair(table.drop("copies"), found).collect():
        lines[r["conv_id"]].append((r["position"], r["role"], r["text"]))
    for r in found.collect():
        said = sorted(lines[r["conv_id"]])
        assert [p for p, _, _ in said] == [*range(len(said))]
        assert GOOD.fullmatch("".join(role[0] for _, role, _ in said))
        assert len(said) == sum(r["audit"].count(x) for x in "KRI")
