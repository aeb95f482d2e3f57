"""Conversation repair: against all edit strings, by segments, and on odd rows."""

import functools
import hashlib
import random

from lexforge.llm import repair

NONE = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """(cost, audit) by trying every edit string of growing cost."""

    @functools.cache
    def go(i, q, budget):
        out = {(0, "")} if i == len(rows) and q in (0, 3) else set()
        to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        ways = [(2, "I", i, to)]
        if i < len(rows):
            initial, wrong = rows[i]
            ways.append((3, "D", i + 1, q))
            if wrong in (0, repair.CUT):
                ways.append((2 + (wrong > 0), "R", i + 1, to))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))
                if kept:
                    ways.append((int(wrong > 0), "K", i + 1, kept))
        for paid, edit, j, p in ways:
            if paid <= budget:
                out |= {(paid + c, edit + a) for c, a in go(j, p, budget - paid)}
        return frozenset(out)

    return min(next(s for b in range(100) if (s := go(0, 0, b))))


def test_search_finds_the_least_of_all_cheapest_audits():
    r = random.Random(3)
    for _ in range(150):
        rows = tuple((r.choice("suat"), r.choice([0, 0, repair.BLANK, repair.DUPLICATE, repair.CUT])) for _ in range(r.randint(0, 6)))
        assert min(repair.search(list(rows)).values()) == cheapest(rows)


def random_rows(n, seed):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None], ["a.", "b!", "c", " \t", None, "", "d?  \n", "e1", "f2."]
    return [(r.randint(0, 3), r.choice([None, *range(n // 6)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    """The report of one conversation by its rows, for what does not need the search."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    turns, seen, faults = [t for t, *_ in rows if t is not None], set(), []
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not stripped.strip(" \t\n\x0b\x0c\r") else 2 if (role, text) in seen else 3 if stripped[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = min(repair.search(list(zip(initials, faults, strict=True))).values())
    lines, at, last = [], 0, ""
    for e in audit:
        role, text = (None, "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e != "D":
            role = role if e == "K" else "assistant" if last == "user" else "user"
            lines.append(f"{role}:{text}")
            last = role
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_reports_like_brute_force_whole_and_by_segments(spark):
    rows = random_rows(160, 1)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cost", "'x' as audit")
    want = {c: brute([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    for how in ({}, {"long_rows": 8, "segment_rows": 5}, {"long_rows": 0, "segment_rows": 1}):
        assert {r.conv_id: tuple(r)[1:] for r in repair.repair(frame, **how).collect()} == want
    turns = [sorted(map(repr, repair.repaired_turns(frame, **how).collect())) for how in ({}, {"long_rows": 8, "segment_rows": 5})]
    assert turns[0] == turns[1]
    per = {}
    for r in sorted(repair.repaired_turns(frame).collect(), key=lambda r: (r.conv_id, r.place)):
        per.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in per.items()} == {c: w[-1] for c, w in want.items() if w[6].strip("D")}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b."), (None, None, None, None), (3, 5, "assistant", "only."), (4, 0, "user", "x." * 100_000), (4, 0, "user", "x." * 100_000)]
    ids = spark.createDataFrame([(1,), (9,), (9,), (None,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows, SCHEMA), also=ids).collect()}
    assert got[1][5:7] == (0, "KK") and got[9] == (0, 0, 0, 0, 0, 0, "", NONE)
    assert got[None] == (0, 1, 0, 0, 0, 3, "D", NONE)
    assert got[3][5:7] == (2, "IK") and got[4][2] == 1 and got[4][5:7] == (5, "KDI")
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and repair.repair(none, also=ids).count() == 3
    assert repair.repair(none, long_rows=0).count() == 0


def test_string_ids(spark):
    frame = spark.createDataFrame([("c", 0, "system", "s."), ("c", 1, "user", "u"), ("c", 3, "user", "u")], "conv_id string, turn long, role string, text string")
    assert tuple(repair.repair(frame).first()) == ("c", 1, 0, 1, 1, 1, 6, "KKDI", hashlib.sha256(b"system:s.\nuser:u\nassistant:").hexdigest())
