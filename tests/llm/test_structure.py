"""Conversation repair against all edit sequences of short conversations and a plain dynamic program over strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexspark.llm import structure
from lexspark.llm.structure import FAULTS, Conversation, cheapest

LEGAL = re.compile(r"(s?(ua)+)?")


def conversation(initials, faults):
    return Conversation(list(initials), bytearray(FAULTS.index(f) for f in faults))


def apply(initials, faults, audit):
    """(cost, role initials) of an audit whose inserts and new roles follow from the state, or None if it can't be."""
    rows, cost, roles = list(zip(initials, faults)), 0, ""
    for letter in audit:
        free = "a" if roles.endswith("u") else "u"
        if letter == "I":
            roles, cost = roles + free, cost + 3
            continue
        if not rows:
            return None
        initial, fault = rows.pop(0)
        if letter == "D":
            cost += 4
        elif fault in ("blank", "duplicate"):
            return None
        else:
            roles += initial if letter == "K" else free
            cost += {"K": 0, "R": 3}[letter] + 3 * (fault == "truncated")
            if letter == "K" and not initial:
                return None
    return None if rows or not LEGAL.fullmatch(roles) else (cost, roles)


def exhaustive(initials, faults):
    found = []
    n = len(initials)
    for length in range(n, n + 4):
        for audit in itertools.product("DIKR", repeat=length):
            if (got := apply(initials, faults, audit)) is not None:
                found.append((got[0], "".join(audit)))
    return min(found)


def by_strings(initials, faults):
    """The same by (cost, string) pairs, from the last row on."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "a": (0, "")}

    def closed(best):
        out = dict(best)
        for s in step:
            for t, n in ((step[s], 1), (step[step[s]], 2)):
                if t in best:
                    out[s] = min(out.get(s, (10**9, "")), (best[t][0] + 3 * n, "I" * n + best[t][1]))
        return out

    best = closed(best)
    for initial, fault in reversed(list(zip(initials, faults))):
        now = {}
        for s in step:
            options = [(4 + best[s][0], "D" + best[s][1])] if s in best else []
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((3 + more + best[step[s]][0], "R" + best[step[s]][1]))
                if (initial == "s" and s == "") or (initial in ("u", "a") and step[s] == initial):
                    options.append((more + best[initial][0], "K" + best[initial][1]))
            now[s] = min(options)
        best = closed(now)
    return best[""]


def test_exhaustively():
    cases = [(i, f) for n in range(4) for i in itertools.product("suax", repeat=n) for f in itertools.product(FAULTS, repeat=n)]
    for initials, faults in random.Random(1).sample(cases, 400) + [((), ())]:
        cost, edits = cheapest(conversation(initials, faults))
        assert (cost, "".join(edits)) == exhaustive(initials, faults) == by_strings(initials, faults)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_decide_as_one_number_would(block):
    rng = random.Random(block)
    for _ in range(300):
        n = rng.randrange(40)
        initials = rng.choices(["s", "u", "a", "t", ""], [1, 5, 5, 1, 1], k=n)
        faults = rng.choices(FAULTS, [6, 1, 1, 2], k=n)
        cost, edits = cheapest(conversation(initials, faults), block)
        assert (cost, "".join(edits)) == by_strings(initials, faults) and len(edits) == n + 1


def test_long_conversations_take_linear_time():
    import time

    n, rng, took = 20_000, random.Random(5), []
    for size in (n, 4 * n):
        rows = conversation(rng.choices("sua", k=size), rng.choices(FAULTS, k=size))
        began = time.process_time()
        cost, edits = cheapest(rows)
        took.append(time.process_time() - began)
        assert apply(rows.initials, [FAULTS[f] for f in rows.faults], "".join(edits))[0] == cost
    assert took[1] < 9 * took[0]


def plain(rows):
    """The whole contract row by row: {conv_id: result}."""
    show = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[:1] for _, r, _ in kept]
        cost, audit = by_strings(initials, faults)
        lines, i, state = [], 0, ""
        for letter in audit:
            state_next = "a" if state == "u" else "u"
            if letter == "I":
                lines.append(("user" if state_next == "u" else "assistant") + ":")
                state = state_next
                continue
            _, role, text = kept[i]
            i += 1
            if letter != "D":
                state = role[0] if letter == "K" else state_next
                lines.append((role if letter == "K" else "user" if state == "u" else "assistant") + ":" + text)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in FAULTS[1:]), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    got = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_on_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    assert result(structure.op12_structure(spark, data)) == want
    assert len({w[6] for w in want.values()}) > 2


def test_odd_rows(spark):
    """Null columns, ties, repeats, unknown and empty roles, long texts, clashing names, dropped conversations, an empty table."""
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(5), 2**40]), rng.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool"]), rng.choice([None, "", " \t", "Yes.", "no", "é ", "long " * 9000 + "."])) for _ in range(400)]
    only = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((only, 0, "user", "gone."))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, edits string").selectExpr("*", "n AS gaps", "n AS fault")
    summary, turns = structure.repair(structure.damaged(df))
    found = {r.conv_id: r.repaired_sha256 for r in structure.digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, found.get(r.conv_id, empty)) for r in summary.collect()}
    want = plain(rows)
    assert got == want and want[only] == (0, 0, 0, 0, 0, 0, "", empty)
    kept = turns.groupBy("conv_id").agg({"position": "max"}).count()
    assert kept == len(found)
    nothing, none = structure.repair(structure.damaged(df.limit(0)))
    assert nothing.count() == none.count() == 0
