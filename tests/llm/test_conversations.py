"""Repairs against a search of all edits, conversations of many segments against a plain table, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from cohortry.llm import conversations
from cohortry.llm.conversations import damaged, digests, repair

LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows: (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def in_order(rows):
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def by_search(rows):
    """(cost, audit, lines) of the best repair of a few rows: all edits, with at most two inserts at each place."""
    said, best = faults(rows), None
    inserts = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    own = []
    for (_, role, text), fault in zip(rows, said, strict=True):
        more = 5 if fault == "truncated" else 0
        options = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            options += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        own.append(options)
    for edits in itertools.product(*own):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i, extra in enumerate(put):
                cost, audit, lines = cost + 5 * len(extra), audit + "I" * len(extra), lines + [(r, "") for r in extra]
                if i < len(edits):
                    price, letter, line = edits[i]
                    cost, audit, lines = cost + price, audit + letter, lines + [line] * (line is not None)
            if (best is None or (cost, audit) < best[:2]) and LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
                best = cost, audit, lines
    return best


def by_table(rows):
    """The same, for many rows, by a table of the best way to each state."""
    lead = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    best = {0: (0, "", ())}

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                new = cost + 5, audit + "I", (*lines, (name[lead[s]], ""))
                out[lead[s]] = min(out.get(lead[s], new), new, key=lambda w: w[:2])
        return out

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        after, more = {}, 5 if fault == "truncated" else 0
        for s, (cost, audit, lines) in with_inserts(best).items():
            options = [(s, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                options.append((lead[s], cost + 1 + more, audit + "R", (*lines, (name[lead[s]], text))))
                if role[:1] == "s" and s == 0:
                    options.append((1, cost + more, audit + "K", (*lines, (role, text))))
                elif role[:1] == name[lead[s]][0]:
                    options.append((lead[s], cost + more, audit + "K", (*lines, (role, text))))
            for t, *way in options:
                after[t] = min(after.get(t, way), way, key=lambda w: tuple(w[:2]))
        best = {s: tuple(w) for s, w in after.items()}
    return min((w for s, w in with_inserts(best).items() if s in (0, 3)), key=lambda w: w[:2])


def expected(rows, solve):
    rows = in_order(rows)
    cost, audit, lines = solve(rows)
    said, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    two = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{x}" for r, x in lines)
    return gaps, said.count("blank"), said.count("duplicate"), said.count("truncated"), sum(x not in ("su", "ua", "au") for x in two), cost, audit, hashlib.sha256(text.encode()).hexdigest() if lines else None


def run(spark, convs, schema="conv_id long, turn long, role string, text string, place int, kind int, at string, conv int"):
    rows = [(c, *r, 1, 2, "3", 4) for c, own in convs.items() for r in own]
    random.Random(1).shuffle(rows)
    fixed = repair(spark.createDataFrame(rows, schema))
    sha = {r["conv_id"]: r["repaired_sha256"] for r in digests(fixed.turns).collect()}
    return {r["conv_id"]: (*list(r)[1:], sha.get(r["conv_id"])) for r in fixed.reports.collect()}, fixed


def invented(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "So? ", "é 漢."]
    return [(rng.choice([None, *range(n + 3)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"line {rng.random()}{rng.choice(['.', ''])}") for _ in range(n)]


def test_equals_a_search_of_all_edits(spark):
    rng = random.Random(5)
    convs = {i: invented(rng, 1 + i % 3) for i in range(60)} | {1000: [(0, "user", "a."), (1, "assistant", "b.")]}
    got, _ = run(spark, convs)
    assert got == {c: expected(own, by_search) for c, own in convs.items()}


@pytest.mark.parametrize("bits", [1, 3])
def test_many_segments_equal_a_table(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    convs = {i: invented(rng, rng.choice([1, 7, 40])) for i in range(25)} | {None: invented(rng, 120)}
    got, _ = run(spark, convs)
    assert got == {c: expected(own, by_table) for c, own in convs.items()}


def test_turns_repeats_long_texts_and_empty_tables(spark):
    long = "word " * 200_000 + "end."
    convs = {1: [(0, "assistant", long), (0, "assistant", long), (None, "user", "hello.")], 2: [(3, None, None)] * 3, 3: [(5, "system", "only.")], 4: [(1, "user", "same.")] * 50}
    got, fixed = run(spark, convs)
    assert got[1][6] == "KKD" and got[2][6] == "DDD" and got[2][7] is None and got[4][6] == "D" * 50
    kept = sorted((r["conv_id"], r["place"], r["turn"], r["role"], r["text"], r["edit"]) for r in fixed.turns.collect())
    assert [(r[0], *r[2:]) for r in kept] == [(1, None, "user", "hello.", "Keep"), (1, 0, "assistant", long, "Keep")]
    empty = repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert empty.reports.count() == empty.turns.count() == digests(empty.turns).count() == 0


def test_inserts_if_they_are_cheap(spark, monkeypatch):
    """By the given costs an insert never pays; with cheaper ones the ways and the turns made of them are right, too."""
    monkeypatch.setattr(conversations, "INSERT", 1)
    monkeypatch.setattr(conversations, "DELETE", 6)
    costs, words = conversations._steps()
    rng = random.Random(3)
    for _ in range(300):
        kind = np.array([rng.randrange(12) for _ in range(rng.randrange(1, 9))])
        best = {0: (0, "")}
        for k in kind:
            ways = [((c + int(costs[k, s, t]), a + conversations.WORDS[words[k, s, t]]), t) for s, (c, a) in best.items() for t in range(4) if costs[k, s, t] < conversations.NEVER]
            best = {t: min(w for w, to in ways if to == t) for t in {to for _, to in ways}}
        leave, (cost, audit) = min(best.items(), key=lambda x: x[1])
        items, low, high = conversations.Items(kind, costs, words), np.array([0]), np.array([len(kind)])
        assert conversations.forward(items, low, high, low)[0][0, leave] == cost == conversations.backward(items, low, high, np.array([leave]))[0, 0]
        behind = conversations.crossings(items, low, high, low, np.array([leave]))
        before = [0, *behind[:-1]]
        assert "".join(conversations.WORDS[words[k, s, t]] for k, s, t in zip(kind, before, behind, strict=True)) == audit
    rows = [(1, 10, 0, "user", "a.", 5 + 4, 0), (1, 11, 1, "user", "b.", 2, 3), (1, 12, 2, "tool", "c.", 15 + 1, 4), (2, 0, 0, "x", "d.", 10, 0)]
    got = conversations._edited(spark.createDataFrame(rows, "conv long, turn long, at long, role string, text string, step int, after int")).orderBy("conv", "place").collect()
    assert [(r["role"], r["text"], r["edit"][0], r["turn"]) for r in got] == [
        ("assistant", "", "I", None), ("user", "", "I", None), ("user", "a.", "K", 10), ("user", "", "I", None), ("assistant", "", "I", None), ("assistant", "", "I", None),
        ("user", "", "I", None), ("assistant", "c.", "R", 12), ("assistant", "", "I", None), ("user", "", "I", None), ("user", "d.", "R", 0),
    ]


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, 2, None) for t in (*range(30), None)]
    got = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate:
            want += [(c, t, "user" if fate == 4 else role, {1: "", 2: "One Two"}.get(fate, text))] * (2 if fate == 3 else 1)
    assert got == sorted(want, key=str)
