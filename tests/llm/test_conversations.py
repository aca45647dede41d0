"""Conversation repair against a plain search over all edits, also with conversations that reach over many blocks."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from motefield.llm import conversations as conv

FULL = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {"u": "user", "a": "assistant"}


def state_after(state, letter):
    """States 0, s, u, a as text prefixes of the wanted pattern; None where the letter may not stand."""
    ok = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
    return letter if letter in ok and letter else None


def best_edits(rows):
    """Cheapest edits, then the first in ASCII: rows of (initial, fault). All orders of edits are compared as texts."""
    rows = tuple(rows)

    @lru_cache(None)
    def rest(i, state, inserted):
        found = []
        if i == len(rows):
            if state in "0a":
                found.append((0, ""))
        else:
            initial, fault = rows[i]
            cost, word = rest(i + 1, state, 0)
            found.append((cost + 3, "D" + word))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if state_after(state, initial):
                    cost, word = rest(i + 1, state_after(state, initial), 0)
                    found.append((cost + more, "K" + word))
                for new in "ua":
                    if state_after(state, new):
                        cost, word = rest(i + 1, new, 0)
                        found.append((cost + 2 + more, "R" + word))
        if inserted < 3:
            for new in "ua":
                if state_after(state, new):
                    cost, word = rest(i, new, inserted + 1)
                    found.append((cost + 2, "I" + word))
        return min(found, default=(10**9, ""))

    for i in range(len(rows), -1, -1):
        for s in "0sua":
            for n in (3, 2, 1, 0):
                rest(i, s, n)
    return rest(0, "0", 0)


def expected(turns):
    """The contract, row by row, for one conversation: rows of (turn, role, text)."""
    rows = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, judged = set(), []
    for _, role, text in rows:
        last = FULL.findall(text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        judged.append((role[:1], fault))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(judged, judged[1:]))
    cost, audit = best_edits(judged)
    out, state, i = [], "0", 0
    for letter in audit:
        if letter == "I":
            state = "a" if state == "u" else "u"
            out.append(NAMES[state] + ":")
            continue
        _, role, text = rows[i]
        i += 1
        if letter != "D":
            state = role[:1] if letter == "K" else "a" if state == "u" else "u"
            out.append((role if letter == "K" else NAMES[state]) + ":" + text)
    faults = [f for _, f in judged]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def columns(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def random_turns(rng, n):
    texts = ["", " \t\n", "Yes.", "no", "Well? ", "so it goes", "end!\n", "…", "a.b", "ok."] + [f"text {k}." for k in range(12)]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User"]
    return [(rng.choice([None, *range(2 * n + 1)]) if rng.random() < 0.1 else k, rng.choice(roles), rng.choice(texts)) for k in range(n)]


def test_program_against_all_edits():
    rng = random.Random(1)
    faults = {0: None, 1: "truncated", 2: "blank"}
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 0, 0, 0, 2])) for _ in range(rng.randint(0, 9))]
        spread = [x for i, f, more in rows for x in [(i, faults[f]), *[(i, "duplicate")] * more]]
        cost, edits = conv.cheapest(rows)
        assert (cost, "".join(edits)) == best_edits(spread), rows


@pytest.mark.parametrize("bits", [12, 3, 1])
def test_repairs(spark, monkeypatch, bits):
    """With blocks of 8 and of 2 rows nearly every conversation is an open one."""
    monkeypatch.setattr(conv, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    table = {k: random_turns(rng, rng.randint(1, 14)) for k in range(60)}
    table |= {100: random_turns(rng, 150), 101: [(5, "user", "same.")] * 40, 102: [(None, "user", "x"), (None, "assistant", "x.")],
              103: [(1, "user", "")], 104: [(2, "system", "Be kind.")], 105: [(k, "user", f"q{k}") for k in range(70)],
              106: [(k, "user", "again.") for k in range(60)], None: random_turns(rng, 9), 107: [(0, "user", "a. " * 50_000), (1, "assistant", "b")]}
    rows = [(c, t, r, x, "z", 1) for c, turns in table.items() for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, k int").repartition(5)
    ids = spark.createDataFrame([(c,) for c in [*table, 999]], "conv_id long")
    got = {r.conv_id: columns(r) for r in conv.repaired(df, ids=ids).collect()}
    want = {c: expected(turns) for c, turns in table.items()}
    assert got.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c in want:
        assert got[c] == want[c][0], c
    lines = {}
    for r in conv.Repair(df).turns().orderBy("k", "place").collect():
        lines.setdefault(r.k, []).append((r.place, f"{r.role}:{r.text}"))
    for c in want:
        mine = lines.get("n" if c is None else f"c{c}", [])
        assert [t for _, t in mine] == want[c][1]
        assert [p for p, _ in mine] == list(range(len(mine)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conv.repaired(df).count() == 0
    assert conv.Repair(df).turns().count() == 0


def test_damage_and_query(spark):
    from motefield.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    source = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        mine = source.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        if kind:
            mine += [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: columns(r) for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert got == {c: expected(turns)[0] for c, turns in source.items()}
    odd = spark.createDataFrame([(None, 3, None, None), (1, None, "user", None)], "conv_id long, turn long, role string, text string")
    kinds = [zlib.crc32(b" :3") % 20, zlib.crc32(b"1: ") % 20]
    assert conv.damaged(odd).count() == sum({0: 0, 3: 2}.get(k, 1) for k in kinds)
