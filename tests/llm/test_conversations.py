"""Repair of conversations against plain dynamic programming over whole strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lemmaflow.llm import conversations

DDL = "conv_id long, turn long, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of the rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {0: (0, ""), 3: (0, ""), 2: (5, "I"), 1: (10, "II")}
    for (_, _, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for q in range(4):
            options = []
            for inserts in range(4):
                at = q
                for _ in range(inserts):
                    at = NEXT[at]
                moves = [("D", 2, at)]
                if fault not in ("blank", "duplicate"):
                    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], at))
                    moves += [("R", 1 + 5 * (fault == "truncated"), NEXT[at])] + ([("K", 5 * (fault == "truncated"), kept)] if kept is not None else [])
                options += [(5 * inserts + c + best[to][0], "I" * inserts + m + best[to][1]) for m, c, to in moves]
            now[q] = min(options)
        best = now
    cost, audit = best[0] if rows else (0, "")
    turns, i, q, out = [r[1] for r in rows if r[1] is not None], 0, 0, []
    for m in audit:
        if m == "K":
            q = {"s": 1, "u": 2, "a": 3}[rows[i][2][0]]
            out.append(f"{rows[i][2]}:{rows[i][3]}")
        elif m in "IR":
            q = NEXT[q]
            out.append(("user" if q == 2 else "assistant") + ":" + (rows[i][3] if m == "R" else ""))
        i += m != "I"
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check(spark, rows, with_damage=True):
    chats = spark.createDataFrame(rows, DDL)
    rows_after = damaged(rows) if with_damage else [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    by = defaultdict(list)
    for r in rows_after:
        by[r[0]].append(r)
    report, turns = conversations.repair(conversations.damage(chats) if with_damage else chats, chats)
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    assert got == {c: brute(by[c]) for c in {r[0] for r in rows}}
    texts = defaultdict(list)
    for r in turns.orderBy("conv_id", "part", "place").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() == x[-1] for c, x in got.items())
    return got


def chat(rng, conv, n, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    rows = []
    for t in range(n):
        role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
        text = rng.choice(["Yes.", "no", "", " \n", "What?", None, f"It is {t}.", f"and {t}", "Ünï!", "cut 日本"])
        rows.append((conv, rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.3 else t, role, text))
    return rows


def test_search_finds_the_least_string_of_the_cheapest(spark):
    rng = random.Random(5)
    rows = [r for conv in range(150) for r in chat(rng, conv, rng.randint(1, 14))]
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_long_conversations_are_put_together_from_parts(spark, seed, monkeypatch):
    """Blocks of 16 rows and 4 parts to a node: several levels, with conversations that begin and end anywhere in a block."""
    rng = random.Random(seed)
    monkeypatch.setattr(conversations, "BLOCK", 16)
    monkeypatch.setattr(conversations, "FAN", 4)
    rows = [r for conv, n in enumerate((700, 1, 16, 15, 17, 40, 3, 64, 129)) for r in chat(rng, conv, n)]
    check(spark, rows)


def test_one_conversation_of_thousands_of_rows(spark):
    rng = random.Random(9)
    rows = [(7, t, ("user", "assistant")[t % 2] if rng.random() < 0.97 else "system", f"It is {t}." if rng.random() < 0.95 else "Same.") for t in range(5000)]
    got = check(spark, rows)
    assert got[7][5] > 100


def test_odd_conversations(spark):
    long_text = "word " * 20_000 + "end."
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, None, "user", "Hello."), (1, None, "assistant", "Hello."),
        (2, 0, "user", ""), (3, 0, "system", "S."), (4, 0, "system", "S."), (4, 1, "user", "Q?"), (4, 2, "assistant", "A."), (5, 0, "user", long_text), (5, 1, "assistant", long_text + " cut"),
        (6, 5, "user", "Q?"), (6, 5, "user", "Q?"), (6, -9, "assistant", "A."), (7, 0, "", "Empty role."), (7, 1, "Assistant", "Upper case."),
    ]
    check(spark, rows, with_damage=False)
    check(spark, rows)
    report, turns = conversations.repair(conversations.damage(spark.createDataFrame([], DDL)))
    assert report.count() == turns.count() == 0


def test_every_row_dropped(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = check(spark, [(c, 0, "user", "Hi.") for c in gone])
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "Q?", 1, 2, "x"), (1, 1, "assistant", "A.", 3, 4, "y")]
    chats = spark.createDataFrame(rows, DDL + ", place long, part long, audit string")
    assert conversations.repair(chats)[0].select("cost", "audit").collect() == [(0, "KK")]
    assert conversations.damage(chats).columns == ["conv_id", "turn", "role", "text"]


def test_table_of_failures_only_rises():
    """Each failed state's value is a lower bound: the answer from there never costs less."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(1, 9))]
        s = conversations.Search(rows, (0, 3), closed=False)
        first = list(s.least)
        cost, audit = s.run(0)
        assert cost >= first[0] and all(a <= b for a, b in zip(first, s.least, strict=True))
        rest = conversations.Search(rows[1:], (0, 3), closed=False)
        for q in range(4):
            assert s.least[4 + q] <= rest.run(q)[0]
