"""Repair of the structure of conversations: the cheapest edits after which their roles follow (s?(ua)+)?, found by iterative-deepening A*.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role and text). The first fault of a row counts: blank (nothing but white space), duplicate (role and
text seen earlier in the conversation) or truncated (its last character beside white space isn't one of .!?). Edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank and
duplicate rows must go), Insert an empty user or assistant text anywhere (5); a truncated row that stays adds 5.

Search. A state is the number of rows done and what the roles so far allow (nothing yet, after system, after user, after assistant). The depth-first search tries edits in
ASCII order of their initials (D, I, K, R) and gives up a path whose cost and least remaining cost exceed the bound; the bound then rises to the least that was too much. A transposition
table holds for each state that failed what it costs at least from there on, so it isn't entered again with less. The first path that accepts is the cheapest one with the least string
of initials. The first estimate: 2 for each row that is faulty, 1 for each of the disjoint pairs of neighbours whose roles can't follow each other.

Scale. All rows are numbered in the order of (conv_id, turn, role, text) in ranges (``operators.ranking``) and cut into blocks of ``BLOCK`` rows. A conversation within a block is searched
at once. Of one that crosses blocks, each part is searched from each state to each state; parts end without insertions (these open the next one), so no
part's cheapest string starts another's and order of strings is order by parts. ``FAN`` parts at a time are put together to larger ones until one is left, and the
choice goes down again. No task holds more than BLOCK rows, or the figures of FAN parts, of a conversation; only the digest and the string of edits of a long conversation
are written by one task each, which streams through its parts.

Edge cases: a null role or text counts as one space, so it is no role, and blank. An empty role has no initial that could be kept. A null conv_id is a conversation too. Repeated rows are
duplicates. A conversation without rows has zeros, no edits and the digest of an empty string. An empty table gives an empty result. Texts of any length are taken whole;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import add_rank
from ..plans.durable import drop_table, materialize

BLOCK, FAN, SPACE = 256, 1024, " \t\n\v\f\r"
#: States: nothing yet, after system, after user, after assistant. The next user or assistant leads to NEXT; a kept role to KEEP.
NEXT, STATES = (2, 2, 3, 2), range(4)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Insertions that a conversation still needs at its end.
MISSING = (0, 2, 1, 0)
DELETE, INSERT, REROLE, TRUNCATED, NEVER = 2, 5, 1, 5, 1 << 40
LEGAL = {"su", "ua", "au"}

_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), *((c, pa.int64()) for c in _COUNTS), ("turn_lo", pa.int64()), ("turn_hi", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.list_(pa.int64())), ("place", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("rows", pa.list_(_TURN))])
_NODE = pa.schema([*(f for f in _PART if f.name not in ("whole", "audit", "rows")), ("parts", pa.list_(pa.int64())), ("path", pa.list_(pa.string()))])
_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(_TURN))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DDL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.list_(_TURN): "array<struct<role:string,text:string>>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


class Search:
    """Cheapest edits of ``rows`` (initial, must go, truncated) that lead to one of the states ``goals``. With ``closed`` none may be inserted behind the last row."""

    def __init__(self, rows: list[tuple[str, bool, bool]], goals: tuple[int, ...], closed: bool):
        self.rows, self.goals, self.closed = rows, goals, closed
        n = len(rows)
        faulty, pairs, keepable = [0] * (n + 1), [0] * (n + 2), [False] * (n + 1)
        after: int | None = None  # the next row without a fault, if none but rows that must go lie between
        for i in range(n - 1, -1, -1):
            initial, must_go, cut = rows[i]
            faulty[i] = faulty[i + 1] + DELETE * (must_go or cut)
            keepable[i] = keepable[i + 1] or initial == "s" and not must_go
            pairs[i] = pairs[i + 1]
            if not must_go:
                if not cut and after is not None and initial + rows[after][0] not in LEGAL:
                    pairs[i] = max(pairs[i], 1 + pairs[after + 1])
                after = None if cut else i
        self.least = []  # for each state what it costs at least from there on; rises as states fail
        for i in range(n + 1):
            for q in STATES:
                left = DELETE * (n - i)
                if i == n:
                    at_end = 0 if q in goals else NEVER if closed else INSERT * MISSING[q]
                elif goals == (0,):
                    at_end = left if q == 0 else NEVER
                elif goals == (1,):
                    at_end = left if q == 1 else left - DELETE if q == 0 and keepable[i] else NEVER
                else:
                    at_end = faulty[i] + pairs[i]
                self.least.append(at_end)

    def _moves(self, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        inside = i < len(self.rows)
        if inside:
            yield "D", DELETE, i + 1, q
        if inside or not self.closed:
            yield "I", INSERT, i, NEXT[q]
        if inside:
            initial, must_go, cut = self.rows[i]
            if not must_go:
                kept = KEEP.get(initial, {}).get(q)
                if kept is not None:
                    yield "K", TRUNCATED * cut, i + 1, kept
                if kept != NEXT[q]:
                    yield "R", REROLE + TRUNCATED * cut, i + 1, NEXT[q]

    def _within(self, start: int, bound: int) -> str | None:
        n, least = len(self.rows), self.least
        stack, letters = [[0, start, bound, self._moves(0, start), NEVER]], []
        if n == 0 and start in self.goals:
            return ""
        while stack:
            frame = stack[-1]
            i, q, left, moves, needed = frame
            for letter, cost, to, then in moves:
                if cost + least[4 * to + then] > left:
                    frame[4] = needed = min(needed, cost + least[4 * to + then])
                    continue
                letters.append(letter)
                if to == n and then in self.goals:
                    return "".join(letters)
                stack.append([to, then, left - cost, self._moves(to, then), NEVER])
                break
            else:  # the state failed
                least[4 * i + q] = max(least[4 * i + q], needed)
                stack.pop()
                if stack:
                    letters.pop()
                    above = stack[-1]
                    above[4] = min(above[4], above[2] - left + least[4 * i + q])
        return None

    def run(self, start: int) -> tuple[int, str] | None:
        """Cost and initials of the answer; None if no edits lead from ``start`` to a goal."""
        while (bound := self.least[start]) < NEVER:
            found = self._within(start, bound)
            if found is not None:
                return bound, found
        return None


def apply(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """``turns`` (role, text) after the edits of ``audit``."""
    out, i = [], 0
    for letter in audit:
        if letter == "K":
            state = KEEP[turns[i][0][:1]][state]
            out.append(turns[i])
        elif letter in "IR":
            state = NEXT[state]
            out.append(("user" if state == 2 else "assistant", turns[i][1] if letter == "R" else ""))
        i += letter != "I"
    return out


def _numbers(turns: list[int | None]) -> dict[str, int | None]:
    known = [t for t in turns if t is not None]
    return {"turns": len(set(known)), "turn_lo": min(known, default=None), "turn_hi": max(known, default=None)}


def _solve(b: pa.RecordBatch) -> Iterator[dict]:
    """A row for each part: its faults, and its answer if it is a whole conversation, else its answers from each state to each."""
    for g in b.to_pylist():
        turns, seen = [(r["role"], r["text"]) for r in g["rows"]], set(g["firsts"])
        rows, out = [], dict.fromkeys(_COUNTS, 0) | {"conv_id": g["conv_id"], "part": g["part"]} | _numbers([r["turn"] for r in g["rows"]])
        for r in g["rows"]:
            text = r["text"].strip(SPACE)
            fault = "blank" if not text else "duplicate" if r["place"] not in seen else "truncated" if text[-1] not in ".!?" else None
            if fault:
                out[fault] += 1
            rows.append((r["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"))
        out["illegal"] = sum(a[0] + c[0] not in LEGAL for a, c in zip(rows, rows[1:], strict=False))
        # A part that touches neither end of its block is a whole conversation.
        whole = g["rows"][0]["place"] > g["part"] * BLOCK and g["rows"][-1]["place"] < g["part"] * BLOCK + BLOCK - 1
        if whole:
            cost, audit = Search(rows, (0, 3), closed=False).run(0)
            out |= {"cost": [cost], "audit": [audit], "place": None, "rows": [dict(zip(("role", "text"), t, strict=True)) for t in apply(turns, audit)]}
        else:
            table = [Search(rows, (goal,), closed=True) for goal in STATES]
            found = [[table[goal].run(q) for goal in STATES] for q in STATES]
            out |= {"cost": [x[0] if x else NEVER for fs in found for x in fs], "audit": [x[1] if x else None for fs in found for x in fs], "rows": [dict(zip(("role", "text"), t, strict=True)) for t in turns]}
            out["place"] = [sorted(fs, key=lambda x: x[1] if x else "~").index(x) for fs in found for x in fs]
        yield out | {"whole": whole, "first": rows[0][0], "last": rows[-1][0]}


def _join(parts: list[dict]) -> dict:
    """Neighbouring parts as one. ``path``: for each pair of states those between the parts, as digits."""
    out = {c: sum(p[c] for p in parts) for c in _COUNTS} | {"first": parts[0]["first"], "last": parts[-1]["last"]}
    out |= {"turn_lo": min((p["turn_lo"] for p in parts if p["turn_lo"] is not None), default=None), "turn_hi": max((p["turn_hi"] for p in parts if p["turn_hi"] is not None), default=None)}
    for a, b in zip(parts, parts[1:], strict=False):
        out["illegal"] += a["last"] + b["first"] not in LEGAL
        out["turns"] -= a["turn_hi"] is not None and a["turn_hi"] == b["turn_lo"]
    cost, path, place = [NEVER] * 16, [None] * 16, [0] * 16
    for goal in STATES:
        rest = [[0 if q == goal else NEVER for q in STATES]]  # from the end back
        for p in reversed(parts):
            rest.append([min(p["cost"][4 * q + t] + rest[-1][t] for t in STATES) for q in STATES])
        rest.reverse()
        for start in STATES:
            if rest[0][start] >= NEVER:
                continue
            q, way = start, [start]
            for k, p in enumerate(parts):
                q = min((t for t in STATES if p["cost"][4 * q + t] + rest[k + 1][t] == rest[k][q]), key=lambda t, q=q, p=p: p["place"][4 * q + t])
                way.append(q)
            cost[4 * start + goal], path[4 * start + goal] = rest[0][start], "".join(map(str, way))
    for start in STATES:
        ways = [path[4 * start + g] for g in STATES]
        order = sorted({tuple(p["place"][4 * int(a) + int(c)] for p, a, c in zip(parts, w, w[1:], strict=False)) for w in ways if w})
        for g, w in enumerate(ways):
            place[4 * start + g] = order.index(tuple(p["place"][4 * int(a) + int(c)] for p, a, c in zip(parts, w, w[1:], strict=False))) if w else 4
    return out | {"cost": cost, "place": place, "path": path, "parts": [p["part"] for p in parts]}


def damage(chats: DataFrame, modulus: int = 20) -> DataFrame:
    """``chats(conv_id, turn, role, text)`` with faults by crc32 of ``conv_id:turn``: rows dropped, emptied, without sentence ends, repeated, or made the user's. Nulls are one space; the turn stays null."""
    none = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), none), F.lit(":"), F.coalesce(F.col("turn").cast("string"), none))) % modulus
    rows = chats.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _mapped(df: DataFrame, make, schema: pa.Schema) -> DataFrame:
    """``make(batch)`` yields dicts of ``schema``; a batch of rows out for some hundred in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                yield pa.RecordBatch.from_pylist(list(make(b.slice(at, 200))), schema=schema)

    return df.mapInArrow(task, _ddl(schema))


def _same(*cols: str):
    return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]


def _parts(chats: DataFrame) -> DataFrame:
    none = F.lit(" ")
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    rows = add_rank(rows, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "place").withColumn("place", F.col("place") - 1)
    part = F.expr(f"place div {BLOCK}").alias("part")
    firsts = rows.groupBy("conv_id", "role", F.md5("text").alias("digest")).agg(F.min("place").alias("place"))
    both = rows.select("conv_id", part, F.struct("place", "turn", "role", "text").alias("row"), F.lit(None).cast("long").alias("first"))
    both = both.union(firsts.select("conv_id", part, F.lit(None).cast(both.schema["row"].dataType), F.col("place")))
    groups = both.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"))
    return materialize(_mapped(groups, _solve, _PART), "parts")


def _chosen(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From parts of conversations that cross blocks: ``(conv_id, counts, cost)`` of each conversation, and ``(conv_id, part, state, goal, tail)``: between which states each part is
    passed, and how many rows are inserted behind it."""
    level, below = split.select(*[c for c in _NODE.names if c not in ("parts", "path")]), []
    while level.groupBy("conv_id").count().filter("count > 1").limit(1).count():
        groups = level.groupBy("conv_id", F.expr(f"part div {FAN}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("part", *[c for c in level.columns if c not in ("conv_id", "part", "path", "parts")]))).alias("inner"))
        make = lambda b: ({"conv_id": g["conv_id"], "part": g["node"]} | _join(g["inner"]) for g in b.to_pylist())
        level = materialize(_mapped(groups, make, _NODE), "joined")
        below.append(level)
    # The end of a conversation: the cheapest state for it, ties by the order of the strings.
    ends = [F.struct((F.col("cost")[g] + INSERT * MISSING[g]).alias("total"), F.col("place")[g].alias("order"), F.lit(g).alias("goal"), F.lit(MISSING[g]).alias("tail")) for g in STATES]
    top = materialize(level.withColumn("end", F.least(*ends)), "ends")
    way = top.select("conv_id", "part", F.lit(0).alias("state"), "end.goal", "end.tail")
    for nodes in reversed(below):
        inner = way.alias("a").join(nodes.alias("b"), _same("conv_id", "part")).select("a.conv_id", "tail", "parts", F.element_at("path", F.col("state") * 4 + F.col("goal") + 1).alias("path"))
        inner = inner.select("conv_id", "path", "tail", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
        digit = lambda at: F.substring("path", at, F.lit(1)).cast("int")
        way = inner.select("conv_id", "part", digit(F.col("k") + 1).alias("state"), digit(F.col("k") + 2).alias("goal"), F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise(0).alias("tail"))
    return top.select("conv_id", *_COUNTS, "turn_lo", "turn_hi", F.col("end.total").alias("cost")), materialize(way, "ways")


def _edited(b: pa.RecordBatch) -> Iterator[dict]:
    for r in b.to_pylist():
        audit = r["audit"] + "I" * r["tail"]
        yield {"conv_id": r["conv_id"], "part": r["part"], "audit": audit, "turns": [dict(zip(("role", "text"), t, strict=True)) for t in apply([(t["role"], t["text"]) for t in r["rows"]], audit, r["state"])]}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition; the texts stream through the hash."""
    conv, h, audits, any_line, begun = None, hashlib.sha256(), [], False, False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audits), "repaired_sha256": h.hexdigest()}], schema=_DIGEST)

    for b in batches:
        for i in range(len(b)):
            r = {c: b.column(c)[i].as_py() for c in ("conv_id", "audit", "turns")}
            if begun and r["conv_id"] != conv:
                yield done()
                h, audits, any_line = hashlib.sha256(), [], False
            conv, begun = r["conv_id"], True
            audits.append(r["audit"])
            for t in r["turns"]:
                h.update(("\n" * any_line + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                any_line = True
    if begun:
        yield done()


def repair(chats: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``report(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each conversation of ``ids`` (default: those of ``chats``), and
    ``turns(conv_id, part, place, role, text)``: the repaired rows, in the order of part and place."""
    parts = _parts(chats)
    split = parts.filter("not whole")
    counts, ways = _chosen(split)
    chosen = ways.alias("a").join(split.alias("b"), _same("conv_id", "part")).select("a.conv_id", "a.part", "a.state", "a.tail", "b.rows", F.element_at("b.audit", F.col("state") * 4 + F.col("goal") + 1).alias("audit"))
    pieces = materialize(_mapped(chosen, _edited, _PIECE), "pieces")
    drop_table(ways)
    digests = pieces.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part").mapInArrow(_digests, _ddl(_DIGEST))
    crossing = counts.alias("a").join(digests.alias("b"), _same("conv_id")).select("a.*", "b.audit", "b.repaired_sha256")
    whole = parts.filter("whole")
    text = F.array_join(F.transform("rows", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    within = whole.select(*[c for c in counts.columns if c != "cost"], F.col("cost")[0].alias("cost"), F.col("audit")[0].alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))
    found = within.unionByName(crossing)
    known = chats.select("conv_id") if ids is None else ids.select("conv_id")
    known = known.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gaps = F.coalesce(F.col("turn_hi") - F.col("turn_lo") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    report = known.alias("a").join(found.alias("b"), _same("conv_id"), "left").select("a.conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    turns = whole.select("conv_id", "part", F.posexplode("rows").alias("place", "turn")).union(pieces.select("conv_id", "part", F.posexplode("turns")))
    return report, turns.select("conv_id", "part", "place", "turn.role", "turn.text")
