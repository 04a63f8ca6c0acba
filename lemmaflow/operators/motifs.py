"""Connected motifs in the flow graphs of proofs, and whether they may be collapsed into one step.

A motif lies within one proof, so a proof with its edges is a row: its sets are listed and judged where it is, and only counts are shuffled. A proof's edges are in memory together, not its sets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from heapq import nsmallest
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize
from ..plans.ship import ship_package

#: Rows of one batch that leaves a task.
BATCH = 10_000


def each_task(rows: DataFrame, columns: dict[str, str], work: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """What ``work`` yields for the rows of a task, ``rows(theorem, edges, ...)``, each a proof with its flow as an array; ``columns`` are the names and types of its tuples. They leave in batches, so a proof's aren't all in memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = batch.schema.field("edges").type.value_type.field("src").type
            known = {"theorem": batch.schema.field("theorem").type, "members": pa.list_(step), "set": pa.list_(step), "kinds": pa.list_(pa.string()), "good": pa.bool_(), "n": pa.int64(), "free": pa.int64()}
            schema = pa.schema([(c, known.get(c, pa.string())) for c in columns])
            found = work(p for b in chain([batch], batches) for i in range(b.num_rows) for p in b.slice(i, 1).to_pylist())
            while some := list(islice(found, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    ship_package(rows.sparkSession)
    return rows.mapInArrow(task, ", ".join(f"{c} {t}" for c, t in columns.items()))


def each_proof(rows: DataFrame, columns: dict[str, str], work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``each_task`` for what ``work`` yields for each proof by itself."""
    return each_task(rows, columns, lambda proofs: (x for p in proofs for x in work(p)))


def proofs(flow: DataFrame) -> DataFrame:
    """``(theorem, edges)``: a row for each proof; the edges are distinct."""
    return flow.groupBy("theorem").agg(F.collect_set(F.struct("src", "dst", "kind")).alias("edges"))


def _types(flow: DataFrame) -> tuple[str, str]:
    return flow.schema["theorem"].dataType.simpleString(), f"array<{flow.schema['src'].dataType.simpleString()}>"


def connected(edges: list[dict], size: int) -> Iterator[tuple]:
    """The connected sets of ``size`` steps of one proof, members sorted; each set once, with the sets of its first member."""
    near: dict = {}
    for e in edges:
        near.setdefault(e["src"], set()).add(e["dst"])
        near.setdefault(e["dst"], set()).add(e["src"])
    for first in near:
        sets = {(first,)}
        for _ in range(size - 1):
            sets = {tuple(sorted((*s, b))) for s in sets for a in s for b in near[a] if b > first and b not in s}
        yield from sets


def _patterns(proof: dict, size: int) -> Iterator[tuple]:
    """(pattern, members) of the connected sets of a proof."""
    heads, kinds = {}, {}
    for idx, head in sorted(((h["idx"], h["head"]) for h in proof["heads"]), key=lambda h: (h[0], h[1] or "")):
        heads.setdefault(idx, []).append(head)
    for e in proof["edges"]:
        kinds.setdefault(e["src"], {}).setdefault(e["dst"], []).append(e["kind"] or "")
    for members in connected(proof["edges"], size):
        named = [h for m in members for h in heads.get(m, ())]
        if named:
            at = {m: i for i, m in enumerate(members)}
            typed = sorted({f"{at[m]}-{at[to]}:{k}" for m in members for to, ks in kinds.get(m, {}).items() if to in at for k in ks})
            yield ">".join(h for h in named if h is not None) + " " + ",".join(typed), members


def _named_proofs(flow: DataFrame, heads: DataFrame) -> DataFrame:
    return proofs(flow).join(heads.groupBy("theorem").agg(F.collect_list(F.struct("idx", "head")).alias("heads")), "theorem")


def connected_sets(flow: DataFrame, size: int) -> DataFrame:
    """``(theorem, members)``: connected sets of ``size`` steps, members sorted; each set once. ``flow(theorem, src, dst, kind, ...)``."""
    theorem, members = _types(flow)
    return each_proof(proofs(flow), {"theorem": theorem, "members": members}, lambda p: ((p["theorem"], m) for m in connected(p["edges"], size)))


def motif_witnesses(flow: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """``(pattern, theorem, members)`` of all connected sets; a pattern is the heads in order with the induced typed edges. A proof is one row, so no set is shuffled."""
    theorem, members = _types(flow)
    return each_proof(_named_proofs(flow, heads), {"pattern": "string", "theorem": theorem, "members": members}, lambda p: ((x, p["theorem"], m) for x, m in _patterns(p, size)))


def motif_candidates(flow: DataFrame, heads: DataFrame, size: int, support: int) -> DataFrame:
    """``(pattern, support, witnesses)`` of the patterns in ``support`` theorems or more. Each proof counts its own sets."""
    by = each_proof(_named_proofs(flow, heads), {"pattern": "string", "n": "long"}, lambda p: iter(Counter(x for x, _ in _patterns(p, size)).items()))
    return by.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("witnesses")).filter(F.col("support") >= support)


def connected_motifs(flow: DataFrame, heads: DataFrame, size: int, support: int) -> tuple[DataFrame, DataFrame]:
    """Candidates ``(pattern, support, witnesses)`` and witnesses ``(pattern, theorem, members)``."""
    return motif_candidates(flow, heads, size, support), motif_witnesses(flow, heads, size)


class Ways:
    """Ways through a proof that leave a set of steps. If all edges go to later steps, a search ends at the last member: its work is the set's span."""

    def __init__(self, edges: list[dict]):
        self.after: dict = {}
        for e in edges:
            self.after.setdefault(e["src"], set()).add(e["dst"])
        self.forward = all(e["src"] < e["dst"] for e in edges)

    def around(self, members: list, strict: bool = False) -> Iterator[tuple]:
        """(at, to): members that a path joins whose inner steps, one at least, are all outside the set. A pair with an edge of its own is taken as its shortest path and left out, unless ``strict``."""
        inside, last = set(members), max(members)
        for start in inside:
            own = self.after.get(start, set())
            front = [x for x in own if x not in inside]
            seen, back = set(front), set()
            while front:
                at = front.pop()
                if self.forward and at > last:
                    continue
                for to in self.after.get(at, ()):
                    if to in inside:
                        back.add(to)
                    elif to not in seen:
                        seen.add(to)
                        front.append(to)
            yield from ((start, to) for to in back if strict or to not in own)


def _grouped(flow: DataFrame, witnesses: DataFrame, *columns: str) -> DataFrame:
    """A row for each proof with its edges and its witnesses; the only shuffle of both."""
    return witnesses.groupBy("theorem").agg(F.collect_list(F.struct(*columns)).alias("witnesses")).join(proofs(flow), "theorem")


def detour_pairs(flow: DataFrame, witnesses: DataFrame, strict: bool = False) -> DataFrame:
    """``(theorem, members, at, to)``: the pairs of members of a witness ``(theorem, members)`` that a path outside the set joins (``Ways.around``)."""
    theorem, members = _types(flow)

    def work(proof):
        ways = Ways(proof["edges"])
        return ((proof["theorem"], w["members"], [at, to]) for w in proof["witnesses"] for at, to in ways.around(w["members"], strict))

    found = each_proof(_grouped(flow, witnesses.select("theorem", "members").distinct(), "members"), {"theorem": theorem, "set": members, "members": members}, work)
    return found.select("theorem", F.col("set").alias("members"), F.col("members")[0].alias("at"), F.col("members")[1].alias("to"))


def detours(flow: DataFrame, witnesses: DataFrame, strict: bool = False) -> DataFrame:
    """Witnesses ``(theorem, members)`` with a path that leaves the set and comes back."""
    return detour_pairs(flow, witnesses, strict).select("theorem", "members").distinct()


def paths(flow: DataFrame, size: int) -> DataFrame:
    """``(theorem, members, heads, kinds)``: simple directed paths of ``size`` steps, members in the order of the path, the kinds of its edges as an array."""
    out = flow.select("theorem", F.array("src", "dst").alias("members"), F.concat_ws(">", "src_head", "dst_head").alias("heads"), F.array("kind").alias("kinds"), F.col("dst").alias("at"))
    nxt = flow.select("theorem", F.col("src").alias("at"), F.col("dst").alias("to"), "dst_head", "kind")
    for _ in range(size - 2):
        grown = out.join(nxt, ["theorem", "at"]).filter(~F.array_contains("members", F.col("to")))
        out = grown.select("theorem", F.concat("members", F.array("to")).alias("members"), F.concat_ws(">", "heads", "dst_head").alias("heads"), F.concat("kinds", F.array("kind")).alias("kinds"), F.col("to").alias("at"))
    return out.drop("at")


def _paths_of(edges: list[dict], size: int) -> Iterator[tuple]:
    """(members, heads, kinds) of the paths of one proof, as in ``paths``; the kinds as a tuple."""
    after: dict = {}
    for e in edges:
        after.setdefault(e["src"], []).append(e)

    def grow(members: tuple, heads: tuple, kinds: tuple) -> Iterator[tuple]:
        if len(members) == size:
            yield members, ">".join(h for h in heads if h is not None), kinds
            return
        for e in after.get(members[-1], ()):
            if e["dst"] not in members:
                yield from grow((*members, e["dst"]), (*heads, e["dst_head"]), (*kinds, e["kind"]))

    for e in edges:
        yield from grow((e["src"], e["dst"]), (e["src_head"], e["dst_head"]), (e["kind"],))


def _headed_proofs(flow: DataFrame) -> DataFrame:
    """``(theorem, edges)``: a row for each proof, its edges with their heads, repeated ones included."""
    return flow.filter("theorem is not null").groupBy("theorem").agg(F.collect_list(F.struct("src", "dst", "kind", "src_head", "dst_head")).alias("edges"))


class Judge:
    """Why a path of a proof may be collapsed or not; ``collapsible_paths`` has the reasons."""

    def __init__(self, edges: list[dict]):
        self.ways, self.typed = Ways(edges), {}
        for e in edges:
            self.typed.setdefault(e["src"], set()).add((e["dst"], e["kind"]))

    def reason(self, path: Sequence, kinds: Sequence) -> str:
        at = {m: i for i, m in enumerate(path)}
        if any(to in at and not (at[to] == i + 1 and kinds[i] == kind) for i, m in enumerate(path) for to, kind in self.typed.get(m, ())):
            return "missing_internal_edge"
        return "intermediate_path_violation" if any(at[a] < at[b] for a, b in self.ways.around(path)) else "ok"


def judged_paths(flow: DataFrame, size: int) -> DataFrame:
    """``collapsible_paths`` of all ``paths`` of ``size`` steps, each proof listing and judging its own: no path is shuffled."""

    def work(proof):
        judge = Judge(proof["edges"])
        return ((proof["theorem"], m, heads, kinds, judge.reason(m, kinds)) for m, heads, kinds in _paths_of(proof["edges"], size))

    theorem, members = _types(flow)
    return each_proof(_headed_proofs(flow), {"theorem": theorem, "members": members, "heads": "string", "kinds": "array<string>", "reason": "string"}, work)


def path_reasons(flow: DataFrame, size: int) -> DataFrame:
    """``(heads, kinds, reason, witnesses, support)`` of ``judged_paths``: how many there are and of how many theorems. Each proof counts its own."""

    def work(proof):
        judge = Judge(proof["edges"])
        counts = Counter((heads, kinds, judge.reason(m, kinds)) for m, heads, kinds in _paths_of(proof["edges"], size))
        return ((*key, n) for key, n in counts.items())

    by = each_proof(_headed_proofs(flow), {"heads": "string", "kinds": "array<string>", "reason": "string", "n": "long"}, work)
    return by.groupBy("heads", "kinds", "reason").agg(F.sum("n").alias("witnesses"), F.count("*").alias("support"))


def first_paths(flow: DataFrame, size: int, samples: int = 5) -> DataFrame:
    """Of ``judged_paths`` some that hold the first ``samples`` of each pattern by theorem and members: the first of each task, which judges no others. A task keeps ``samples`` paths of BATCH patterns at most."""

    def work(proofs):
        first: dict = {}
        for proof in proofs:
            own: dict = {}
            for m, heads, kinds in _paths_of(proof["edges"], size):
                own.setdefault((heads, kinds), []).append(m)
            judge = None
            for key, found in own.items():
                kept = first.setdefault(key, [])
                if len(kept) == samples and kept[-1][0] < proof["theorem"]:
                    continue
                judge = judge or Judge(proof["edges"])
                kept += [(proof["theorem"], m, judge.reason(m, key[1])) for m in nsmallest(samples, found)]
                kept.sort()
                del kept[samples:]
            if len(first) >= BATCH:
                yield from ((*w[:2], *key, w[2]) for key, kept in first.items() for w in kept)
                first = {}
        yield from ((*w[:2], *key, w[2]) for key, kept in first.items() for w in kept)

    theorem, members = _types(flow)
    return each_task(_headed_proofs(flow), {"theorem": theorem, "members": members, "heads": "string", "kinds": "array<string>", "reason": "string"}, work)


def collapsible_paths(flow: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``witnesses(theorem, members, heads, kinds)`` of ``paths`` with ``reason``: missing_internal_edge if the members have a typed edge that isn't one of the path's,
    intermediate_path_violation if an earlier member reaches a later one through steps outside the path alone, else ok."""
    theorem, members = _types(flow)

    def work(proof):
        judge = Judge(proof["edges"])
        return ((proof["theorem"], w["members"], w["heads"], w["kinds"], judge.reason(w["members"], w["kinds"])) for w in proof["witnesses"])

    columns = {"theorem": theorem, "members": members, "heads": "string", "kinds": "array<string>", "reason": "string"}
    return each_proof(_grouped(flow, witnesses, "members", "heads", "kinds"), columns, work)


def collapsible_majority(judged: DataFrame, samples: int = 5, share: float = 0.5) -> DataFrame:
    """``judged(heads, kinds, theorem, members, reason)`` -> patterns whose first ``samples`` witnesses (the variant looks at no more) are good in at least ``share`` of the cases."""
    first = Window.partitionBy("heads", "kinds").orderBy("theorem", "members")
    some = judged.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= samples)
    out = some.groupBy("heads", "kinds").agg(F.count("*").alias("sampled"), F.count_if(F.col("reason") == "ok").alias("good"))
    return out.withColumn("collapsible", F.col("good") >= share * F.col("sampled"))


def bfs_tree_motifs(flow: DataFrame, size: int = 4, support: int = 2) -> DataFrame:
    """Patterns of the paths of 2 to ``size`` steps in the breadth-first trees from each step: ``(heads, kinds, support, first)``; a theorem counts once for a pattern.

    A step's parent is the first one that sees it: among those a level above it the one with the least path, and of edges of two kinds the first."""
    step = materialize(flow.select("theorem", F.col("src").alias("at"), F.col("dst").alias("to"), "src_head", "dst_head", "kind"), "tree-edges")
    least = lambda df: df.groupBy("theorem", "start", "to").agg(F.min(F.struct("path", "kinds", "heads")).alias("x")).select("theorem", "start", F.col("to").alias("at"), "x.*")
    level = least(step.filter("at <> to").select("theorem", F.col("at").alias("start"), "to", F.array("at", "to").alias("path"), F.array("kind").alias("kinds"), F.array("src_head", "dst_head").alias("heads")))
    level = materialize(level, "tree-level")
    seen = found = level
    for _ in range(size - 2):
        grown = level.join(step, ["theorem", "at"]).filter("start <> to").join(seen.select("theorem", "start", F.col("at").alias("to")), ["theorem", "start", "to"], "left_anti")
        level = materialize(least(grown.select("theorem", "start", "to", F.concat("path", F.array("to")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.concat("heads", F.array("dst_head")).alias("heads"))), "tree-level")
        seen = found = seen.union(level)
    named = found.select(F.array_join("heads", ">").alias("heads"), F.array_join("kinds", ",").alias("kinds"), "theorem").distinct()
    return named.groupBy("heads", "kinds").agg(F.count("*").alias("support"), F.min("theorem").alias("first")).filter(F.col("support") >= support)


def size_summary(ranked: DataFrame) -> DataFrame:
    """``ranked(size, savings)`` -> per size of the motif: how many there are, median, 90th percentile and maximum of what they save."""
    return ranked.groupBy("size").agg(F.count("*").alias("candidates"), F.median("savings").alias("median_savings"), F.round(F.percentile("savings", F.lit(0.9)), 6).alias("p90_savings"), F.max("savings").alias("max_savings"))


def theorem_hits(accepted: DataFrame, candidates: DataFrame, k: int = 200) -> DataFrame:
    """``accepted(pattern, theorem, members)`` with ``candidates(pattern, savings)``: the first k hits of each theorem by savings, then size, then pattern and members."""
    rows = accepted.join(candidates.select("pattern", "savings"), "pattern")
    order = Window.partitionBy("theorem").orderBy(F.desc("savings"), F.desc(F.size("members")), "pattern", "members")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def collapsible(flow: DataFrame, candidates: DataFrame, witnesses: DataFrame, strict: bool = False) -> DataFrame:
    """Per candidate: witnesses, those without a detour, their share, and whether all are free of one."""
    some = witnesses.join(candidates.select("pattern"), "pattern", "left_semi")

    def work(proof):
        ways = Ways(proof["edges"])
        return ((w["pattern"], next(ways.around(w["members"], strict), None) is None) for w in proof["witnesses"])

    judged = each_proof(_grouped(flow, some, "pattern", "members"), {"pattern": "string", "good": "boolean"}, work)
    out = judged.groupBy("pattern").agg(F.count("*").alias("witnesses"), F.count_if("good").alias("good"))
    return out.withColumn("share", F.round(F.col("good") / F.col("witnesses"), 6)).withColumn("collapsible", F.col("good") == F.col("witnesses"))


def collapsible_motifs(flow: DataFrame, heads: DataFrame, size: int, support: int, strict: bool = False) -> DataFrame:
    """``collapsible`` of all ``connected_motifs``, each proof listing, judging and counting its own sets in one pass."""

    def work(proof):
        ways, counts = Ways(proof["edges"]), {}
        for pattern, members in _patterns(proof, size):
            n = counts.setdefault(pattern, [0, 0])
            n[0] += 1
            n[1] += next(ways.around(members, strict), None) is None
        return ((pattern, *n) for pattern, n in counts.items())

    by = each_proof(_named_proofs(flow, heads), {"pattern": "string", "n": "long", "free": "long"}, work)
    out = by.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("witnesses"), F.sum("free").alias("good")).filter(F.col("support") >= support).drop("support")
    return out.withColumn("share", F.round(F.col("good") / F.col("witnesses"), 6)).withColumn("collapsible", F.col("good") == F.col("witnesses"))


def greedy_disjoint(witnesses: DataFrame) -> DataFrame:
    """Per (pattern, theorem): sets taken by (last, first) member, skipping those that share a step with one taken."""
    nothing = F.struct(F.array().cast("array<bigint>").alias("used"), F.lit(0).alias("n"))

    def take(a, w):
        m = w["members"].cast("array<bigint>")
        return F.when(F.arrays_overlap(a["used"], m), a).otherwise(F.struct(F.concat(a["used"], m).alias("used"), (a["n"] + 1).alias("n")))

    key = F.struct(F.array_max("members").alias("last"), F.array_min("members").alias("first"), "members")
    groups = witnesses.groupBy("pattern", "theorem").agg(F.count("*").alias("raw"), F.sort_array(F.collect_list(key)).alias("ws"))
    return groups.select("pattern", "theorem", "raw", F.aggregate("ws", nothing, take)["n"].alias("disjoint"))


def ranking(disjoint: DataFrame, size: int, k: int) -> DataFrame:
    """Patterns by savings (size - 1 for each disjoint hit), with the share lost to overlap."""
    out = disjoint.groupBy("pattern").agg(F.sum("raw").alias("raw_hits"), F.sum("disjoint").alias("disjoint_hits"), F.count("*").alias("support"))
    out = out.withColumn("savings", F.col("disjoint_hits") * (size - 1)).withColumn("overlap_loss", F.round(1 - F.col("disjoint_hits") / F.greatest(F.lit(1), "raw_hits"), 6))
    return out.orderBy(F.desc("savings"), F.desc("support"), "pattern").limit(k)
