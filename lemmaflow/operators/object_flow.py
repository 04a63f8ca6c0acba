"""Which step makes and which step uses each goal, hypothesis and premise of a proof."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .reports import goal_blocks

EDGES = "theorem string, src string, dst string, edge_type string, label string, object_id string, object_kind string, confidence double"
STEPS = "theorem string, idx long, active_goal string, n_inputs int, n_outputs int, new_goals int, resynced int"


class _Objects:
    """The objects of one proof: who made them, and the latest hypothesis of each name and type."""

    def __init__(self) -> None:
        self.maker: dict[str, str] = {}
        self.latest: dict[tuple[str, str], str] = {}
        self.count: dict[str, int] = {}

    def new(self, kind: str, maker: str) -> str:
        n = self.count[kind] = self.count.get(kind, -1) + 1
        self.maker[f"{kind[0]}{n}"] = maker
        return f"{kind[0]}{n}"

    def goal(self, g, maker: str, parent: dict | None = None) -> tuple[dict, int]:
        """An open goal and the number of objects made for it. With a parent, what the parent has under the same name and type stays the same object; without one, the latest of that name and
        type is taken."""
        types, held, n = {d["name"]: d["type"] for d in g["declared"]}, {}, 1
        for key in types.items():
            had = self.latest.get(key) if parent is None else parent["held"].get(key[0]) if parent["types"].get(key[0]) == key[1] else None
            if had is None:
                had, n = self.new("hypothesis", maker), n + 1
                self.latest[key] = had
            held[key[0]] = had
        return {"key": (g["case_label"], g["target"]), "types": types, "held": held, "object": self.new("goal", maker)}, n


def _take(goals: list[dict], key: tuple) -> dict | None:
    """Removes and returns the first of the open goals with this key."""
    return next((goals.pop(i) for i, g in enumerate(goals) if g["key"] == key), None)


def _proof(rows: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Edges and steps of one proof, in one pass over its steps."""
    objects, premises, edges, steps = _Objects(), {}, [], []
    opened, outer, theorem = None, "in", rows["theorem"].iloc[0]
    for r in rows.sort_values("idx").itertuples(index=False):
        node, before, after, resynced = f"t{r.idx}", list(r.before), list(r.after), 0
        opened = [objects.goal(g, "in")[0] for g in before] if opened is None else opened
        work = []
        for g in before:
            entry = _take(opened, (g["case_label"], g["target"]))
            if entry is None:
                entry, resynced = objects.goal(g, outer)[0], resynced + 1
            work.append(entry)
        active, *others = work or opened or [None]
        used = []
        if active:
            used = [("goal_to_goal", "goal->goal", active["object"], "goal", 0.99)]
            names = {active["held"][x]: x for x in reversed(list(r.refs)) if x in active["held"]}  # an object counts once, by its first name
            used += [("hyp_to_goal", f"{x}->hyp", o, "hypothesis", 0.90) for o, x in names.items()]
        for name in r.premises:
            if name not in premises:
                premises[name] = objects.new("premise", "in")
            used.append(("premise_use", "premise->arg", premises[name], "premise", 0.75))
        edges += [(theorem, objects.maker[o], node, kind, label, o, what, sure) for kind, label, o, what, sure in used]
        # Each other goal goes on as the first goal after the step with its key; what is left is new.
        kept: dict[int, dict] = {}
        for entry in others:
            i = next((i for i, g in enumerate(after) if i not in kept and (g["case_label"], g["target"]) == entry["key"]), None)
            if i is not None:
                kept[i] = entry
        made = {i: objects.goal(g, node, active or {"held": {}, "types": {}}) for i, g in enumerate(after) if i not in kept}
        opened = [kept[i] if i in kept else made[i][0] for i in range(len(after))]
        if active and not after:
            edges.append((theorem, node, "out", "goal_to_goal", "proof_complete", active["object"], "goal", 0.99))
        steps.append((theorem, r.idx, active["object"] if active else None, len(used), sum(n for _, n in made.values()), len(made), resynced))
        outer = node if "\n" in r.tactic and "by" in r.tactic else outer
    return edges, steps


def _parsed(steps: DataFrame) -> DataFrame:
    tactic = F.coalesce("tactic", F.lit(""))
    return steps.select(F.col("theorem").cast("string").alias("theorem"), F.col("idx").cast("long").alias("idx"), tactic.alias("tactic"), goal_blocks(F.col("before")).alias("before"), goal_blocks(F.col("after")).alias("after"), t.identifier_refs(tactic).alias("refs"), F.coalesce("premises", F.array().cast("array<string>")).alias("premises"))


def object_flow(steps: DataFrame) -> DataFrame:
    """``steps(theorem, idx, tactic, before, after, premises array)`` -> the edges of each proof: ``in``, ``t<idx>`` and ``out`` are its nodes.

    A step works on the first goal before it, which is the open goal of the same case and target, or a new one if there is none (resynced). It uses that goal, the goal's hypotheses that its text
    names, and its premises. Goals after it that other goals before it equal stay what they are; the rest, and their new hypotheses, are made by the step. A step that leaves no goal completes
    the proof. A step without any goal uses its premises only. States are read by built-in functions; a group is one proof, whose steps follow each other."""
    return _parsed(steps).groupBy("theorem").applyInPandas(lambda rows: pd.DataFrame(_proof(rows)[0], columns=[c.split()[0] for c in EDGES.split(", ")]), EDGES)


def object_steps(steps: DataFrame) -> DataFrame:
    """The steps themselves: the goal each works on, its inputs and outputs, how many goals are new and how many had to be resynced."""
    return _parsed(steps).groupBy("theorem").applyInPandas(lambda rows: pd.DataFrame(_proof(rows)[1], columns=[c.split()[0] for c in STEPS.split(", ")]), STEPS)


def object_stats(steps: DataFrame) -> DataFrame:
    """Per proof: steps, those that branch (more than one new goal), inputs, outputs, resynced goals."""
    return object_steps(steps).groupBy("theorem").agg(F.count("*").alias("n_steps"), F.count_if(F.col("new_goals") > 1).alias("branching_steps"), F.sum("n_inputs").alias("inputs"), F.sum("n_outputs").alias("outputs"), F.sum("resynced").alias("resynced"))


def step_io(steps: DataFrame) -> DataFrame:
    """``steps(theorem, idx, before, after, premises)`` -> inputs (declarations kept), outputs (those added), premises and whether the target changed."""
    diff = t.goal_diff(F.col("before"), F.col("after"))
    return steps.select("theorem", "idx", diff.alias("d"), "premises").select("theorem", "idx", F.array_join("d.kept", " ").alias("inputs"), F.array_join("d.added", " ").alias("outputs"), F.array_join("premises", " ").alias("premise_refs"), "d.target_changed")
