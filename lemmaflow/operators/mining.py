"""Frequent premise sets, path motifs and what they would save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import drop_table, materialize
from .stats import rounded


def frequent_pairs(premises: DataFrame, support: int) -> DataFrame:
    """``(p1, p2, support)``, p1 < p2. Premises below the support can't be in a pair that reaches it and leave before the join."""
    often = premises.groupBy("premise").agg(F.count("*").alias("c")).filter(F.col("c") >= support).select("premise")
    some = premises.join(often, "premise", "left_semi")
    pairs = some.withColumnRenamed("premise", "p1").join(some.withColumnRenamed("premise", "p2"), "theorem").filter("p1 < p2")
    return pairs.groupBy("p1", "p2").agg(F.count("*").alias("support")).filter(F.col("support") >= support)


def frequent_triples(premises: DataFrame, pairs: DataFrame, support: int) -> DataFrame:
    """``(p1, p2, p3, support)`` whose three pairs are all frequent."""
    in_theorem = premises.withColumnRenamed("premise", "p1").join(premises.withColumnRenamed("premise", "p2"), "theorem").join(pairs.select("p1", "p2"), ["p1", "p2"], "left_semi")
    triples = in_theorem.join(premises.withColumnRenamed("premise", "p3"), "theorem").filter("p2 < p3")
    for a in ("p1", "p2"):
        triples = triples.join(pairs.select(F.col("p1").alias(a), F.col("p2").alias("p3")), [a, "p3"], "left_semi")
    return triples.groupBy("p1", "p2", "p3").agg(F.count("*").alias("support")).filter(F.col("support") >= support)


def frequent_sets(premises: DataFrame, support: int, max_size: int = 5) -> DataFrame:
    """``(size, items, support)``: all sets of one to ``max_size`` premises that ``support`` theorems or more have together; items in order. ``premises(theorem, premise)``; repeated rows count once.

    Theorems with the same premises are one basket with their number as weight, so the levels' work grows with the distinct baskets.
    Level by level: a basket's occurrences of frequent sets are kept by prefix (all items but the last), and two of one prefix join to a longer set. Only occurrences of frequent sets go on, so no
    set grows from one below the support, and a basket with many premises is a key for each of its prefixes from the second level on. The levels are stored tables; rounds stop where a level is empty."""
    # Rows without a theorem have nothing together: each premise of theirs is a basket.
    alone = F.when(F.col("theorem").isNull(), F.col("premise"))
    sets = premises.groupBy("theorem", alone.alias("alone")).agg(F.sort_array(F.collect_set(F.struct(F.col("premise").cast("string").alias("last")))).alias("items"))
    baskets = materialize(sets.groupBy("items").agg(F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()), "baskets")
    occurs = baskets.select("id", "weight", F.array().cast("array<string>").alias("prefix"), F.explode("items.last").alias("last"))
    levels, stored = [], [baskets]
    for size in range(1, max_size + 1):
        if size > 1:
            a, b = occurs.select("id", "prefix", F.col("last").alias("one")), occurs
            occurs = a.join(b, ["id", "prefix"]).filter("one < last").select("id", "weight", F.concat("prefix", F.array("one")).alias("prefix"), "last")
        often = materialize(occurs.groupBy("prefix", "last").agg(F.sum("weight").alias("support")).filter(F.col("support") >= support), "sets")
        levels.append(often.select(F.lit(size).alias("size"), F.concat("prefix", F.array("last")).alias("items"), "support"))
        if size == max_size or often.isEmpty():
            break
        occurs = materialize(occurs.join(often.select("prefix", "last"), ["prefix", "last"], "left_semi"), "occurrences")
        stored.append(occurs)
    for table in stored:
        drop_table(table)
    return reduce(DataFrame.union, levels)


def crystallization(sets: DataFrame, size: int, k: int) -> DataFrame:
    """Ranked positive savings = support * (size - 1) - size."""
    saved = F.col("support") * (size - 1) - size
    names = [f"p{i + 1}" for i in range(size)]
    return sets.select(F.array_join(F.array(*names), " + ").alias("items"), "support", saved.alias("savings")).filter("savings > 0").orderBy(F.desc("savings"), "items").limit(k)


def candidate_examples(premises: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of the highest support with their first three theorems."""
    best = pairs.orderBy(F.desc("support"), "p1", "p2").limit(k)
    some = premises.join(F.broadcast(best.select(F.explode(F.array("p1", "p2")).alias("premise")).distinct()), "premise", "left_semi")  # at most 2k names
    hits = F.broadcast(best).join(some.withColumnRenamed("premise", "p1"), "p1").join(some.withColumnRenamed("premise", "p2"), ["theorem", "p2"])
    order = Window.partitionBy("p1", "p2").orderBy("theorem")
    first = hits.withColumn("place", F.row_number().over(order)).filter("place <= 3")
    return first.groupBy("p1", "p2", "support").agg(F.concat_ws(" ", F.sort_array(F.collect_list("theorem")).cast("array<string>")).alias("theorems"))


def premise_sets(premises: DataFrame) -> DataFrame:
    return premises.groupBy("theorem").agg(F.count("*").alias("n_premises"), F.concat_ws(" ", F.sort_array(F.collect_set("premise"))).alias("premises"))


def support_distribution(sets: DataFrame) -> DataFrame:
    s = F.col("support")
    return sets.agg(F.min(s).alias("least"), F.max(s).alias("most"), rounded(F.avg(s)).alias("mean"), F.count_if(s == 2).alias("is_2"), F.count_if(s.between(3, 5)).alias("is_3_5"), F.count_if(s.between(6, 10)).alias("is_6_10"), F.count_if(s > 10).alias("is_11_up"))


def flow_edges(steps: DataFrame) -> DataFrame:
    """Edges of each proof's flow: goal edges idx -> idx + 1, hyp edges from the latest earlier step of the same head. ``(theorem, src, dst, src_head, dst_head, kind)``."""
    order, own = Window.partitionBy("theorem").orderBy("idx"), Window.partitionBy("theorem", "head").orderBy("idx")
    rows = steps.select("theorem", "idx", "head", F.lead("idx").over(order).alias("next"), F.lead("head").over(order).alias("next_head"), F.lag("idx").over(own).alias("last"))
    edge = lambda *ends: F.struct(*(c.alias(n) for c, n in zip(ends, ("src", "dst", "src_head", "dst_head", "kind"), strict=True)))
    goal = F.when(F.col("next").isNotNull(), edge(F.col("idx"), F.col("next"), F.col("head"), F.col("next_head"), F.lit("goal")))
    hyp = F.when(F.col("last") < F.col("idx") - 1, edge(F.col("last"), F.col("idx"), F.col("head"), F.col("head"), F.lit("hyp")))
    return rows.select("theorem", F.explode(F.array_compact(F.array(goal, hyp))).alias("e")).select("theorem", "e.*")


def path_motifs(flow: DataFrame, size: int, support: int) -> DataFrame:
    """Simple directed paths of ``size`` steps by heads and kinds of edges: support (theorems) and witnesses."""
    paths = flow.select("theorem", F.array("src", "dst").alias("path"), F.concat_ws(">", "src_head", "dst_head").alias("heads"), F.col("kind").alias("kinds"), F.col("dst").alias("at"))
    for _ in range(size - 2):
        nxt = flow.select(F.col("theorem"), F.col("src").alias("at"), F.col("dst").alias("to"), "dst_head", "kind")
        paths = paths.join(nxt, ["theorem", "at"]).filter(~F.array_contains("path", F.col("to")))
        paths = paths.select("theorem", F.concat("path", F.array("to")).alias("path"), F.concat_ws(">", "heads", "dst_head").alias("heads"), F.concat_ws(",", "kinds", "kind").alias("kinds"), F.col("to").alias("at"))
    by = paths.groupBy("heads", "kinds", "theorem").agg(F.count("*").alias("w"))
    return by.groupBy("heads", "kinds").agg(F.count("*").alias("support"), F.sum("w").alias("witnesses")).filter(F.col("support") >= support)


def path_witnesses(flow: DataFrame) -> DataFrame:
    """Two-step witnesses ``(heads, kinds, theorem, first, last)`` for the choice of disjoint ones."""
    return flow.select(F.concat_ws(">", "src_head", "dst_head").alias("heads"), F.col("kind").alias("kinds"), "theorem", F.col("src").alias("first"), F.col("dst").alias("last"))


def disjoint_witnesses(witnesses: DataFrame) -> DataFrame:
    """Per (candidate, theorem): greedy choice by (last, first), skipping overlaps in steps. Groups are as small as a proof."""
    nothing = F.struct(F.array().cast("array<bigint>").alias("used"), F.lit(0).alias("n"))

    def take(a, w):
        ends = F.array(w["first"].cast("bigint"), w["last"].cast("bigint"))
        return F.when(F.arrays_overlap(a["used"], ends), a).otherwise(F.struct(F.concat(a["used"], ends).alias("used"), (a["n"] + 1).alias("n")))

    groups = witnesses.groupBy("heads", "kinds", "theorem").agg(F.count("*").alias("raw"), F.sort_array(F.collect_list(F.struct("last", "first"))).alias("ordered"))
    return groups.select("heads", "kinds", "theorem", "raw", F.aggregate("ordered", nothing, take)["n"].alias("disjoint"))


def compression_ranking(disjoint: DataFrame, size: int = 2) -> DataFrame:
    """Per candidate: hits, disjoint hits, savings = disjoint * (size - 1), and the share lost to overlap."""
    out = disjoint.groupBy("heads", "kinds").agg(F.sum("raw").alias("raw_hits"), F.sum("disjoint").alias("disjoint_hits"), F.count("*").alias("support"))
    return out.withColumn("savings", F.col("disjoint_hits") * (size - 1)).withColumn("overlap_loss", rounded(1 - F.col("disjoint_hits") / F.greatest(F.lit(1), "raw_hits")))
