"""Graphs of single proofs, built for all proofs together: everything is keyed by (theorem, node)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import drop_table, materialize
from .stats import rounded


def transitions(steps: DataFrame, state: str = "head") -> DataFrame:
    """``(theorem, idx, before, after)``: the state at a step and at the next."""
    order = Window.partitionBy("theorem").orderBy("idx")
    return steps.select("theorem", "idx", F.col(state).alias("before"), F.lead(state).over(order).alias("after")).filter("after is not null")


def state_nodes(trans: DataFrame) -> DataFrame:
    """One node per distinct state of a theorem, numbered by first sight; initial and terminal flags."""
    seen = trans.select("theorem", F.col("before").alias("state"), (2 * F.col("idx")).alias("at"), F.lit(1).alias("out")).union(trans.select("theorem", "after", 2 * F.col("idx") + 1, F.lit(0)))
    first = seen.groupBy("theorem", "state").agg(F.min("at").alias("at"), F.max("out").alias("out"))
    number = F.row_number().over(Window.partitionBy("theorem").orderBy("at")) - 1
    return first.select("theorem", "state", number.alias("node"), (number == 0).alias("is_initial"), (F.col("out") == 0).alias("is_terminal"))


def state_edges(trans: DataFrame) -> DataFrame:
    """``(theorem, src, dst, idx)`` by node numbers."""
    n = state_nodes(trans)
    a, b = n.select("theorem", F.col("state").alias("before"), F.col("node").alias("src")), n.select("theorem", F.col("state").alias("after"), F.col("node").alias("dst"))
    return trans.join(a, ["theorem", "before"]).join(b, ["theorem", "after"]).select("theorem", "src", "dst", "idx")


def forward_edges(trans: DataFrame) -> DataFrame:
    """State edges to states that come later in order of first sight: acyclic."""
    return state_edges(trans).filter("src < dst").select("theorem", "src", "dst").distinct()


def levels(edges: DataFrame) -> DataFrame:
    """``(theorem, node, level)``: longest distance from the proof's sources, for all proofs in the same rounds."""
    edges = materialize(edges, "proof-edges")
    ends = edges.select("theorem", F.col("src").alias("node")).union(edges.select("theorem", "dst")).distinct()
    level = materialize(ends.select("theorem", "node", F.lit(0).alias("level")), "proof-levels")
    # In an acyclic graph no path has as many edges as the graph has nodes.
    most = level.groupBy("theorem").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for k in count():
        if k > most:
            raise ValueError("a proof has a cycle")
        got = edges.join(level.withColumnRenamed("node", "src"), ["theorem", "src"]).groupBy("theorem", F.col("dst").alias("node")).agg(F.max(F.col("level") + 1).alias("got"))
        new = materialize(level.join(got, ["theorem", "node"], "left").select("theorem", "node", F.greatest("level", F.coalesce("got", "level")).alias("level"), (F.coalesce("got", "level") > F.col("level")).alias("moved")), "proof-levels")
        level = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return level


SMALL_PROOF = 256


def level_widths(edges: DataFrame, small: int = SMALL_PROOF) -> DataFrame:
    """``(theorem, widths)``: how many nodes lie at each distance from the proof's first root (the smallest node without an edge into it; the smallest of all if there is none).

    A proof of up to ``small`` edges is searched within its row, by an ``aggregate`` over its edges for each level: one shuffle for all of them, however deep. Larger ones are searched together in
    rounds, a join for each level."""
    ends = edges.select("theorem", F.col("src").alias("node"), F.lit(0).alias("entered"), F.lit(1).alias("e")).union(edges.select("theorem", "dst", F.lit(1), F.lit(0)))
    per = ends.groupBy("theorem", "node").agg(F.max("entered").alias("entered"), F.sum("e").alias("e"))
    root = F.coalesce(F.min(F.when(F.col("entered") == 0, F.col("node"))), F.min("node")).cast("long").alias("root")
    heads = materialize(per.groupBy("theorem").agg(root, F.count("*").alias("n"), F.sum("e").alias("e")), "proofs")
    pairs = edges.select("theorem", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    rows = pairs.join(heads.filter(F.col("e") <= small), "theorem").groupBy("theorem", "root", "n").agg(F.collect_set(F.struct("src", "dst")).alias("es"))

    def wider(a, _):
        below = F.filter("es", lambda e: F.array_contains(a["front"], e["src"]))
        front = F.array_except(F.transform(below, lambda e: e["dst"]), a["seen"])
        return F.struct(front.alias("front"), F.concat(a["seen"], front).alias("seen"), F.when(F.size(front) > 0, F.concat(a["widths"], F.array(F.size(front).cast("long")))).otherwise(a["widths"]).alias("widths"))

    start = F.struct(F.array("root").alias("front"), F.array("root").alias("seen"), F.array(F.lit(1).cast("long")).alias("widths"))
    done = rows.select("theorem", F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("n").cast("int"))), start, wider)["widths"].alias("widths"))
    large = heads.filter(F.col("e") > small)
    if large.isEmpty():
        return done
    big = materialize(pairs.join(large.select("theorem"), "theorem", "left_semi"), "proof-edges")
    seen = materialize(large.select("theorem", F.col("root").alias("node"), F.lit(0).alias("level")), "proof-levels")
    for k in count():
        front = big.join(seen.filter(F.col("level") == k).withColumnRenamed("node", "src"), ["theorem", "src"]).select("theorem", F.col("dst").alias("node")).distinct()
        new = materialize(seen.union(front.join(seen, ["theorem", "node"], "left_anti").withColumn("level", F.lit(k + 1))), "proof-levels")
        drop_table(seen)
        seen = new
        if seen.filter(F.col("level") == k + 1).isEmpty():
            break
    drop_table(big)
    widths = seen.groupBy("theorem", "level").agg(F.count("*").alias("w")).groupBy("theorem").agg(F.sort_array(F.collect_list(F.struct("level", "w")))["w"].alias("widths"))
    return done.union(widths)


def tree_metrics(edges: DataFrame, small: int = SMALL_PROOF) -> DataFrame:
    """Per proof, of ``edges(theorem, src, dst)``: nodes; depth, upper median depth, greatest width and width at half depth of the breadth-first levels from the first root; mean out-degree, share
    of leaves, nodes on the longest of these levels' paths over all nodes (spine), and variance of the out-degrees (imbalance). A proof without edges has no row."""
    out = edges.groupBy("theorem", F.col("src").alias("node")).agg(F.count("*").alias("o")).union(edges.select("theorem", "dst", F.lit(0)).distinct())
    per = out.groupBy("theorem", "node").agg(F.sum("o").alias("o"))
    n, o = F.count("*"), F.sum("o")
    sums = per.groupBy("theorem").agg(n.alias("n_nodes"), rounded(o / n).alias("mean_out"), rounded(F.count_if(F.col("o") == 0) / n).alias("leaf_share"), rounded((F.sum(F.col("o") * F.col("o")) * n - o * o) / (n * n)).alias("imbalance"))
    w = level_widths(edges, small).withColumn("depth", F.size("widths") - 1)
    zero = F.lit(0).cast("long")
    half = F.floor(F.aggregate("widths", zero, lambda a, x: a + x) / 2)
    # The upper median is the level where the running total of the widths first exceeds half of all nodes.
    start = F.struct(zero.alias("total"), zero.alias("below"))
    median = F.aggregate("widths", start, lambda a, x: F.struct((a["total"] + x).alias("total"), (a["below"] + F.when(a["total"] + x <= half, 1).otherwise(0)).alias("below")))["below"]
    shape = w.select("theorem", "depth", median.cast("int").alias("median_depth"), F.array_max("widths").alias("max_width"), F.element_at("widths", (F.floor(F.col("depth") / 2) + 1).cast("int")).alias("width_at_half_depth"))
    return sums.join(shape, "theorem").select("theorem", "n_nodes", "depth", "median_depth", "max_width", "width_at_half_depth", "mean_out", "leaf_share", rounded((F.col("depth") + 1) / F.col("n_nodes")).alias("spine_score"), "imbalance")


def head_signatures(steps: DataFrame, size: int = 6) -> DataFrame:
    """Groups of two or more theorems with the same first heads."""
    seqs = steps.filter(F.col("idx") < size).groupBy("theorem").agg(F.array_join(F.sort_array(F.collect_list(F.struct("idx", "head")))["head"], ",").alias("signature"))
    return seqs.groupBy("signature").agg(F.count("*").alias("n"), F.min("theorem").alias("first")).filter("n >= 2")


def flow_summary(flow: DataFrame) -> DataFrame:
    return flow.groupBy("kind", "src_head", "dst_head").agg(F.count("*").alias("n"), F.countDistinct("theorem").alias("theorems"))


def tactic_blocks(lines: DataFrame) -> DataFrame:
    """``lines(proof, line_no, line)`` -> blocks: a line goes on with the block before if it is indented deeper than the line before, or if that ends in from, :=, => or do. Gaps and islands by a running sum of starts."""
    order = Window.partitionBy("proof").orderBy("line_no")
    rows = lines.filter(F.trim("line") != "").withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    goes_on = (F.col("indent") > F.lag("indent").over(order)) | F.lag(F.rtrim("line")).over(order).rlike(r"(from|:=|=>|do)$")
    marked = rows.withColumn("start", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("block", F.sum("start").over(order))
    return numbered.groupBy("proof", "block").agg(F.count("*").alias("n_lines"), F.array_join(F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("t"))))["t"], " ").alias("text"))


def stratified_sample(sizes: DataFrame, bounds: list[int], takes: list[int], seed: int = 7) -> DataFrame:
    """``sizes(theorem, n)``: seeded samples of the strata up to each bound and beyond the last; the order is by a hash."""
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col("n") <= bounds[i], i).otherwise(bucket)
    most = F.element_at(F.array(*map(F.lit, takes)), F.col("bucket") + 1)
    ranked = sizes.withColumn("bucket", bucket).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.concat(F.col("theorem"), F.lit(f"#{seed}"))))))
    return ranked.filter(F.col("r") <= most).select("bucket", "theorem", "n")
