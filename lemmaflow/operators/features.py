"""Feature tables for nodes at a depth frontier, all depths in one pass.

For a node v of depth d the seen graph holds the nodes of smaller depth (strict), so all its parents are seen, and so are all parents of seen nodes; the children of a
parent p count only up to depth d - 1. Depth is a column, so "seen from d" is a range condition on a join that is there anyway, or a running sum over depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .components import connected_components
from .graph import degrees, nodes
from .reach import ancestors, bit_planes, descendants, places, sizes
from .reports import mixture
from .stats import rounded


def _parents(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """``(v, d, p, dp)``: each node of a depth with its parents and their depths."""
    return edges.join(depth.select(F.col("id").alias("dst"), F.col("depth").alias("d")), "dst").join(depth.select(F.col("id").alias("src"), F.col("depth").alias("dp")), "src").select(F.col("dst").alias("v"), "d", F.col("src").alias("p"), "dp")


def seen_out_degree(edges: DataFrame, depth: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``(p, d, out_seen, beta)``: children of p of a depth below d, and those one deeper than p, for each depth d of a child of p.

    A running sum over the few depths at which p has children; no pair of children is formed."""
    per = (_parents(edges, depth) if rows is None else rows).groupBy("p", "dp", "d").agg(F.count("*").alias("n"))
    before = Window.partitionBy("p").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    out = F.coalesce(F.sum("n").over(before), F.lit(0))
    beta = F.coalesce(F.sum(F.when(F.col("d") == F.col("dp") + 1, F.col("n")).otherwise(0)).over(before), F.lit(0))
    return per.select("p", "d", out.alias("out_seen"), beta.alias("beta"))


def parent_degrees(edges: DataFrame, depth: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Parent in-degrees, seen out-degrees, depths and betas per node. ``rows``, here and below, are the parents (``_parents``), where they are stored."""
    rows = _parents(edges, depth) if rows is None else rows
    ind = degrees(edges).select(F.col("id").alias("p"), "in_degree")
    rows = rows.join(seen_out_degree(edges, depth, rows), ["p", "d"]).join(ind, "p")
    agg = [rounded(F.avg(c)).alias(f"parent_{n}_mean") for c, n in (("in_degree", "indeg"), ("out_seen", "outdeg"), ("dp", "depth"), ("beta", "beta"))]
    agg += [F.max(c).alias(f"parent_{n}_max") for c, n in (("in_degree", "indeg"), ("out_seen", "outdeg"), ("dp", "depth"), ("beta", "beta"))]
    return rows.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("parent_count"), F.sum("out_seen").alias("parent_outdeg_sum"), *agg)


def survival_rates(edges: DataFrame, depth: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``(d, t, rate)``: of the nodes of depth t, the share with a child of a depth below d; for each d above t."""
    first = (_parents(edges, depth) if rows is None else rows).groupBy(F.col("p").alias("id")).agg(F.min("d").alias("first_child"))
    sizes = depth.groupBy(F.col("depth").alias("t")).agg(F.count("*").alias("n"))
    alive = depth.join(first, "id").groupBy(F.col("depth").alias("t"), "first_child").agg(F.count("*").alias("a"))
    frontier = depth.select(F.col("depth").alias("d")).distinct()
    # Depths are few: both sides have at most a row for each pair of them.
    pairs = sizes.join(F.broadcast(frontier), F.col("d") > F.col("t")).join(alive, "t", "left")
    return pairs.groupBy("d", "t", "n").agg(F.coalesce(F.sum(F.when(F.col("first_child") < F.col("d"), F.col("a"))), F.lit(0)).alias("a")).select("d", "t", (F.col("a") / F.col("n")).alias("rate"))


def survival_feature(edges: DataFrame, depth: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Mean over v's parents of the survival rate of their depth, as seen from v's depth."""
    rows = _parents(edges, depth) if rows is None else rows
    rates = survival_rates(edges, depth, rows).withColumnRenamed("t", "dp")
    rows = rows.join(F.broadcast(rates), ["d", "dp"])  # a row for each pair of depths
    return rows.groupBy(F.col("v").alias("id")).agg(rounded(F.avg("rate")).alias("parent_survival_mean"))


def upstream(edges: DataFrame) -> DataFrame:
    """Distinct grandparents, nodes within two hops up, and the density of edges among those."""
    one = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"))
    two = one.join(edges.select(F.col("dst").alias("u"), F.col("src").alias("g")), "u").select("v", F.col("g").alias("u")).distinct()
    grand = two.groupBy("v").agg(F.count("*").alias("grandparents"))
    both = one.union(two).distinct()
    n = both.groupBy("v").agg(F.count("*").alias("n"))
    inner = both.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("w")), "u").join(both.select("v", F.col("u").alias("w")), ["v", "w"]).groupBy("v").agg(F.count("*").alias("m"))
    out = nodes(edges).withColumnRenamed("id", "v").join(grand, "v", "left").join(n, "v", "left").join(inner, "v", "left").na.fill(0)
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return out.select(F.col("v").alias("id"), "grandparents", F.col("n").alias("upstream_nodes"), rounded(density).alias("upstream_density"))


def peek(edges: DataFrame) -> DataFrame:
    """Children and distinct grandchildren in the whole graph."""
    two = edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("g")), "dst").select("src", "g").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k2"))
    return degrees(edges).select("id", F.col("out_degree").alias("k1")).join(two, "id", "left").na.fill(0)


def _parent_sets(edges: DataFrame, depth: DataFrame) -> DataFrame:
    sets = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("ps"))
    return depth.join(sets, "id", "left").select("id", "depth", F.coalesce("ps", F.array().cast("array<bigint>")).alias("ps"))


def parentset_rarity(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Nodes of smaller depth with the same parent set (the empty set too): a running sum over depth within each set."""
    per = _parent_sets(edges, depth).withColumn("key", F.sha2(F.array_join("ps", ","), 256))
    counts = per.groupBy("key", "depth").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("key", "depth", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rarity"))
    return per.join(earlier, ["key", "depth"]).select("id", "rarity")


def parentset_similarity(edges: DataFrame, depth: DataFrame, k: int = 25, rows: DataFrame | None = None) -> DataFrame:
    """Mean and maximum of the k greatest Jaccard similarities of v's parents with those of shallower nodes that share one."""
    rows = _parents(edges, depth) if rows is None else rows
    shared = rows.select("v", "d", "p").join(rows.select(F.col("v").alias("w"), F.col("d").alias("dw"), "p"), "p").filter("dw < d").groupBy("v", "w").agg(F.count("*").alias("s"))
    ind = degrees(edges).select("id", "in_degree")
    jac = shared.join(ind.select(F.col("id").alias("v"), F.col("in_degree").alias("nv")), "v").join(ind.select(F.col("id").alias("w"), F.col("in_degree").alias("nw")), "w")
    jac = jac.select("v", "w", (F.col("s") / (F.col("nv") + F.col("nw") - F.col("s"))).alias("j"))
    best = jac.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("j"), "w"))).filter(F.col("r") <= k)
    out = best.groupBy(F.col("v").alias("id")).agg(rounded(F.avg("j")).alias("similarity_mean"), rounded(F.max("j")).alias("similarity_max"))
    return depth.select("id").join(out, "id", "left").na.fill(0.0)


def cooccurrence(edges: DataFrame, depth: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per node, over pairs of its parents: how many shallower nodes have both as parents."""
    rows = _parents(edges, depth) if rows is None else rows
    pairs = rows.select("v", "d", F.col("p").alias("a")).join(rows.select("v", F.col("p").alias("b")), "v").filter("a < b")
    per = pairs.groupBy("a", "b", "d").agg(F.count("*").alias("n"))
    before = Window.partitionBy("a", "b").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    seen = per.select("a", "b", "d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"))
    out = pairs.join(seen, ["a", "b", "d"]).groupBy(F.col("v").alias("id")).agg(rounded(F.avg("c")).alias("cooccurrence_mean"), F.max("c").alias("cooccurrence_max"))
    return depth.select("id").join(out, "id", "left").na.fill(0)


def parent_reach(edges: DataFrame, depth: DataFrame, below: DataFrame) -> DataFrame:
    """``below``, the bits of all descendants (``reach.descendants``) -> ``(id, mean_parent_reach, max_parent_reach)``: descendants of the parents among the nodes of a lower depth than the node's own. Counted by depth, then summed up."""
    by_depth = below.groupBy(F.col("id").alias("src"), "at").agg(F.sum(F.bit_count("bits")).alias("n"))
    pairs = edges.join(depth.select(F.col("id").alias("dst"), "depth"), "dst")
    own = pairs.join(by_depth, "src", "left").groupBy("dst", "src").agg(F.coalesce(F.sum(F.when(F.col("at") < F.col("depth"), F.col("n"))), F.lit(0)).alias("n"))
    return own.groupBy(F.col("dst").alias("id")).agg(F.round(F.avg("n"), 6).alias("mean_parent_reach"), F.max("n").alias("max_parent_reach"))


def _shared_ancestors(pairs: DataFrame, above: DataFrame, place: DataFrame) -> DataFrame:
    """``pairs(p, q)`` -> ``(p, q, both, deepest)`` of those with common ancestors (a node counts as its own in ``deepest`` alone). Words of two sets meet, not their members."""
    # A node's own bit is in no word of its ancestors, which are of lower depths.
    words = above.select("id", "at", "word", "bits", F.lit(0).cast("long").alias("own")).union(place.select("id", "at", "word", F.lit(0).cast("long"), "bit"))
    side = lambda x: words.select(F.col("id").alias(x), "at", "word", F.col("bits").alias(f"{x}_bits"), F.col("own").alias(f"{x}_own"))
    met = pairs.join(side("p"), "p").join(side("q"), ["q", "at", "word"])
    both = F.bit_count(F.col("p_bits").bitwiseAND(F.col("q_bits")))
    near = F.col("p_bits").bitwiseOR(F.col("p_own")).bitwiseAND(F.col("q_bits").bitwiseOR(F.col("q_own"))) != 0
    return met.groupBy("p", "q").agg(F.sum(both).alias("both"), F.max(F.when(near, F.col("at"))).alias("deepest"))


def parent_pairs(edges: DataFrame, above: DataFrame, place: DataFrame) -> DataFrame:
    """``(id, parent_diversity, mean_lca_depth, max_lca_depth)``: 1 - mean Jaccard of the ancestors of two parents (1 with fewer than two), and the depth of the deepest
    ancestor two parents share (themselves included; 0 without one). ``above`` are the bits of all ancestors; a pair of parents is compared once, however many nodes have both."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    size = lambda x: sizes(above, f"n{x}").withColumnRenamed("id", x)
    parents = edges.select(F.col("dst").alias("id"), F.col("src").alias("p"))
    two = materialize(parents.join(parents.withColumnRenamed("p", "q"), "id").filter("p < q"), "parent-pairs")
    met = _shared_ancestors(two.select("p", "q").distinct(), above, place)
    pairs = two.join(met, ["p", "q"]).join(size("p"), "p", "left").join(size("q"), "q", "left").na.fill(0, ["np", "nq"])
    union = F.col("np") + F.col("nq") - F.col("both")
    sums = pairs.groupBy("id").agg(F.sum(F.when(union > 0, F.col("both") / union).otherwise(0.0)).alias("j"), F.sum("deepest").alias("d"), F.max("deepest").alias("m"))
    out = n.join(sums, "id", "left").na.fill(0, ["j", "d", "m"]).withColumn("pairs", F.greatest(F.col("k") * (F.col("k") - 1) / 2, F.lit(1)))
    return out.select("id", F.round(1 - F.col("j") / F.col("pairs"), 6).alias("parent_diversity"), F.round(F.col("d") / F.col("pairs"), 6).alias("mean_lca_depth"), F.col("m").alias("max_lca_depth"))


def masked(edges: DataFrame, depth: DataFrame, below: DataFrame, place: DataFrame) -> DataFrame:
    """Per node v, of the graph without v's descendants: how many go, how many edges stay, and what is left of its parents' children (sum, maximum), of those one deeper than
    the parent (maximum), and of their descendants (mean, maximum); v itself never counts. ``below`` are the bits of all descendants.

    A parent reaches all that v reaches, so descendants are a difference of counts; and a child one deeper than the parent is never below v, so that number is one too."""
    gone = materialize(sizes(below, "n_masked"), "masked")
    # An edge goes if either end does; an edge out of a descendant ends in one, so those into descendants are all: the sum of their in-degrees, by bit planes.
    planes = bit_planes(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), place)
    lost = below.join(planes, ["at", "word"]).groupBy("id").agg(F.sum(F.expr("shiftleft(cast(bit_count(bits & mask) as bigint), plane)")).alias("lost"))
    total = edges.agg(F.count("*").alias("total"))  # one row
    kids = edges.join(depth.select(F.col("id").alias("src"), F.col("depth").alias("dp")), "src").join(depth.select(F.col("id").alias("dst"), F.col("depth").alias("d")), "dst")
    own = kids.groupBy("src").agg(F.count("*").alias("k"), F.count_if(F.col("d") == F.col("dp") + 1).alias("next"))
    # Children of a parent of v that lie below v: words of the children's bits meet those of v's descendants.
    children = edges.join(place.withColumnRenamed("id", "dst"), "dst").groupBy("src", "at", "word").agg(F.bit_or("bit").alias("mask"))
    met = edges.select("src", F.col("dst").alias("id")).join(children, "src").join(below, ["id", "at", "word"])
    hidden = met.groupBy("id", "src").agg(F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("bits")))).alias("hidden"))
    reached = gone.withColumnRenamed("n_masked", "reached").withColumnRenamed("id", "src")
    rows = kids.withColumnRenamed("dst", "id").join(own, "src").join(reached, "src").join(gone, "id", "left").join(hidden, ["id", "src"], "left").na.fill(0, ["n_masked", "hidden"])
    rows = rows.select("id", (F.col("k") - 1 - F.col("hidden")).alias("o"), (F.col("next") - (F.col("d") == F.col("dp") + 1).cast("int")).alias("b"), (F.col("reached") - F.col("n_masked") - 1).alias("n"))
    seen = rows.groupBy("id").agg(F.sum("o").alias("masked_outdeg_sum"), F.max("o").alias("masked_outdeg_max"), F.max("b").alias("masked_beta_max"), rounded(F.avg("n")).alias("masked_reach_mean"), F.max("n").alias("masked_reach_max"))
    out = nodes(edges).join(gone, "id", "left").join(lost, "id", "left").join(seen, "id", "left").na.fill(0).crossJoin(F.broadcast(total))
    return out.select("id", "n_masked", (F.col("total") - F.col("lost")).alias("n_seen_edges"), *seen.columns[1:])


def parent_components(edges: DataFrame, depth: DataFrame, d: int) -> DataFrame:
    """``(id, n_component, component_entropy)`` of the nodes of depth ``d`` with parents: the weak components of the graph of smaller depths that hold the parents, and the entropy of their shares in nats."""
    at = lambda c: depth.select(F.col("id").alias(c), F.col("depth").alias(f"{c}_depth"))
    both = materialize(edges.join(at("src"), "src").join(at("dst"), "dst"), "by-depth")
    parts = connected_components(both.filter(F.col("dst_depth") < d).select("src", "dst")).withColumnRenamed("id", "src")
    parents = both.filter(F.col("dst_depth") == d).join(parts, "src", "left").select(F.col("dst").alias("id"), F.coalesce("component", "src").alias("component"))
    return mixture(parents, "component")


def dataset(edges: DataFrame, depth: DataFrame, targets: DataFrame, modules: DataFrame, height: DataFrame | None = None) -> DataFrame:
    """A row per node: depth, all feature blocks seen from its own depth, and the targets. ``modules(id, module)`` is the module of each node, ``height(id, depth)`` the Kahn rounds of the
    reversed edges, where they are known. What nodes reach is kept as bits; parents with their depths are stored once for the blocks that start from them."""
    place = materialize(places(depth), "places")
    rows = materialize(_parents(edges, depth), "parents")
    ind = degrees(edges).select("id", F.col("in_degree").alias("indeg_seen"))
    out = depth.select("id", "depth").join(ind, "id", "left")
    mixed = mixture(edges.join(modules.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "module"), "module")
    blocks = [parent_degrees(edges, depth, rows), survival_feature(edges, depth, rows), upstream(edges), parentset_rarity(edges, depth), parentset_similarity(edges, depth, rows=rows), cooccurrence(edges, depth, rows)]
    blocks += [parent_reach(edges, depth, descendants(edges, place, height)), parent_pairs(edges, ancestors(edges, depth, place), place), mixed, peek(edges)]
    for block in blocks:
        out = out.join(materialize(block, "features"), "id", "left")  # a plan for each block instead of one of them all
    return out.na.fill(1.0, ["parent_diversity"]).na.fill(0).join(targets.select("id", "y1", "y2"), "id")
