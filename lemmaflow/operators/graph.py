"""Measures of a citation graph ``edges(src, dst)``, distinct and without loops (src is cited by dst).

Hubs are heavy: triangles are listed from their node of the smallest degree, four-cycles are counted at their node of the greatest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import rounded


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def citation_graph(premises: DataFrame, drop: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``premises(theorem, premise)`` names -> nodes ``(name, node_type)`` and edges ``(premise, theorem)``; a name with any theorem row is a theorem."""
    named = premises.select(F.col("premise").cast("string").alias("premise"), F.col("theorem").cast("string").alias("theorem")).filter("premise <> theorem")
    if drop:
        named = named.filter(~F.lower(F.element_at(F.split("premise", "[.]"), -1)).isin(drop))
    e = named.distinct()
    kinds = e.select(F.col("theorem").alias("name"), F.lit("theorem").alias("node_type")).union(e.select("premise", F.lit("premise")))
    return kinds.groupBy("name").agg(F.max("node_type").alias("node_type")), e


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree)`` in one aggregate over both ends."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def roots_leaves(edges: DataFrame) -> DataFrame:
    kind = F.when(F.col("in_degree") == 0, "root").when(F.col("out_degree") == 0, "leaf").otherwise("inner")
    return degrees(edges).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def top_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    d = degrees(edges)
    parts = [d.orderBy(F.desc(c), "id").limit(k).select(F.lit(n).alias("measure"), "id", F.col(c).alias("degree")) for n, c in (("in", "in_degree"), ("out", "out_degree"))]
    total = d.withColumn("t", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("t"), "id").limit(k).select(F.lit("total"), "id", "t")
    return parts[0].union(parts[1]).union(total)


def degree_stats(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    one = lambda c: d.agg(F.lit(c).alias("measure"), F.min(c).alias("least"), F.max(c).alias("most"), rounded(F.avg(c)).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), rounded(F.sum(c) / (F.count("*") * (F.count("*") - 1))).alias("density"))
    return one("in_degree").union(one("out_degree"))


def transitivity(edges: DataFrame) -> DataFrame:
    """Share of the nodes with grandparents that also cite one of them. Semi joins say who has grandparents; who cites one is the last node of a feed-forward loop."""
    below = edges.select(F.col("dst").alias("src")).distinct()
    a = edges.join(below, "src", "left_semi").select(F.countDistinct("dst").alias("with_grandparents"))
    also = feedforward_loops(edges).agg(F.countDistinct("w").alias("transitive"))
    return a.join(also).select("with_grandparents", "transitive", rounded(F.col("transitive") / F.greatest("with_grandparents", F.lit(1))).alias("transitivity"))  # a row each


def _from_smaller(edges: DataFrame) -> DataFrame:
    """``(lo, hi, hd, kind)``: each edge from its end of the smaller (degree, id); hd is the degree of ``hi``, kind 1 if the edge leaves ``lo``, 2 if it enters it."""
    d = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("deg"))
    ends = edges.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    down = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    pick = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    return ends.select(pick("src", "dst").alias("lo"), pick("dst", "src").alias("hi"), pick("dd", "ds").alias("hd"), F.when(down, 1).otherwise(2).alias("kind"))


def _triangles(pairs: DataFrame) -> DataFrame:
    """``(x, y, z, xy, xz, yz)``: triangles of ``pairs(lo, hi, hd, kind)``, x < y < z by degree, with the kinds of their sides.

    Wedges are listed at the node of the smallest degree alone, which has at most sqrt(2m) neighbours above it: m ** 1.5 wedges whatever the hubs."""
    one, two = pairs.toDF("x", "y", "yd", "xy"), pairs.toDF("x", "z", "zd", "xz")
    wedges = one.join(two, "x").filter((F.col("yd") < F.col("zd")) | ((F.col("yd") == F.col("zd")) & (F.col("y") < F.col("z"))))
    return wedges.join(pairs.select(F.col("lo").alias("y"), F.col("hi").alias("z"), F.col("kind").alias("yz")), ["y", "z"]).select("x", "y", "z", "xy", "xz", "yz")


def feedforward_loops(edges: DataFrame) -> DataFrame:
    """``(u, v, w)``: u -> v -> w and u -> w. A triangle is one unless it is a cycle; u has two edges out, v one, w none."""
    xy, xz, yz = (F.col(c) == 1 for c in ("xy", "xz", "yz"))
    u = F.when(xy & xz, F.col("x")).when(~xy & yz, F.col("y")).when(~xz & ~yz, F.col("z"))
    w = F.when(~xy & ~xz, F.col("x")).when(xy & ~yz, F.col("y")).when(xz & yz, F.col("z"))
    v = F.when(xy != xz, F.col("x")).when(xy == yz, F.col("y")).otherwise(F.col("z"))
    return _triangles(_from_smaller(edges)).select(u.alias("u"), v.alias("v"), w.alias("w")).filter("u is not null")


def ffl_count(edges: DataFrame) -> DataFrame:
    return feedforward_loops(edges).agg(F.count("*").alias("feedforward_loops"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """``_from_smaller`` with one row for each pair of neighbours: kind 3 if edges go both ways."""
    return _from_smaller(edges).groupBy("lo", "hi", "hd").agg(F.sum("kind").alias("kind"))


def _has(kind: str, bit: int):
    """Whether an edge leaves (1) or enters (2) the first node of a pair of this kind."""
    return F.col(kind).bitwiseAND(bit) != 0


def _wedges(pairs: DataFrame) -> DataFrame:
    """``(h, o, m, down, up, parent, child)``: paths h - m - o in which h comes last of the three in the order by degree, with flags for h -> m -> o, o -> m -> h, m a parent of both, m a child of both.

    For each pair of neighbours, the lower one's other neighbours below h: the sum of the smaller degrees over all edges, m ** 1.5 at most, whatever the hubs. A hub is no middle but for a larger one."""
    first = pairs.toDF("m", "h", "hd", "a")
    above = pairs.toDF("m", "o", "od", "b")
    turned = F.when(F.col("kind") == 3, 3).otherwise(3 - F.col("kind"))
    below = pairs.select(F.col("hi").alias("m"), F.col("lo").alias("o"), turned.alias("b"))
    lower = (F.col("od") < F.col("hd")) | ((F.col("od") == F.col("hd")) & (F.col("o") < F.col("h")))
    both = first.join(above, "m").filter(lower).select("h", "o", "m", "a", "b").union(first.join(below, "m").select("h", "o", "m", "a", "b"))
    out, into = (lambda k: _has(k, 1)), (lambda k: _has(k, 2))  # from m, into m
    flags = {"down": into("a") & out("b"), "up": into("b") & out("a"), "parent": out("a") & out("b"), "child": into("a") & into("b")}
    return both.select("h", "o", "m", *[c.cast("long").alias(n) for n, c in flags.items()])


def _wedge_ends(wedges: DataFrame) -> DataFrame:
    """Per pair of ends ``(h, o)`` the numbers of middles of each kind, and ``turned``: of those that are parent and child."""
    sums = [F.sum(c).alias(c) for c in ("down", "up", "parent", "child")]
    return wedges.groupBy("h", "o").agg(*sums, F.sum(F.col("parent") * F.col("child")).alias("turned"))


def _adjacent_diamonds(pairs: DataFrame) -> DataFrame:
    """``(v, w, c)``: shared parents times shared children of adjacent v and w, from the triangles."""
    t = _triangles(pairs)
    side = lambda v, w, p, c: F.struct(F.col(v).alias("v"), F.col(w).alias("w"), p.cast("long").alias("p"), c.cast("long").alias("c"))
    leaves, enters = (lambda k: _has(k, 1)), (lambda k: _has(k, 2))
    sides = [side("x", "y", enters("xz") & enters("yz"), leaves("xz") & leaves("yz")), side("x", "z", enters("xy") & leaves("yz"), leaves("xy") & enters("yz")), side("y", "z", leaves("xy") & leaves("xz"), enters("xy") & enters("xz"))]
    return t.select(F.explode(F.array(*sides)).alias("s")).select("s.*").groupBy("v", "w").agg((F.sum("p") * F.sum("c")).alias("c")).filter("c > 0")


def _turned_pairs(pairs: DataFrame) -> DataFrame:
    """``(u, v, k)``: edges both ways from u to v, and from u to k others. Each such pair of neighbours of u has u as parent and as child."""
    both = pairs.filter("kind = 3").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    both = both.union(both.select("v", "u"))
    return both.join(both.groupBy("u").agg((F.count("*") - 1).alias("k")), "u")


def diamond_count(edges: DataFrame) -> DataFrame:
    """u -> v, u -> w, v -> x, w -> x with v and w not adjacent.

    Four-cycles are counted at their last node in the order by degree, as the end of a wedge, so a hub's neighbours are never paired: the opposite node is its fellow (v and w, with parents and
    children as middles) or its other end (u and x, with pairs of middles that go the same way). Those with v and w adjacent are counted from the triangles and taken off. On a graph with edges
    both ways, u and x may be the same node."""
    pairs = _both_ways(edges)
    two = lambda c: F.expr(f"({c} * ({c} - 1)) div 2")
    ends = _wedge_ends(_wedges(pairs)).select((two("down") + two("up") + F.col("parent") * F.col("child") - F.col("turned")).alias("n"))
    same = _turned_pairs(pairs).agg(F.expr("coalesce(sum(k), 0) div 2").alias("n"))
    near = _adjacent_diamonds(pairs).select((-F.col("c")).alias("n"))
    return ends.union(same).union(near).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("diamonds"))


def ego_feedforward(edges: DataFrame) -> DataFrame:
    """FF(x): over the children c of x, the parents that c and x share."""
    loops = feedforward_loops(edges).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("ff"))
    return nodes(edges).join(loops, "id", "left").select("id", F.coalesce("ff", F.lit(0)).alias("ff"))


def ego_diamonds(edges: DataFrame) -> DataFrame:
    """Per node x: over other nodes w not adjacent to x, shared parents times shared children. Counted as ``diamond_count`` does: the ends of wedges for themselves, then their middles."""
    pairs = _both_ways(edges)
    wedges = _wedges(pairs)
    ends = _wedge_ends(wedges)
    fellows = ends.select("h", "o", (F.col("parent") * F.col("child") - F.col("turned")).alias("n")).filter("n > 0")
    ways = ends.filter("down > 1 or up > 1").select("h", "o", F.col("down").alias("all_down"), F.col("up").alias("all_up"))
    middles = wedges.filter("down + up > 0").join(ways, ["h", "o"]).groupBy(F.col("m").alias("id")).agg(F.sum(F.col("down") * (F.col("all_down") - 1) + F.col("up") * (F.col("all_up") - 1)).alias("n"))
    near = _adjacent_diamonds(pairs).select("v", "w", (-F.col("c")).alias("n"))
    parts = [fellows.select(F.col("h").alias("id"), "n"), fellows.select("o", "n"), middles, near.select("v", "n"), near.select("w", "n"), _turned_pairs(pairs).select("v", "k")]
    sums = reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("n").alias("diamonds"))
    return nodes(edges).join(sums, "id", "left").select("id", F.coalesce("diamonds", F.lit(0)).alias("diamonds"))


def ego_topology(edges: DataFrame) -> DataFrame:
    """Bypass density FF / (|P||C|), disruption (d - c) / |C| (d: children that share no parent with x, c: others), U_eff = sum over children of 1 - r_c / |P|, and -ln U_eff."""
    d = degrees(edges)
    shared = feedforward_loops(edges).groupBy(F.col("v").alias("x"), F.col("w").alias("c")).agg(F.count("*").alias("r"))
    per = edges.select(F.col("src").alias("x"), F.col("dst").alias("c")).join(shared, ["x", "c"], "left").select("x", F.coalesce("r", F.lit(0)).alias("r"))
    sums = per.groupBy(F.col("x").alias("id")).agg(F.sum("r").alias("ff"), F.sum(F.when(F.col("r") == 0, 1).otherwise(-1)).alias("dc"))
    p, c = F.col("in_degree"), F.col("out_degree")
    out = d.join(sums, "id", "left").withColumn("ff", F.coalesce("ff", F.lit(0)))
    out = out.withColumn("u_eff", F.when(c == 0, 0.0).when(p == 0, c.cast("double")).otherwise(c - F.col("ff") / p))
    return out.select("id", rounded(F.when((p > 0) & (c > 0), F.col("ff") / (p * c)).otherwise(0.0)).alias("bypass_density"), rounded(F.when(c > 0, F.col("dc") / c).otherwise(0.0)).alias("disruption"), rounded("u_eff").alias("u_eff"), F.when(F.col("u_eff") > 1e-12, rounded(-F.log("u_eff"))).alias("code_length"))


def motif3_census(edges: DataFrame) -> DataFrame:
    """Connected triples by number of edges and sorted (in, out) degrees within the triple: ``(signature, n)``.

    Closed triples are listed as triangles. Open ones are counted: the pairs of neighbours of each node by kind (1 out, 2 in, 3 both), less those that a triangle closes."""
    pairs = _both_ways(edges)
    turned = lambda c: F.when(F.col(c) == 3, 3).otherwise(3 - F.col(c))
    leaves = lambda k: (k % 2).cast("int")
    enters = lambda k: (k >= 2).cast("int")
    shut = _triangles(pairs).groupBy("xy", "xz", "yz").agg(F.count("*").alias("n"))  # at most 27 rows
    sides = [(F.col("xy"), F.col("xz")), (turned("xy"), F.col("yz")), (turned("xz"), turned("yz"))]
    closed = shut.select(F.array_sort(F.array(*[(enters(a) + enters(b)) * 10 + leaves(a) + leaves(b) for a, b in sides])).alias("s"), "n")
    lost = shut.select("n", F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in sides])).alias("p")).select("p.*", (-F.col("n")).alias("n"))
    around = pairs.select(F.col("lo").alias("m"), "kind").union(pairs.select("hi", turned("kind"))).groupBy("m").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in (1, 2, 3)])
    c = lambda k: F.col(f"n{k}")
    ways = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (c(a) * (c(a) - 1) / 2 if a == b else c(a) * c(b)).cast("long").alias("n")) for a in (1, 2, 3) for b in range(a, 4)]
    open_ = around.select(F.explode(F.array(*ways)).alias("p")).select("p.*").union(lost).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")
    a, b = F.col("a"), F.col("b")
    bent = open_.select(F.array_sort(F.array((enters(a) + enters(b)) * 10 + leaves(a) + leaves(b), leaves(a) * 10 + enters(a), leaves(b) * 10 + enters(b))).alias("s"), "n")
    return closed.union(bent).groupBy(F.array_join(F.col("s").cast("array<string>"), "-").alias("signature")).agg(F.sum("n").alias("n"))


def ego_network(edges: DataFrame, centre, distance: int = 2) -> DataFrame:
    """``(id, role, hop)`` of the nodes up to ``distance`` hops up (parents) and down (children); parents come first, then nearer ones."""
    start = edges.sparkSession.createDataFrame([(centre,)], "id long")
    found = start.select("id", F.lit(0).alias("hop"), F.lit("centre").alias("role"))
    for role, e in (("parents", reverse(edges)), ("children", edges)):
        front = start
        for hop in range(1, distance + 1):
            front = e.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
            found = found.union(front.select("id", F.lit(hop), F.lit(role)))
    order = F.struct(F.when(F.col("role") == "centre", 0).when(F.col("role") == "parents", 1).otherwise(2).alias("o"), "hop", "role")
    return found.groupBy("id").agg(F.min(order).alias("x")).select("id", "x.role", "x.hop")


def ego_summary(edges: DataFrame, centre, distance: int = 2) -> DataFrame:
    """Nodes and induced edges of an ego network, and its bypasses (parent -> child edges)."""
    ego = ego_network(edges, centre, distance)
    a, b = ego.select(F.col("id").alias("src"), F.col("role").alias("ra")), ego.select(F.col("id").alias("dst"), F.col("role").alias("rb"))
    inner = edges.join(a, "src").join(b, "dst").agg(F.count("*").alias("n_edges"), F.count_if((F.col("ra") == "parents") & (F.col("rb") == "children")).alias("bypasses"))
    return ego.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("role") == "parents").alias("n_parents"), F.count_if(F.col("role") == "children").alias("n_children")).join(inner)  # a row each


def extreme_nodes(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of the highest and the lowest degree of each measure (in and out: zero alone is low). Each task keeps its own best k, no measure is sorted whole."""
    d = degrees(edges).withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    parts = []
    for measure in ("in", "out", "total"):
        rows = d.select(F.lit(measure).alias("measure"), "id", F.col(f"{measure}_degree").alias("degree"))
        low = rows if measure == "total" else rows.filter("degree = 0")
        parts += [x.limit(k).select("measure", F.lit(side).alias("side"), "id", "degree") for side, x in (("high", rows.orderBy(F.desc("degree"), "id")), ("low", low.orderBy("degree", "id")))]
    return reduce(DataFrame.union, parts)


def adjacent_possible(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes not in ``known(id)`` whose parents are all known (roots included)."""
    missing = edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    return nodes(edges).join(known, "id", "left_anti").join(missing, "id", "left_anti")


def expansion_factor(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Per candidate of the adjacent possible: nodes that its adding alone unlocks, and that number over its prerequisites (at least 1)."""
    can = adjacent_possible(edges, known)
    lacking = edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti").join(known.withColumnRenamed("id", "dst"), "dst", "left_anti")
    one = lacking.groupBy("dst").agg(F.count("*").alias("m"), F.min("src").alias("only")).filter("m = 1").groupBy(F.col("only").alias("id")).agg(F.count("*").alias("unlocked"))
    need = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("prerequisites"))
    out = can.join(one, "id", "left").join(need, "id", "left").na.fill(0, ["unlocked", "prerequisites"])
    return out.select("id", "unlocked", "prerequisites", rounded(F.col("unlocked") / F.greatest("prerequisites", F.lit(1))).alias("efficiency"))


def local_hub_score(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Per known node: its children among the known and adjacent ones."""
    near = known.union(adjacent_possible(edges, known)).distinct()
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("score"))
