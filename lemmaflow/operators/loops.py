"""Iterative graph work: a driver loop over DataFrames, each round a stored table in the shared folder, stopped by an empty frontier."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import drop_table, materialize, new_path
from . import masks
from .components import connected_components
from .graph import nodes, reverse
from .stats import rounded


def kahn_rounds(edges: DataFrame) -> DataFrame:
    """``(id, depth)``: the round in which a node has no unmet parent, which is its longest depth. Nodes on or below cycles are missing.

    Each round joins the stored edges with the last layer and rewrites the counts of the nodes that are still open. Edges are stored anew without those from nodes of earlier layers whenever
    half of them are, so a round reads at most twice the edges that are still open."""
    edges = materialize(edges.select("src", "dst"), "kahn-edges")
    need = materialize(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("missing")), "kahn-need")
    layer = materialize(edges.select(F.col("src").alias("id")).distinct().join(need, "id", "left_anti").select("id", F.lit(0).alias("depth")), "kahn-layer")
    found, open_edges = not layer.isEmpty(), need.agg(F.sum("missing")).first()[0] or 0
    layers, walked, stored = [], [], open_edges
    for depth in count(1):
        if not found:
            break
        layers.append(layer)
        walked.append(layer)
        if not open_edges:
            break
        met = edges.join(layer.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        left = materialize(need.join(met, "id", "left").select("id", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing")), "kahn-need")
        found, open_edges = left.agg(F.count_if(F.col("missing") == 0), F.coalesce(F.sum("missing"), F.lit(0))).first()
        if found and 0 < 2 * open_edges <= stored:
            gone = reduce(DataFrame.union, walked).select(F.col("id").alias("src"))
            rest = materialize(edges.join(gone, "src", "left_anti").select("src", "dst"), "kahn-edges")
            drop_table(edges)
            edges, walked, stored = rest, [], open_edges
        layer, need = left.filter("missing = 0").select("id", F.lit(depth).alias("depth")), left.filter("missing > 0")
    return reduce(DataFrame.union, layers) if layers else layer


def is_dag(edges: DataFrame) -> DataFrame:
    """One row: whether acyclic, and the number of nodes on or below cycles."""
    left = nodes(edges).join(kahn_rounds(edges), "id", "left_anti").agg(F.count("*").alias("blocked"))
    return left.select((F.col("blocked") == 0).alias("is_dag"), "blocked")


def bfs_levels(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(id, level)``: least number of edges from any source (default: the roots); unreached nodes have 0."""
    edges = materialize(edges, "bfs-edges")
    front = sources if sources is not None else nodes(edges).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    front = materialize(front.select("id", F.lit(0).alias("level")), "bfs-front")
    seen, fronts = front, [front]
    for level in count(1):
        reached = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = materialize(reached.join(seen, "id", "left_anti").select("id", F.lit(level).alias("level")), "bfs-front")
        if front.isEmpty():
            break
        fronts.append(front)
        seen = reduce(DataFrame.union, fronts)
    return nodes(edges).join(seen, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``(start, id)``: all nodes reachable from each start (default: every node), semi-naive."""
    edges = materialize(edges, "closure-edges")
    begin = starts if starts is not None else nodes(edges)
    new = materialize(edges.join(begin.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("id")), "closure")
    parts = [new]
    for _ in count():
        step = new.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("start", F.col("dst").alias("id")).distinct()
        new = materialize(step.join(reduce(DataFrame.union, parts), ["start", "id"], "left_anti"), "closure")
        if new.isEmpty():
            break
        parts.append(new)
    return reduce(DataFrame.union, parts)


def targets(edges: DataFrame, height: DataFrame | None = None) -> DataFrame:
    """``(id, y1, y2)``: number of downward paths (y1 = sum over children of 1 + y1(child)) and of children. Acyclic graphs only.

    Rounds go by height from the leaves. Each node's paths are pushed to its parents, into the partition of the parent's height; a round reads its own partition of the sums and of
    the edges, so all rounds together read each edge once. ``height(id, depth)`` are the Kahn rounds of the reversed edges, where they are known."""
    spark = edges.sparkSession
    if height is None:
        edges = materialize(edges, "targets-edges")
        height = materialize(kahn_rounds(reverse(edges)), "targets-height")
    deepest = height.agg(F.max("depth")).first()[0] or 0
    links = edges.join(height.select(F.col("id").alias("src"), F.col("depth").alias("to")), "src").join(height.select(F.col("id").alias("dst"), F.col("depth").alias("at")), "dst")
    by_height, sums = new_path(spark, "targets-links"), new_path(spark, "targets-sums")
    links.write.partitionBy("at").parquet(by_height)
    links = spark.read.schema(links.schema).parquet(by_height)
    pushed = T.StructType([T.StructField("src", edges.schema["src"].dataType), T.StructField("y", T.DoubleType()), T.StructField("to", T.IntegerType())])
    for h in range(max(1, deepest)):
        layer = links.filter(F.col("at") == h)
        if h:
            known = spark.read.schema(pushed).parquet(sums).filter(F.col("to") == h).groupBy(F.col("src").alias("dst")).agg(F.sum("y").alias("y"))
            layer = layer.join(known, "dst")
        else:
            layer = layer.withColumn("y", F.lit(0.0))
        layer.groupBy("src", "to").agg(F.sum(1 + F.col("y")).alias("y")).select("src", "y", "to").write.mode("append").partitionBy("to").parquet(sums)
    y1 = spark.read.schema(pushed).parquet(sums).groupBy(F.col("src").alias("id")).agg(F.sum("y").alias("y1"))
    y2 = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("y2"))
    out = height.select("id").join(y1, "id", "left").join(y2, "id", "left").select("id", F.coalesce("y1", F.lit(0.0)).alias("y1"), F.coalesce("y2", F.lit(0)).alias("y2"))
    return out.select("id", "y1", "y2", rounded(F.log1p("y1")).alias("z1"), rounded(F.log1p("y2")).alias("z2"))


def bfs_waves(edges: DataFrame) -> DataFrame:
    """Discovery from the roots, a wave at a time: ``(step, known, adjacent)`` with the last, empty one."""
    from pyspark.sql import Window

    sizes = materialize(kahn_rounds(edges).groupBy("depth").agg(F.count("*").alias("n")), "waves")
    order = Window.orderBy("depth")
    rows = sizes.select(F.col("depth").alias("step"), F.sum("n").over(order).alias("known"), F.coalesce(F.lead("n").over(order), F.lit(0)).alias("adjacent"))
    return rows.select(F.col("step").cast("long"), "known", "adjacent")


def accessibility(edges: DataFrame) -> DataFrame:
    """``(id, wave, dilution)``: the wave in which a node appears and the size of that wave."""
    waves = materialize(kahn_rounds(edges), "waves")
    sizes = waves.groupBy("depth").agg(F.count("*").alias("dilution"))
    return waves.join(F.broadcast(sizes), "depth").select("id", F.col("depth").alias("wave"), "dilution")  # a row for each wave


def removal_impact(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe v: the share of its descendants that no root reaches any more without v."""
    edges = materialize(edges, "removal-edges")
    below = materialize(closure(edges, probes), "removal-below")
    roots = nodes(edges).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    pairs = probes.select(F.col("id").alias("probe"))
    # A descendant stays reachable if it has a parent outside the descendants and v that a root reaches (in an acyclic graph: any such parent), or a reachable parent inside.
    member = below.select(F.col("start").alias("probe"), F.col("id").alias("dst"))
    into = member.join(edges, "dst")
    inside = below.select(F.col("start").alias("probe"), F.col("id").alias("src"), F.lit(1).alias("inner"))
    marked = materialize(into.join(inside, ["probe", "src"], "left").filter("src <> probe"), "removal-in")
    reached = materialize(marked.filter("inner is null").select("probe", F.col("dst").alias("id")).distinct(), "removal-ok")
    parts, new = [reached], reached
    within = marked.filter("inner = 1").select("probe", "src", "dst")
    while not new.isEmpty():
        step = within.join(new.withColumnRenamed("id", "src"), ["probe", "src"]).select("probe", F.col("dst").alias("id")).distinct()
        new = materialize(step.join(reduce(DataFrame.union, parts), ["probe", "id"], "left_anti"), "removal-ok")
        parts.append(new)
    del roots
    total = below.groupBy(F.col("start").alias("probe")).agg(F.count("*").alias("descendants"))
    ok = reduce(DataFrame.union, parts).groupBy("probe").agg(F.count("*").alias("still"))
    out = pairs.join(total, "probe", "left").join(ok, "probe", "left").na.fill(0)
    return out.select(F.col("probe").alias("id"), "descendants", rounded((F.col("descendants") - F.col("still")) / F.greatest("descendants", F.lit(1))).alias("impact"))


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, id, hops)``: shortest distances from each start, all starts in the same rounds."""
    edges = materialize(edges, "distance-edges")
    front = materialize(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")), "distance")
    parts = [front]
    for hops in count(1):
        step = front.select("start", F.col("id").alias("src")).join(edges, "src").select("start", F.col("dst").alias("id")).distinct()
        front = materialize(step.join(reduce(DataFrame.union, parts), ["start", "id"], "left_anti").select("start", "id", F.lit(hops).alias("hops")), "distance")
        if front.isEmpty():
            break
        parts.append(front)
    return reduce(DataFrame.union, parts)


#: Starts of one block, all of them in the same rounds; the state of a block is at most a bit of this many for each node.
BLOCK = 65_536


def start_blocks(ids: DataFrame, block: int = BLOCK) -> Iterator[DataFrame]:
    """The places (``masks.places``) of ``ids(id)`` in parts of about ``block``, each of whole batches; together they are all ids."""
    place = masks.places(ids)
    batches, size = (place.agg(F.max("batch")).first()[0] or 0) + 1, max(1, block // (64 * masks.WIDE))
    return (place.filter((F.col("batch") >= k) & (F.col("batch") < k + size)) for k in range(0, batches, size))


def _in_blocks(parts, name: str) -> DataFrame:
    """The rows of all parts, each part computed and written before the next."""
    path = schema = None
    for part in parts:
        path, schema = path or new_path(part.sparkSession, name), part.schema
        part.write.mode("append").parquet(path)
        spark = part.sparkSession
    return spark.read.schema(schema).parquet(path)


def relatives(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(start, id, side)``: the descendants and the ancestors of every node; an ancestor is a descent read backwards. What is stored are masks; pairs come from them where they are read."""
    edges = materialize(edges.select("src", "dst"), "relatives-edges")
    sets = [masks.pairs(masks.reached(edges, place), place) for place in start_blocks(nodes(edges), block)]
    down = reduce(DataFrame.union, sets)
    return down.select("start", "id", F.lit("descendant").alias("side")).union(down.select("id", "start", F.lit("ancestor")))


def removal_impacts(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """``removal_impact`` of all nodes of an acyclic graph, by masks: descendants of v less those that a path from a root reaches without v."""
    edges = materialize(edges.select("src", "dst"), "impact-edges")

    def counts():
        for place in start_blocks(nodes(edges), block):
            above = masks.reached(edges, place)
            ok = masks.undominated(edges, above, place)
            yield place.select("id").join(masks.column_counts(above, place, "descendants"), "id", "left").join(masks.column_counts(ok, place, "still"), "id", "left").na.fill(0)

    return _in_blocks(counts(), "impacts").select("id", "descendants", rounded((F.col("descendants") - F.col("still")) / F.greatest("descendants", F.lit(1))).alias("impact"))


def greatest_removal_impacts(edges: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """The ``n`` nodes of the greatest impact in an acyclic graph, after measuring all; ties by more descendants, then the smaller id."""
    return removal_impacts(edges, block).orderBy(F.desc("impact"), F.desc("descendants"), "id").limit(n)


def path_statistics(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row ``(mean_path, diameter, pairs)`` over all ordered pairs of the largest weakly connected component (ties: smallest id), directions ignored.

    Starts are bits of masks (``masks.hops``): the new bits of a round are the pairs of that distance."""
    edges = materialize(edges.select("src", "dst"), "path-edges")
    parts = materialize(connected_components(edges), "path-components")
    largest = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ids = materialize(parts.join(F.broadcast(largest.select("component")), "component", "left_semi").select("id"), "path-ids")  # one row
    both = edges.union(reverse(edges)).filter("src <> dst").distinct()
    both = materialize(both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"), "path-both")

    def layers():
        all_ids, spark = ids.count(), edges.sparkSession
        for place in start_blocks(ids, block):
            left = all_ids * place.count()
            start = materialize(masks.own_bits(place, masks.OLD).select("*", *(F.col(m).alias(n) for m, n in zip(masks.OLD, masks.NEW, strict=True))), "hops")
            for hop, state in enumerate(masks.hops(both, start)):
                n = state.agg(F.sum(masks.ones(masks.NEW))).first()[0] or 0
                yield spark.createDataFrame([(hop, n)], "hops long, n long")  # a row for each hop
                left -= n
                if not left:  # the component is connected: once all pairs are met, the last ones needn't be sent
                    break

    far = _in_blocks(layers(), "path-counts").filter("hops > 0 and n > 0")
    return far.agg(rounded(F.sum(F.col("hops") * F.col("n")) / F.sum("n")).alias("mean_path"), F.max("hops").alias("diameter"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
