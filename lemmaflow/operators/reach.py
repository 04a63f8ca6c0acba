"""What each node of an acyclic graph reaches, as bits: 64 nodes of one depth are a word, so a set is a few rows of a bigint instead of a row for each member.

Words hold nodes of one depth only, so "members of a depth below d" is a filter on ``at``; sizes are sums of bit counts, and two sets meet in a join on (at, word) and an AND.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import drop_path, drop_table, materialize, new_path
from .graph import reverse
from .loops import kahn_rounds
from .ranking import add_rank


def places(depth: DataFrame) -> DataFrame:
    """``depth(id, depth)`` -> ``(id, at, word, bit)``: each node's bit; ``at`` is its depth and ``word`` counts from 0 within the depth."""
    ranked = add_rank(depth.select("id", "depth"), [F.col("depth"), F.col("id")], "place")
    starts = ranked.groupBy("depth").agg(F.min("place").alias("start"))
    # A row for each depth.
    return ranked.join(F.broadcast(starts), "depth").select("id", F.col("depth").alias("at"), F.expr("(place - start) div 64").alias("word"), F.expr("shiftleft(1L, cast((place - start) % 64 as int))").alias("bit"))


def flow(edges: DataFrame, place: DataFrame, layers: DataFrame) -> DataFrame:
    """``(id, at, word, bits)``: for each node the nodes from which edges lead to it, itself not included. ``layers(id, depth)`` are the Kahn rounds of the edges.

    The set of a node is complete in its round and is then pushed along its edges into the partition of each target's round. Each round reads its own partition of the sets and of the
    edges, so all rounds together read each edge once, and no round looks at what was found before. Nodes on or below cycles, which have no round, are left out."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    at = lambda c, name: layers.select(F.col("id").alias(c), F.col("depth").alias(name))
    links = edges.select("src", "dst").join(at("src", "round"), "src").join(at("dst", "to"), "dst").join(place.withColumnRenamed("id", "src"), "src")
    by_round, sets = new_path(spark, "reach-links"), new_path(spark, "reach-sets")
    links.write.partitionBy("round").parquet(by_round)
    links = spark.read.schema(links.schema).parquet(by_round)
    pushed = T.StructType([T.StructField("dst", kind), T.StructField("at", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("to", T.IntegerType())])
    rounds = links.agg(F.max("round")).first()[0]
    for k in range(0 if rounds is None else rounds + 1):
        mine = links.filter(F.col("round") == k)
        rows = mine.select("dst", "at", "word", F.col("bit").alias("bits"), "to")
        if k:
            known = spark.read.schema(pushed).parquet(sets).filter(F.col("to") == k).groupBy(F.col("dst").alias("src"), "at", "word").agg(F.bit_or("bits").alias("bits"))
            rows = rows.union(mine.select("src", "dst", "to").join(known, "src").select("dst", "at", "word", "bits", "to"))
        rows.groupBy("dst", "at", "word", "to").agg(F.bit_or("bits").alias("bits")).select(*pushed.names).write.mode("append").partitionBy("to").parquet(sets)
    found = spark.read.schema(pushed).parquet(sets) if rounds is not None else spark.createDataFrame([], pushed)
    out = materialize(found.groupBy(F.col("dst").alias("id"), "at", "word").agg(F.bit_or("bits").alias("bits")), "reach")
    for path in (by_round, sets):
        drop_path(spark, path)
    return out


def ancestors(edges: DataFrame, depth: DataFrame, place: DataFrame) -> DataFrame:
    """``(id, at, word, bits)``: the ancestors of each node that has any."""
    return flow(edges, place, depth)


def descendants(edges: DataFrame, place: DataFrame, height: DataFrame | None = None) -> DataFrame:
    """``(id, at, word, bits)``: the descendants of each node that has any. ``height(id, depth)`` are the Kahn rounds of the reversed edges, where they are known."""
    back = materialize(reverse(edges).select("src", "dst"), "reach-back")
    own = materialize(kahn_rounds(back), "reach-height") if height is None else None
    out = flow(back, place, own if height is None else height)
    for table in (back, own):
        if table is not None:
            drop_table(table)
    return out


def sizes(sets: DataFrame, name: str) -> DataFrame:
    """``(id, <name>)``: the number of members of each set."""
    return sets.groupBy("id").agg(F.sum(F.bit_count("bits").cast("long")).alias(name))


def bit_planes(weights: DataFrame, place: DataFrame) -> DataFrame:
    """``weights(id, n)`` -> ``(at, word, plane, mask)``: bit ``plane`` of n of the nodes of a word. A sum of weights over a set is the sum of 2 ** plane times the bit count of set & mask."""
    digits = weights.filter("n > 0").select("id", F.explode(F.sequence(F.lit(0), F.floor(F.log2("n")).cast("int") + 1)).alias("plane"), "n").filter(F.expr("shiftright(n, plane) & 1 = 1"))
    return digits.join(place, "id").groupBy("at", "word", "plane").agg(F.bit_or("bit").alias("mask"))
