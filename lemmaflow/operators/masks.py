"""What every node reaches hop by hop, in masks: 64 starts are a bit each of a bigint, WIDE of them a row, so a row of a node stands for up to WIDE * 64 of its pairs.

Starts are numbered in the order of their ids and cut into batches of WIDE * 64, a mask row for each (node, batch) that meet. All batches of a block go through the graph in the same rounds; a round
sends only the bits that were new in the one before, so rounds grow with distances, not with the number of nodes or batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import drop_table, materialize
from .ranking import add_rank

WIDE = 16
OLD, NEW = [f"m{w}" for w in range(WIDE)], [f"n{w}" for w in range(WIDE)]
KEY = ["id", "batch"]


def places(ids: DataFrame) -> DataFrame:
    """``ids(id)`` -> ``(id, batch, word, bit)``: the place of each start in the masks."""
    k = add_rank(ids.select("id"), [F.col("id")], "k").withColumn("k", F.col("k") - 1)
    return materialize(k.select("id", F.expr(f"k div {64 * WIDE}").alias("batch"), F.expr(f"cast((k % {64 * WIDE}) div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(k % 64 as int))").alias("bit")), "places")


def own_bits(place: DataFrame, names: list[str]) -> DataFrame:
    """``(id, batch, <names>)``: each start with its own bit."""
    return place.select(*KEY, *(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long")).alias(n) for w, n in enumerate(names)))


def _any(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(n) != 0 for n in names))


def ones(names: list[str]) -> Column:
    """The number of bits set in the masks of a row."""
    return reduce(lambda a, b: a + b, (F.bit_count(n).cast("long") for n in names))


def hops(edges: DataFrame, start: DataFrame) -> Iterator[DataFrame]:
    """``start(id, batch, m*, n*)``: known bits and those to send. Yields it and, for each round, the table of all known bits and, of those, the new ones; the last has none new. A table is dropped
    when the one after the next is asked for, the last one stays."""
    zero, state = F.lit(0).cast("long"), start
    while True:
        yield state
        front = state.filter(_any(NEW)).select(F.col("id").alias("src"), "batch", *NEW)
        if front.isEmpty():
            return
        sent = edges.join(front, "src").groupBy(F.col("dst").alias("id"), "batch").agg(*(F.bit_or(n).alias(f"got_{n}") for n in NEW))
        old, got = [F.coalesce(m, zero) for m in OLD], [F.coalesce(f"got_{n}", zero) for n in NEW]
        both = state.select(*KEY, *OLD).join(sent, KEY, "full")
        new = both.select(*KEY, *(o.bitwiseOR(g).alias(m) for o, g, m in zip(old, got, OLD, strict=True)), *(g.bitwiseAND(F.bitwise_not(o)).alias(n) for o, g, n in zip(old, got, NEW, strict=True)))
        new = materialize(new, "hops")
        drop_table(state)
        state = new


def spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(id, batch, m*)``: the bits of ``start`` and all that come along the edges."""
    for state in hops(edges, start):
        last = state
    return last.select(*KEY, *OLD).filter(_any(OLD))


def reached(edges: DataFrame, place: DataFrame) -> DataFrame:
    """``(id, batch, m*)``: the starts from which a path of an edge or more leads to the node."""
    zero = F.lit(0).cast("long")
    return spread(edges, materialize(own_bits(place, NEW).select(*KEY, *(zero.alias(m) for m in OLD), *NEW), "hops"))


def pairs(masks: DataFrame, place: DataFrame) -> DataFrame:
    """``(start, id)``: a row for each bit. The ids of a word's starts meet its mask, so what is joined are words, not pairs."""
    words = masks.select("id", "batch", F.posexplode(F.array(*OLD)).alias("word", "bits")).filter("bits <> 0")
    at = F.struct(F.col("bit"), F.col("id").alias("start"))
    names = place.groupBy("batch", "word").agg(F.collect_list(at).alias("starts"))  # 64 at most
    hit = F.filter("starts", lambda x: x["bit"].bitwiseAND(F.col("bits")) != 0)["start"]
    return words.join(names, ["batch", "word"]).select(F.explode(hit).alias("start"), "id")


def undominated(edges: DataFrame, above: DataFrame, place: DataFrame) -> DataFrame:
    """Of an acyclic graph with ``above`` = ``reached``: ``(id, batch, m*)``, the starts above each node that a path from a root to it avoids.

    Such a start isn't above (and isn't) one of the node's parents, or a path to a parent avoids it already."""
    zero = F.lit(0).cast("long")
    closed = above.union(own_bits(place, OLD)).groupBy(*KEY).agg(*(F.bit_or(m).alias(m) for m in OLD))
    parents = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("parents"))
    common = edges.join(closed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "batch").agg(F.count("*").alias("k"), *(F.bit_and(m).alias(f"all_{m}") for m in OLD))
    common = common.join(parents, "id").filter("k = parents").drop("k", "parents")  # a parent without a row has no bit
    seeds = above.join(common, KEY, "left").select(*KEY, *(F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"all_{m}", zero))).alias(m) for m in OLD))
    return spread(edges, materialize(seeds.filter(_any(OLD)).select(*KEY, *OLD, *(F.col(m).alias(n) for m, n in zip(OLD, NEW, strict=True))), "hops"))


def column_counts(masks: DataFrame, place: DataFrame, name: str) -> DataFrame:
    """``(id, <name>)``: for each start of ``place`` the number of rows with its bit; no row for none. A task adds the columns of its rows up before anything is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            batch = b.column(0).to_numpy()
            bits = np.column_stack([c.to_numpy() for c in b.columns[1:]]).astype("<i8")
            for k in np.unique(batch):
                for part in np.array_split(bits[batch == k], 1 + b.num_rows // 4096):
                    flat = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little")
                    sums[k] = sums.get(k, 0) + flat.sum(axis=0, dtype=np.int64)
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["batch", "at", "n"])

    found = masks.select("batch", *OLD).mapInArrow(task, "batch long, at int, n long").groupBy("batch", F.expr("at div 64").cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).agg(F.sum("n").alias(name))
    return place.join(found, ["batch", "word", "bit"]).select("id", name)
