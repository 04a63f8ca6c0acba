"""Connected components by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import drop_table, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(id, component)``; component is the smallest id reachable, directions ignored.

    Each round hooks every vertex to the smallest of itself and its neighbours, follows that pointer
    once more, and contracts the edges; at least half of the vertices that still have edges vanish, so the
    number of rounds grows with the logarithm of the number of vertices. Vertices come from the edges only; null ends are ignored.
    """
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    e = materialize(e.filter("u is not null and v is not null").distinct(), "cc-edges")
    n = e.count()
    labels = materialize(e.select(F.col("u").alias("id")).union(e.select("v")).distinct().select("id", F.col("id").alias("component")), "cc-labels", n)
    e_live = e.filter("u <> v")
    n_labels, n = n, e_live.count()
    for _ in range(max_rounds):
        if not n:
            return labels
        both = e_live.select("u", "v").union(e_live.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        hook = materialize(hook, "cc-hook", n)
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = materialize(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "cc-parent", n)
        a = parent.select("u", F.col("p").alias("pu"))
        b = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = e_live.join(a, "u").join(b, "v").filter("pu <> pv")
        e_next = materialize(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-edges", n)
        to = parent.select(F.col("u").alias("component"), "p")
        labels_next = materialize(labels.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "cc-labels", n_labels)
        for old in (e, labels, hook, parent):
            drop_table(old)
        e, labels = e_next, labels_next
        e_live, n = e, e.count()
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
