"""Site-relative line frequency: lines that too large a share of a host's pages contain are boilerplate and go.

For each host and line, the pages of the host that contain the line are counted (each page once) and divided by the
host's pages. A line goes from every page of the host where that share is above ``ratio`` and at least ``min_pages`` pages
of the host have it (else a host of two pages would lose all it shares).

Only 64-bit line hashes are counted, combined within each task before the shuffle, so a line on a third
of all pages costs one row a task. Kept texts are rebuilt on the row of the document; texts are moved once at most.

Edge cases: a null host is a host of its own; a null text stays null and counts as a page without lines; an
empty text or line without any character but white space never goes (it is layout). Repeated rows are pages of their own; rows
of one id and host share the decision, which depends on host and line alone. Extra columns pass through, but for input columns named like the ``counts``, which give way to these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialize

BLANK = r"[\x20\x09-\x0D]*"
MAX_BROADCAST, SALTS = 200_000, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``(host, line_hash, pages, host_pages)`` of the lines that go. At most (lines per page / ratio) rows a host."""
    lined = docs.select(F.col(host_col).alias("host"), F.explode_outer(F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: F.when(~x.rlike(f"^{BLANK}$"), F.xxhash64(x))))).alias("line_hash"))
    counts = lined.filter("line_hash is not null").groupBy("host", "line_hash").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = docs.groupBy(F.col(host_col).alias("host_")).agg(F.count("*").alias("host_pages"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("host_"))).filter(F.col("pages") > ratio * F.col("host_pages")).drop("host_")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and the two ``counts``, of its lines and of those dropped.

    The lines to drop of a host are gathered in one array: no more than (its lines per page / ratio) hashes,
    whatever the number of its pages. The arrays are written and measured: up to ``MAX_BROADCAST`` hashes they are
    broadcast; beyond that they are repeated for ``SALTS`` salts and joined on (host, salt), which spreads a host
    with a third of all pages over that many tasks."""
    bad = boilerplate_lines(docs, host_col, text_col, ratio, min_pages)
    arrays = materialize(bad.groupBy("host").agg(F.collect_list("line_hash").alias("bad")), "boilerplate")
    # The row goes along as one struct, so that its names can't clash with those used here.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(host_col).alias("own"), F.col(text_col).alias("text"))
    same = F.col("own").eqNullSafe(F.col("host"))
    if (arrays.agg(F.sum(F.size("bad"))).first()[0] or 0) <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(arrays), same, "left")
    else:
        salted = arrays.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("to")), "left")
    # Of the host's list only what the page has: found by hash, so a long list isn't searched for each line.
    mine = F.array_intersect(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)), F.coalesce("bad", F.array().cast("array<bigint>")))
    lines = F.when(F.col("text").isNotNull(), _lines(F.col("text")))
    joined = joined.select("row", "text", lines.alias("lines"), mine.alias("mine"))
    joined = joined.withColumn("kept", F.when(F.size("mine") > 0, F.filter("lines", lambda x: ~F.array_contains("mine", F.xxhash64(x)))))
    n, left = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("kept"), F.size("lines"), F.lit(0))
    n, left = F.greatest(n, F.lit(0)), F.greatest(left, F.lit(0))
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, *counts)]
    return joined.select(*own, text.alias(text_col), n.cast("long").alias(counts[0]), (n - left).cast("long").alias(counts[1]))
