"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word n-grams, kept as 64-bit hashes. Those whose sets have |A & B| / |A | B| of at least ``percent`` % link.

1. Equal sets fall together by a 128-bit fingerprint; the smallest doc_id of such a class speaks for it.
2. Any fixed order of the n-grams gives a prefix rule: sets that link share at least l n-grams among the first
   (size - least overlap + l) of each. In the order of the hashes, that needs only a fifth of all n-grams; documents
   without enough shared ones cannot link and leave.
3. For those that stay, the global order is by rising document frequency. N-grams of one document only can't overlap and go. The order is cut into
   ``fragments`` at quantiles: each document has one segment per fragment. Pairs come from equal n-grams in the prefixes; for each pair, the
   overlaps of its segments are counted fragment by fragment, apart from each other, and summed.
4. Small buckets list their pairs. A large bucket isn't expanded: its most central document is the pivot, compared with all others. Its members are then known by their differences from the pivot, and
   two members that link must share most of these differences, so the prefix rule on the differences cuts the bucket into smaller ones (``link_rounds`` has the bound). Rounds go on
   until no bucket is large; documents found to be connected needn't be compared again. No link between different components is left out, so components are exact.

Edge cases: a text that is null or has no words gives an empty set, linked with nothing; a text with fewer words than n is one n-gram. Rows with a null doc_id come
back with a null component and link nothing. Repeated rows are one class. An id that comes with several texts is one document whose rows keep
their own sizes; it links by any of its sets that are alike. An empty table gives an empty result. Extra columns are ignored. Texts
of any length are handled whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.durable import drop_table, materialize
from .skew import heavy_keys, join_by_key
from .text import ascii_words, shingle_hashes

FRAGMENTS, SMALL_BUCKET, EXTRA_PERCENT, MAX_BROADCAST = 4, 32, 5, 2_000_000
#: So many of the first elements of a difference must be others' too, for a difference that shares ``least`` with any it links with.
EARLY = "1 + least div 4"
_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("first", pa.list_(pa.int64()))])
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("gram", pa.int64())])


def _least(n, percent: int):
    """Least overlap of a set of n with any set it links with: ceil(percent * n / 100)."""
    return (n * percent + 99) // 100


def read_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    for b in batches:
        yield [(i, shingle_hashes(ascii_words(t.as_py()), k)) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]


def fingerprints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, fp1, fp2, first)``: the size of each set, 128 bits that equal sets share, and its first n-grams by hash, as many as
    the prefix rule with EXTRA_PERCENT more asks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in read_sets(batches, k):
            for at in range(0, len(sets), 500):
                some = sets[at : at + 500]
                first = [s[: len(s) - _least(len(s), percent) + len(s) * EXTRA_PERCENT // 100 + 1] for _, s in some]
                prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for _, s in some])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first), pa.int64()))
                columns = [pa.array([i for i, _ in some], pa.int64()), pa.array([len(s) for _, s in some], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists]
                yield pa.RecordBatch.from_arrays(columns, schema=_PRINTS)

    return docs.mapInArrow(task, "doc_id long, n_shingles long, fp1 long, fp2 long, first array<long>")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, gram)`` for all n-grams."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in read_sets(batches, k):
            for at in range(0, len(sets), 500):
                some = sets[at : at + 500]
                lengths = [len(s) for _, s in some]
                if sum(lengths):
                    columns = [np.repeat([i for i, _ in some], lengths), np.repeat(lengths, lengths), np.concatenate([s for _, s in some])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ROWS)

    return docs.mapInArrow(task, "doc_id long, n long, gram long")


def _may_link(prints: DataFrame, percent: int) -> DataFrame:
    """Ids of the documents that share enough of their first n-grams with others."""
    first = prints.filter("doc_id is not null").select("doc_id", F.col("n_shingles").alias("n"), F.explode("first").alias("gram"))
    shared = first.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    hits = first.join(shared, "gram").groupBy("doc_id", "n").agg(F.count("*").alias("hits"))
    # The partner may be smaller, down to percent % of n, and is then bound to share only as many as its own size asks for.
    least = F.expr(f"(((n * {percent} + 99) div 100) * {EXTRA_PERCENT}) div 100 + 1")
    return hits.filter(F.col("hits") >= least).select("doc_id").distinct()


def ordered_sets(docs: DataFrame, k: int, percent: int, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """``sets(doc_id, n, grams)``: those n-grams that other documents have too, as (o, gram) in the global order o, and ``segments(doc_id, fragment, grams)``: the
    same cut into fragments of the order, a row for each fragment of each document."""
    grams = materialize(_grams(docs, k), "grams")
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    # The global order: document frequency, then hash.
    order = F.shiftleft(F.least("df", F.lit(32767)), 48).bitwiseOR(F.shiftrightunsigned("gram", 16))
    sets = grams.join(df, "gram").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "gram"))).alias("grams"))
    sets = materialize(sets.filter(F.size("grams") >= F.expr(f"(n * {percent} + 99) div 100")), "sets")
    cuts = sets.select(F.explode("grams.o").alias("o")).agg(F.percentile_approx("o", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
    ends = [None, *cuts, None]
    within = lambda lo, hi: lambda x: (F.lit(True) if lo is None else x["o"] > lo) & (F.lit(True) if hi is None else x["o"] <= hi)
    parts = F.array(*(F.filter("grams", within(lo, hi))["gram"] for lo, hi in zip(ends, ends[1:], strict=False)))
    drop_table(grams)
    return sets, materialize(sets.select("doc_id", F.posexplode(parts).alias("fragment", "grams")), "segments")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The overlap of each pair: its partial overlaps, counted in each fragment, summed."""
    b = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("gb"))
    a = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("ga"))
    partial = pairs.join(b, "b").join(a, ["a", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("overlap"))


def _buckets(sets: DataFrame, percent: int) -> DataFrame:
    """A row for each n-gram of each prefix."""
    prefix = F.slice("grams", 1, F.size("grams") - F.expr(f"(n * {percent} + 99) div 100").cast("int") + 1)
    cols = [F.col("doc_id").alias("label"), "n", F.size("grams").alias("s"), F.col("n").alias("x"), F.size("grams").alias("xs"), (F.col("n") - F.size("grams")).cast("long").alias("own")]
    return sets.select("doc_id", *cols, F.posexplode(prefix).alias("pos", "g")).select(F.col("g.gram").alias("key"), "doc_id", "label", "n", "s", "x", "xs", "pos", "own")


def _differences(groups: DataFrame, pivots: DataFrame, segments: DataFrame, heavy: DataFrame) -> DataFrame:
    """``groups(pivot, doc_id, ...)`` with the overlap of both and ``elements``: the shared n-grams that only one of both has. Counted in each fragment, then summed."""
    mine = groups.join(segments, "doc_id")
    theirs = pivots.select("pivot", "m").join(segments.select(F.col("doc_id").alias("pivot"), "fragment", F.col("grams").alias("theirs")), "pivot")
    theirs = theirs.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("fragment", "theirs"))).alias("all"))  # the fragments of one document
    both = join_by_key(mine, theirs, "pivot", "doc_id", heavy).withColumn("theirs", F.element_at("all", F.col("fragment") + 1)["theirs"])
    part = F.struct(F.array_except("grams", "theirs").alias("more"), F.array_except("theirs", "grams").alias("less"))
    cols = [c for c in groups.columns if c not in ("pivot", "doc_id")]
    parts = both.select("pivot", "doc_id", *cols, F.size(F.array_intersect("grams", "theirs")).alias("c"), part.alias("part"))
    out = parts.groupBy("pivot", "doc_id").agg(*(F.first(c).alias(c) for c in cols), F.sum("c").alias("overlap"), F.collect_list("part").alias("parts"))
    return out.select("pivot", "doc_id", *cols, "overlap", F.concat(F.flatten("parts.more"), F.flatten("parts.less")).alias("elements"))


def link_rounds(rows: DataFrame, segments: DataFrame, percent: int, near: DataFrame | None = None) -> DataFrame:
    """``(id, component)`` of all documents that link, of those that meet in the buckets ``rows(key, doc_id, label, n, s, x, xs, pos, own)``.
    ``near(key, pivot)``, if given, names the pivots of the first round, which needn't be in their buckets.

    A document is seen as a set X of x elements, of which xs are shared with others: at first all its n-grams, later those that differ from a pivot. Two documents differ in as many
    elements as their X do, so they link if |X1 ^ X2| is at most (100 - p) / (100 + p) of n1 + n2. With f = (100 + p) x - (100 - p) n that means: X1 and X2
    share at least (f1 + f2) / (2 (100 + p)) elements. So the prefix rule holds for X too, and those with f1 + f2 <= 0 link in any case.

    Rows of a bucket may share an element at ``pos`` of theirs in a common order, and at most min(xs - pos) from there on."""
    spark, p, q = rows.sparkSession, 100 + percent, 100 - percent
    f = F.col("x") * p - F.col("n") * q
    pairs, small, budget, stored = [], SMALL_BUCKET, None, None
    edges = spark.createDataFrame([], "id long, component long")
    while True:
        rows = rows.withColumn("f", f).withColumn("most", 2 * p * (F.col("xs") - F.col("pos")) - F.col("f"))
        span = [F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("f").alias("least_f"), F.max("most").alias("most_f")]
        # Pivots are the documents of the least ``own`` (n-grams of their own): originals rather than their edited copies.
        central = F.min(F.struct("own", "doc_id", "n", "s")).alias("pivot")
        keys = rows.groupBy("key").agg(*span, central).filter("lo < hi and least_f <= most_f")
        if near is not None and stored is None:
            keys = keys.drop("pivot").join(near, "key")
        keys = materialize(keys, "keys")
        # Listing larger buckets saves rounds. It stays within the pairs of a first round whose buckets are all of SMALL_BUCKET; each round takes a pivot from each larger one anyway.
        if budget is None:
            budget = SMALL_BUCKET * (keys.agg(F.sum("m")).first()[0] or 0)
        elif (keys.filter(F.col("m") <= 2 * small).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0) <= budget:
            small *= 2
        live = rows.join(keys.drop("lo", "hi"), "key").filter("f <= most_f and least_f <= most")
        # A key has one row on the right, so Spark's own splitting of skewed partitions deals out the rows of a hot one.
        live = materialize(live.select("key", "m", "doc_id", "label", "n", "s", "xs", "pos", "own", "f", "most", "pivot"), "live")
        if stored is not None:
            drop_table(stored)

        side = lambda x: live.filter(F.col("m") <= small).select("key", *[F.col(c).alias(c[0] + x) for c in ("doc_id", "label", "n", "f", "most")])
        fits = (F.col("da") < F.col("db")) & (F.col("la") != F.col("lb")) & (F.col("fa") <= F.col("mb")) & (F.col("fb") <= F.col("ma"))
        near = side("a").join(side("b"), "key").filter(fits).select(F.col("da").alias("a"), F.col("db").alias("b"), "na", "nb").distinct()
        pairs.append(materialize(near, "pairs"))

        large = live.filter(F.col("m") > small)
        groups = large.filter("doc_id <> pivot.doc_id").select(F.col("pivot.doc_id").alias("pivot"), F.col("pivot.n").alias("pn"), F.col("pivot.s").alias("ps"), "doc_id", "label", "n", "s", "own").distinct()
        groups = materialize(groups, "groups")
        pivots = materialize(groups.groupBy("pivot").agg(F.count("*").alias("m"), F.first("pn").alias("pn"), F.first("ps").alias("ps")), "pivots")
        heavy = heavy_keys(pivots, "pivot")
        if pivots.isEmpty():
            break
        d = _differences(groups, pivots, segments, heavy).withColumn("x", F.col("n") + F.col("ps") - 2 * F.col("overlap")).withColumn("f", f)
        d = differences = materialize(d, "differences")
        # Of all pairs with f1 + f2 <= 0 in a group, each document of one also has such a pair with the document of the least f.
        first = d.groupBy("pivot").agg(F.min(F.struct("f", F.col("doc_id").alias("id"))).alias("q"))
        first = pivots.join(first, "pivot").withColumn("q", F.least("q", F.struct(((F.col("pn") - F.col("ps")) * p - F.col("pn") * q).alias("f"), F.col("pivot").alias("id"))))
        d = join_by_key(d, first.select("pivot", "q"), "pivot", "doc_id", heavy)
        to_pivot = p * F.col("overlap") >= percent * (F.col("pn") + F.col("n"))
        to_first = (F.col("f") + F.col("q.f") <= 0) & (F.col("q.id") != F.col("doc_id"))
        d = d.withColumn("to", F.array_compact(F.array(F.when(to_pivot, F.col("pivot")), F.when(to_first, F.col("q.id")))))
        links = materialize(d.select("doc_id", F.explode(F.array_distinct("to")).alias("to")).distinct(), "links")
        edges = connected_components(links.select(F.col("doc_id").alias("src"), F.col("to").alias("dst")).union(edges))
        label = edges.select(F.col("id").alias("doc_id"), F.col("component").alias("new"))

        # Documents of one component needn't meet again, and the pivot's own links are known. So the partners of a document have the least f of the group's other components at least, and a group of one component goes.
        named = differences.select("pivot", "doc_id", "f", "label").join(label, "doc_id", "left").select("pivot", "doc_id", "f", F.coalesce("new", "label").alias("label"))
        named = materialize(named, "named")
        best = named.groupBy("pivot").agg(F.min(F.struct("f", "label")).alias("best"))
        second = join_by_key(named, best, "pivot", "doc_id", heavy).filter("label <> best.label").groupBy("pivot").agg(F.min("f").alias("second"))
        d = join_by_key(differences, best.join(second, "pivot"), "pivot", "doc_id", heavy).select("*", F.xxhash64("pivot", "doc_id").alias("one")).join(label, "doc_id", "left").withColumn("label", F.coalesce("new", "label"))
        d = d.withColumn("low", F.when(F.col("label") == F.col("best.label"), F.col("second")).otherwise(F.col("best.f")))
        # The least number of elements that X shares with any other X it links with.
        widest = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * q / p)
        least = F.greatest(F.lit(1), F.col("x") - widest, F.ceil((F.col("f") + F.col("low")) / (2 * p))).cast("int")
        d = d.withColumn("least", least).filter(F.size("elements") >= F.col("least")).withColumn("keys", F.sort_array(F.transform("elements", lambda e: F.xxhash64("pivot", e))))
        able = stored_able = materialize(d.select("one", "doc_id", "label", "n", "s", "x", "own", "least", "keys"), "able")
        # In the order of the hashes, X and one it links with share EARLY or more of their first elements, whatever the least number of the other one: EARLY rises slower than the least number.
        first_keys = able.select("one", "doc_id", F.explode(F.slice("keys", 1, F.size("keys") - F.col("least") + F.expr(EARLY).cast("int"))).alias("key"))
        first_keys = materialize(first_keys, "first-keys")
        met = materialize(first_keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "met")
        hits = join_by_key(first_keys, met, "key", "doc_id", heavy_keys(met, "key")).groupBy("one").agg(F.count("*").alias("hits"))
        able = able.join(hits, "one").filter(F.col("hits") >= F.expr(EARLY)).drop("hits")
        # The common order within a group: elements of few documents first. Those that one document alone has find none, wherever they stand.
        each = elements = materialize(able.select("one", "doc_id", F.explode("keys").alias("key")), "elements")
        counts = materialize(each.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "counts")
        each = join_by_key(each, counts, "key", "doc_id", heavy_keys(counts, "key"))
        order = each.groupBy("one").agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("order"))
        nearer = able.drop("keys").join(order, "one").withColumn("xs", F.size("order")).filter("least <= xs")
        prefix = F.slice("order", 1, (F.col("xs") - F.col("least") + 1).cast("int"))
        rows = nearer.select(F.posexplode(prefix).alias("pos", "e"), "doc_id", "label", "n", "s", "x", "xs", "own").select("e.key", "doc_id", "label", "n", "s", "x", "xs", "pos", "own")
        rows = stored = materialize(rows, "buckets")
        for table in (keys, live, groups, pivots, links, named, stored_able, first_keys, met, elements, counts, differences):
            drop_table(table)
    for table in (keys, live, groups, pivots):
        drop_table(table)
    both = functools.reduce(DataFrame.union, pairs).distinct()
    overlaps = _overlaps(both, segments).filter(p * F.col("overlap") >= percent * (F.col("na") + F.col("nb")))
    out = connected_components(overlaps.select("a", "b").union(edges).toDF("src", "dst"))
    for table in pairs:
        drop_table(table)
    return out


def classes(prints: DataFrame) -> DataFrame:
    """``(fp1, fp2, class_id)``: the smallest doc_id of each set that isn't empty."""
    return materialize(prints.filter("doc_id is not null and n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("class_id")), "classes")


def one_text(rows: DataFrame, prints: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``ids``. An id with several texts would mix their n-grams: the one of the smallest hash is taken."""
    ids = materialize(ids, "ids")
    # 16 MB of ids at most go to every task, so that texts needn't be shuffled; more ids than that meet the texts in a shuffle.
    few = ids.count() <= MAX_BROADCAST
    texts = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    twice = prints.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    return texts.join(twice, "doc_id", "left_anti").union(texts.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def labelled(prints: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` of all rows, from the components ``linked(id, component)`` of the classes."""
    named_all = prints.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left")
    out = named_all.join(linked.withColumnRenamed("id", "class_id"), "class_id", "left")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(linkable, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("class_id"), F.coalesce(F.when(linkable, F.col("component")), own).alias("component_id"))


def components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", fragments: int = FRAGMENTS) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)``: class_id is the smallest doc_id with the same set, component_id the smallest reachable by links."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(rows, k, percent), "prints")
    speak = classes(prints)
    able = materialize(_may_link(prints, percent).join(speak.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "able")
    sets, segments = ordered_sets(one_text(rows, prints, able), k, percent, fragments)
    linked = link_rounds(_buckets(sets, percent), segments, percent)
    for table in (able, sets, segments):
        drop_table(table)
    return labelled(prints, speak, linked)


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = components(docs, id_col=id_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
