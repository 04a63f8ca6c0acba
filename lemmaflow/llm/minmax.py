"""Near-duplicate detection by min-max hashing.

Documents are sets of word n-grams, kept as 64-bit hashes. Those whose sets have |A & B| / |A | B| of at least ``percent`` % link.

1. Equal sets fall together by a 128-bit fingerprint; the smallest doc_id of such a class speaks for it.
2. ``PERMUTATIONS`` permutations of the 64-bit numbers are applied to each set, and both the least and the largest value under each are kept: two values of a signature for one hash
   evaluation. Each equals that of another set with the probability of their similarity.
3. A band is the least, or the largest, values of ``WIDTH`` permutations; two documents that agree in a band meet in its bucket. With 64 permutations and bands of 4 there are 32 bands:
   a pair of similarity 0.8 meets nowhere with probability (1 - 0.8^4)^32 = 5e-8, one of 0.85 with 1e-10.
4. Of buckets with the same documents one stands for all. Links are confirmed on full sets: small buckets are compared by their pairs; in a large one all are compared with one document,
   the pivot, and by their differences from it, whose prefix rule loses no link between different components (``jaccard.link_rounds``). A pivot needn't be in the bucket: edited
   copies also meet in bands that their original isn't in, and all buckets of such a group take the original, so each copy is compared with it once (``near_pivots``).

Edge cases: a text that is null or has no words gives an empty set, linked with nothing; a text with fewer words than n is one n-gram. Rows with a null doc_id come
back with a null component, link nothing and are kept. Repeated rows are one class. An id that comes with several texts is one document whose rows keep
their own sizes; it links by any of its sets that are equal to another's, and by one of its texts that are near. An empty table gives an empty result. Extra columns are ignored.
Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import drop_table, materialize
from . import jaccard
from .text import mix

PERMUTATIONS, WIDTH, BLOCK = 64, 4, 16_384
_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def permutations(n: int) -> list[tuple[np.uint64, np.uint64]]:
    """x -> (x ^ shift) * factor with an odd factor, for n pairs of fixed numbers."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP)
    return list(zip(x[:n], x[n:] | np.uint64(1), strict=True))


def signatures(sets: list[np.ndarray], n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value of each (non-empty) set under each of n permutations, a row for each set."""
    least, most = np.empty((len(sets), n), np.uint64), np.empty((len(sets), n), np.uint64)
    at = 0
    while at < len(sets):  # as many sets at once as fit in a processor's cache
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= BLOCK:
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end]).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        with np.errstate(over="ignore"):
            for p, (shift, factor) in enumerate(permutations(n)):
                y = (x ^ shift) * factor
                least[at:end, p] = np.minimum.reduceat(y, starts)
                most[at:end, p] = np.maximum.reduceat(y, starts)
        at = end
    return least, most


def band_keys(least: np.ndarray, most: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A 64-bit key for each band of each row: those of the least values, then those of the largest."""
    bands = np.concatenate([least, most], axis=1).reshape(len(least), -1, width)
    with np.errstate(over="ignore"):
        key = mix(np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * _STEP, bands.shape[:2]))
        for i in range(width):
            key = mix(key * _STEP + bands[:, :, i])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, k: int, n: int, width: int) -> DataFrame:
    """``(doc_id, n_shingles, fp1, fp2, keys)``: the size of each set, 128 bits that equal sets share, and its band keys (none for an empty set)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in jaccard.read_sets(batches, k):
            for at in range(0, len(rows), 500):
                some = rows[at : at + 500]
                full = [s for _, s in some if len(s)]
                keys = iter(band_keys(*signatures(full, n), width)) if full else iter(())
                prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for _, s in some])
                columns = [pa.array([i for i, _ in some], pa.int64()), pa.array([len(s) for _, s in some], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([next(keys) if len(s) else [] for _, s in some], pa.list_(pa.int64()))], schema=_PRINTS)

    return docs.mapInArrow(task, "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def buckets(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, m, doc_id)`` of the buckets of m > 1 documents that speak for different classes; of buckets with the same documents one."""
    speakers = classes.select(F.col("class_id").alias("doc_id"), "fp1", "fp2")
    rows = prints.join(speakers, ["doc_id", "fp1", "fp2"], "left_semi").select("doc_id", F.explode("keys").alias("key"))
    kinds = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("x")).filter("lo < hi")
    kept = materialize(kinds.groupBy("m", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "m"), "bands")
    out = materialize(rows.join(kept, "key").distinct(), "band-rows")  # a row for each key on one side: Spark splits skewed partitions of the other
    drop_table(kept)
    return out


def near_pivots(rows: DataFrame) -> DataFrame:
    """``(key, pivot)``: of the documents that meet a member of the bucket anywhere, the one that meets the most.

    ``rows(key, doc_id, n, s, own)``; two aggregations with partial sums on either side of one join on the key, so neither a hot bucket nor a document in many is one task's rows."""
    central = materialize(rows.groupBy("key").agg(F.min(F.struct("own", "doc_id", "n", "s")).alias("pivot")), "central")
    best = materialize(rows.select("key", "doc_id").join(central, "key").groupBy("doc_id").agg(F.min("pivot").alias("pivot")), "best")
    out = materialize(rows.select("key", "doc_id").join(best, "doc_id").groupBy("key").agg(F.min("pivot").alias("pivot")), "near-pivots")
    for table in (central, best):
        drop_table(table)
    return out


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, grams)``, grams in the order of the hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in jaccard.read_sets(batches, k):
            for at in range(0, len(rows), 200):
                some = rows[at : at + 200]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(([i for i, _ in some], [len(s) for _, s in some], [s for _, s in some]), _SETS, strict=True)], schema=_SETS)

    return docs.mapInArrow(task, "doc_id long, n long, grams array<long>")


def components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", n_permutations: int = PERMUTATIONS, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id, kept)``: class_id is the smallest doc_id with the same set, component_id the smallest reachable by links; kept is true for that one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(rows, k, n_permutations, width), "prints")
    classes = jaccard.classes(prints)
    met = buckets(prints, classes)
    # An original meets more documents than its edited copies do; the one that meets the most is a bucket's pivot.
    hits = materialize(met.groupBy("doc_id").agg(F.sum("m").alias("hits")), "hits")
    sets = materialize(full_sets(jaccard.one_text(rows, prints, hits.select("doc_id")), k), "sets")
    whole = ["doc_id", F.col("doc_id").alias("label"), "n", F.col("n").alias("s"), F.col("n").alias("x"), F.col("n").alias("xs"), F.lit(0).alias("pos"), (-F.col("hits")).alias("own")]
    known = sets.select("doc_id", "n").join(hits, "doc_id").select(*whole)
    first = materialize(met.select("key", "doc_id").join(known, "doc_id").select("key", "doc_id", "label", "n", "s", "x", "xs", "pos", "own"), "buckets")
    near = near_pivots(first)
    linked = jaccard.link_rounds(first, sets.select("doc_id", F.lit(0).alias("fragment"), "grams"), percent, near)
    for table in (met, hits, sets, first, near):
        drop_table(table)
    out = jaccard.labelled(prints, classes, linked)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = components(docs, id_col=id_col, **options).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
