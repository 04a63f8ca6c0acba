"""Quality rules: base rules on counts, then a hashed n-gram log-likelihood ratio.

Every document's word 1-grams and 2-grams fall into ``buckets`` hash buckets. Two multinomials over the buckets are counted
with add-one smoothing: one of the trusted target (documents labelled as good), one of the whole raw
corpus. A document's score is the mean of log(target / raw) over its n-grams. Every document is held against the same
threshold, so the decision doesn't depend on order or chance.

All is built-in column functions. The only thing that reaches the driver is the table of ``buckets`` weights, whose size
is a parameter and not a matter of the data.

Base rules (words are runs of ``[^\\x20\\x09-\\x0D]``): ``word_chars`` code points in words; ``n_symbols`` characters of
``#*$%&|<>``; ``n_dup_lines`` lines with a word that equal an earlier line; ``n_repeat_words`` words
covered by a 3-word window that is found twice or more in the text. 3-word windows are compared by 64-bit hashes.

Edge cases: a null or empty text has no words and fails the base rules. Without target documents or without words in
the corpus all weights are 0 and the base rules alone decide. Null ids are kept as rows; a null label isn't trusted. Repeated
rows are judged alike and counted each time. Very long texts cost n log n. Extra columns pass through; in ``judge`` those named like a result give way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRUSTED = 200_000
BUCKETS, MIN_WORDS, MAX_REPEAT_PERCENT, THRESHOLD = 1 << 14, 50, 50, -0.05
PLACE_BITS = 24
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's variable isn't computed again at each use."""
    return F.transform(F.array(value), body)[0]


def _neighbours(xs: Column, key) -> Column:
    """Elements of a sorted array whose key equals that of the element before or after."""
    return F.filter(xs, lambda x, i: (key(x) == key(F.get(xs, i - 1))) | (key(x) == key(F.get(xs, i + 1))))


def repeated_words(hashes: Column) -> Column:
    """Number of words (given by their hashes) covered by 3-word windows that occur twice or more.

    A window's hash and place share one long (40 and 24 bits), so that plain long sorting brings equal windows together;
    the few windows that share 40 bits with another are then compared by all 64 bits. Where places need more than PLACE_BITS, all windows are compared that way."""
    low = F.lit((1 << PLACE_BITS) - 1)

    def places(hs: Column) -> Column:
        packed = F.sort_array(F.transform(hs, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long").bitwiseAND(low))))
        maybe = _let(packed, lambda xs: _neighbours(xs, lambda x: F.shiftright(x, PLACE_BITS)))
        some = F.sort_array(F.transform(maybe, lambda x: F.struct(F.get(hs, x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).cast("int").alias("p"))))
        full = F.when(F.size(hs) <= 1 << PLACE_BITS, some).otherwise(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
        return _let(full, lambda xs: F.sort_array(F.transform(_neighbours(xs, lambda x: x["h"]), lambda x: x["p"])))

    def covered(ps: Column) -> Column:
        return F.aggregate(F.transform(ps, lambda p, i: F.least(F.coalesce(F.get(ps, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    # The last two windows are shorter; they are cut off.
    windows = _let(hashes, lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(ws, i + 1), F.get(ws, i + 2))))
    return _let(windows, lambda hs: _let(places(hs), covered))


def base_counts(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers (from 0) of all word 1-grams and 2-grams, repeated as often as they occur."""
    pairs = _let(hashes, lambda hs: F.transform(F.slice(hs, 2, F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: _bucket(F.xxhash64(F.get(hs, i), h), buckets)))
    return F.concat(F.transform(hashes, lambda h: _bucket(h, buckets)), pairs)


def mean_weight(hashes: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """Mean of the weights of those buckets; null without words."""
    one = lambda h: F.get(weights, _bucket(h, buckets))
    each = _let(hashes, lambda hs: F.transform(hs, lambda h, i: one(h) + F.when(i > 0, one(F.xxhash64(F.get(hs, i - 1), h))).otherwise(F.lit(0.0))))
    return F.when(F.size(hashes) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size(hashes) - 1))


def with_hashes(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_hashes``, the hash of each word. A column of its own, so that its several users don't each split the text."""
    return docs.withColumn("_hashes", F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)))


def bucket_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log(target share / raw share) of each bucket. The raw counts are of all documents; the target is all labelled good, up to ``max_trusted`` of them
    (those of the smallest hash of their id), which bounds what is broadcast."""
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("good_id")).filter("good_id is not null").distinct()
    trusted = F.broadcast(trusted.orderBy(F.xxhash64("good_id"), "good_id").limit(max_trusted).withColumn("good", F.lit(1)))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col)).join(trusted, F.col("id") == F.col("good_id"), "left")
    grams = with_hashes(marked, text_col).select("good", F.explode(ngram_buckets(F.col("_hashes"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()  # at most ``buckets`` rows
    n_raw, n_good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    weights = [0.0] * buckets
    if n_good:
        for r in counts:
            weights[r["b"]] = math.log((r["good"] + 1) / (n_good + buckets)) - math.log((r["raw"] + 1) / (n_raw + buckets))
    return weights


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``llr`` (mean log-likelihood ratio, null without words), ``base_failed`` and ``kept``."""
    # As text and cast back, which is exact and folds into one constant: a plan of one literal, not of 16,384.
    weights = F.split(F.lit(",".join(map(repr, bucket_weights(docs, labels, id_col, text_col, buckets)))), ",").cast("array<double>")
    hashes = F.col("_hashes")
    counts = {"n_words": F.size(hashes).cast("long"), **base_counts(F.col("text")), "n_repeat_words": repeated_words(hashes).cast("long")}
    # The row goes along as one struct, so that its names can't clash with those used here.
    out = with_hashes(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), "text")
    out = out.withColumns(counts | {"llr": F.round(mean_weight(hashes, weights, buckets), 6)})
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
    names = [*counts, "llr", "base_failed", "kept"]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in names), *names)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only, whatever these are called."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = judge(packed, labels.withColumnRenamed(id_col, "id"), "id", "text", **options).filter("kept")
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))
