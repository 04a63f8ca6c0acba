"""Target-distribution importance resampling by bit-sliced aggregation.

1. Features are the runs of 1 to 2 consecutive words, repeats counted; each falls into one of ``n_buckets`` by the CRC-32 of its bytes. Two passes over
   the texts count them, one row for each bucket and task before the shuffle: the raw corpus's counts s of S features, the target's counts t of T.
2. A bucket's gain is floor(1000 * ln((t + 1) * (S + n) / ((s + 1) * (T + n)))). The signed gains become bit planes of ``n_buckets`` bits: bit k of the
   positive ones and bit k of the size of the negative ones. The ``n_buckets`` gains are all that goes to the driver and back.
3. A document's bucket counts become bit planes too. Each is ANDed with each plane of gains; the popcounts, times powers of two, sum to the exact weight of all its
   features. ``weight`` is their floored mean.
4. ``score`` adds Gumbel noise from a hash of the id, so the highest scores are a sample without replacement in proportion to exp(weight / 1000). Places are found in
   ranges (``operators.ranking``), not in one task.

Edge cases: a null or empty text and one without words have no feature and weight 0; they can't be drawn. Repeated rows are documents of their own, with equal
scores; ties go to the smaller doc_id, null ids last (their noise is that of an empty id). An empty table gives an empty result; an empty target leaves t = T = 0.
Texts of any length are counted whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import add_rank
from ..plans.durable import materialize

N_BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Lower-cases A-Z; all other ASCII characters but digits and a-z become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BLOCK, _LONGEST = 200, 64
_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _shifts() -> np.ndarray:
    """``[length, byte, value]``: what a byte of a CRC turns to when ``length`` more bytes follow, so that crc(a + b) = shift(crc(a)) ^ crc(b)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.zeros((_LONGEST + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _LONGEST + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_SHIFT = _shifts()


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def feature_buckets(docs: list[list[bytes]], n_buckets: int) -> Iterator[np.ndarray]:
    """The buckets of each document's features. Words are hashed once; a pair's CRC is combined from those of its words."""
    index: dict[bytes, int] = {}
    ids = [np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)) for ws in docs]
    own = np.fromiter((zlib.crc32(w) for w in index), np.uint32, len(index))
    after = np.fromiter((zlib.crc32(b" " + w) for w in index), np.uint32, len(index))
    length = np.fromiter((len(w) + 1 for w in index), np.int64, len(index))
    names = list(index)
    for x in ids:
        a, b = own[x[:-1]], x[1:]
        n = np.minimum(length[b], _LONGEST)
        pairs = after[b].copy()
        for byte in range(4):
            pairs ^= _SHIFT[n, byte, (a >> np.uint32(8 * byte)) & np.uint32(255)]
        for i in np.flatnonzero(length[b] > _LONGEST).tolist():
            pairs[i] = zlib.crc32(b" " + names[b[i]], int(a[i]))
        yield np.concatenate([own[x], pairs]) % np.uint32(n_buckets)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    for b in batches:
        texts = b.column(1).cast(pa.binary() if b.column(1).type == pa.string() else pa.large_binary())
        for at in range(0, len(b), _BLOCK):
            yield b.column(0)[at : at + _BLOCK].to_pylist(), [words(t.as_py()) for t in texts[at : at + _BLOCK]]


def bucket_counts(docs: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts of ``docs(doc_id, text)`` in each bucket that has any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for _, docs in _texts(batches):
            for x in feature_buckets(docs, n_buckets):
                total += np.bincount(x, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=_COUNTS)

    return docs.mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """The gain of each bucket; ``n_buckets`` rows at most come to the driver for each of both."""
    s, t = ([0] * n_buckets for _ in range(2))
    for counts, to in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():
            to[bucket] = n
    big_s, big_t = float(sum(s) + n_buckets), float(sum(t) + n_buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * big_s / ((a + 1.0) * big_t))) for a, b in zip(s, t, strict=True)], np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of numbers of 0 or more, a row for each bit, as 64-bit words."""
    bits = np.packbits((values[None, :] >> np.arange(int(values.max(initial=0)).bit_length())[:, None]) & 1, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


class SlicedGains:
    """Signed bit planes of the gains."""

    def __init__(self, gains: np.ndarray):
        plus, minus = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))
        self.planes = np.concatenate([plus, minus])
        self.powers = np.array([1 << k for k in range(len(plus))] + [-(1 << k) for k in range(len(minus))], np.int64)
        self.n = len(gains)

    def total(self, buckets: np.ndarray) -> int:
        """Sum of the gains of ``buckets``, each as often as it occurs."""
        out = 0
        for j, plane in enumerate(planes(np.bincount(buckets, minlength=self.n))):
            out += int(np.bitwise_count(plane & self.planes).sum(axis=1, dtype=np.int64) @ self.powers) << j
        return out


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of ``docs(doc_id, text)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = SlicedGains(gain)
        for ids, docs in _texts(batches):
            n = [max(0, 2 * len(ws) - 1) for ws in docs]
            w = [sliced.total(x) // len(x) if len(x) else 0 for x in feature_buckets(docs, sliced.n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, [len(ws) for ws in docs], n, w)], schema=_WEIGHTS)

    return docs.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; rank is null where it isn't drawn. Of N documents of ``min_words`` words or more, floor(percent * N / 100) are drawn."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text"))
    gain = gains(bucket_counts(texts, n_buckets), bucket_counts(wanted, n_buckets), n_buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = weigh(texts, gain).withColumns({"score": F.col("weight") + noise, "able": F.col("n_words") >= min_words})
    rows = materialize(rows, "weights")
    drawn = rows.filter("able").count() * percent // 100
    ranked = add_rank(rows, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")])
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
