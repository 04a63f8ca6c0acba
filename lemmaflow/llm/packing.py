"""Best-fit packing by a configuration linear program over the length histogram.

1. Documents are encoded and cut into pieces of at most ``capacity`` tokens; only lengths go on.
2. The histogram of lengths (at most ``capacity`` rows, whatever the data) goes to the driver. A configuration is a multiset of lengths
   that fits a sequence. The covering LP (fewest configurations that cover the histogram) is solved by multiplicative weights: a knapsack by dynamic
   programming over all lengths prices configurations, the best ones are taken, and the prices of lengths move with their cover (``solve``).
3. The mean of the iterations is rounded, most taken configurations first; what is left goes through the program again, up to ROUNDS times, and the rest by
   best fit in falling order; the round after which the whole is shortest counts. ``solved`` gives the share of both and the lower bound.
4. Pieces get a rank within their length without any large group: each length is cut into hash buckets, counts of the buckets are summed up,
   and rows are numbered within a bucket. A rank then names the sequence and the offset by a binary search in the table of
   configurations.

The driver's work depends on the number of distinct lengths, not of documents.

Edge cases: a null or empty text is one piece with the end id alone. Rows that share an id are packed each (their pieces are numbered
alike). An empty table gives an empty result. A null doc_id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize
from . import pieces

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first
ITERATIONS, ROUNDS, BUCKET_ROWS, NEAR, NOISE, ETA = 20, 12, 2000, 0.998, 1e-3, 0.05
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces.encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, enc.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, PIECES_DDL)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room from 0 to ``capacity`` the greatest value of a multiset of lengths that fits, and the place of one of its lengths (-1: nothing fits).

    ``lengths`` are rising; of equally good ones the longest is taken."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fall, worth = np.ascontiguousarray(lengths[::-1]), np.ascontiguousarray(values[::-1])
    firsts = len(lengths) - np.searchsorted(lengths, np.arange(capacity + 1), "right")  # the first of ``fall`` that fits
    for room in range(int(lengths[0]), capacity + 1):
        at = firsts[room]
        with_it = best[room - fall[at:]] + worth[at:]
        k = int(with_it.argmax())
        if with_it[k] > best[room - 1]:
            best[room], choice[room] = with_it[k], len(lengths) - 1 - at - k
        else:
            best[room], choice[room] = best[room - 1], -1
    return best, choice


def columns(lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int, near: float) -> tuple[float, list[tuple[tuple[int, int], ...]]]:
    """The greatest value of a configuration, and for each length the most valuable configuration with it (as (place, copies) pairs), if its value
    is at least ``near`` of the greatest and it holds no more copies than there are."""
    best, choice = knapsack(lengths, values, capacity)
    out = {}
    for i in np.flatnonzero(values + best[capacity - lengths] >= near * best[capacity]).tolist():
        held, room = {i: 1}, capacity - int(lengths[i])
        while room > 0:
            j = int(choice[room])
            if j < 0:
                room -= 1
                while room > 0 and choice[room] < 0:
                    room -= 1
                continue
            held[j] = held.get(j, 0) + 1
            room -= int(lengths[j])
        if all(counts[j] >= n for j, n in held.items()):
            out[tuple(sorted(held.items()))] = None
    return float(best[capacity]), list(out)


def solve(histogram: dict[int, int], capacity: int, iterations: int = ITERATIONS, near: float | None = None, eta: float | None = None) -> tuple[dict[Config, float], float]:
    """A fractional solution of the covering LP by multiplicative weights, and the best lower bound on the number of sequences its prices have given.

    Prices start in proportion to the lengths. Each iteration prices configurations by the knapsack over all lengths, shares the sequences out among the
    best ones by what their scarcest length allows, and multiplies prices down where lengths were covered more than needed and up where less. The mean over the iterations is
    the solution; total price of all lengths over the greatest price of a configuration is the dual bound."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    price = lengths / capacity
    near, eta = near or NEAR, eta or ETA
    bound, total, spread = 0.0, Counter(), np.random.default_rng(0)
    for _ in range(iterations):
        # A little noise picks other ones of many equally good configurations; the bound holds for any prices.
        noisy = price * (1 + NOISE * spread.random(len(lengths)))
        top, found = columns(lengths, need, noisy, capacity, near)
        bound = max(bound, float(need @ noisy) / top)
        if not found:
            break
        room = np.array([min(need[i] / n for i, n in c) for c in found])
        share, cover = bound * room / room.sum(), np.zeros(len(lengths))
        for c, x in zip(found, share.tolist(), strict=True):
            total[c] += x
            for i, n in c:
                cover[i] += n * x
        price = price * np.exp(-eta * np.clip(cover / need - 1, -1, 1))
        price /= price.max()
    return {tuple((int(lengths[i]), n) for i, n in reversed(c)): x / iterations for c, x in total.items()}, bound


def rounded(solution: dict[Config, float], histogram: dict[int, int], least: float = 0) -> tuple[list[tuple[Config, int]], dict[int, int]]:
    """Whole numbers of the configurations, those taken most first: rounded up as far as what is left of each length allows. And what is left of the histogram.
    Configurations of fewer than ``least`` tokens aren't taken."""
    left, out = dict(histogram), []
    for config, x in sorted(solution.items(), key=lambda t: (-t[1], t[0])):
        n = min(math.ceil(x - 1e-9), *(left.get(length, 0) // k for length, k in config))
        if n > 0 and sum(length * k for length, k in config) >= least:
            out.append((config, n))
            for length, k in config:
                left[length] -= n * k
    return out, {length: n for length, n in left.items() if n}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit in falling order on counts: alike sequences are filled together."""
    open_: dict[int, list[list]] = {}  # room -> groups [contents, number]
    rooms: list[int] = []  # sorted
    from bisect import bisect_left, insort

    def add(room: int, contents: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([contents, n])

    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = min(capacity // length, n)
                whole, rest = divmod(n, each)
                add(capacity - each * length, (length,) * each, whole)
                if rest:
                    add(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[i]
            group = open_[room][-1]
            k = min(n, group[1])
            group[1] -= k
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            add(room - length, (*group[0], length), k)
            n -= k
        for c, k in open_.pop(0, []):
            done.append((c, k))
        if rooms and rooms[0] == 0:
            rooms.pop(0)
    done += [(c, k) for groups in open_.values() for c, k in groups]
    return [(tuple(sorted(Counter(c).items(), reverse=True)), k) for c, k in done]


def plan(histogram: dict[int, int], capacity: int, iterations: int = ITERATIONS, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Configurations with the number of sequences each is used for; together they hold the histogram exactly."""
    return solved(histogram, capacity, iterations, rounds)[0]


def solved(histogram: dict[int, int], capacity: int, iterations: int = ITERATIONS, rounds: int = ROUNDS) -> tuple[list[tuple[Config, int]], int, float]:
    """The plan, how many of its sequences come from the rounded program (the others from best fit), and the lower bound on sequences."""
    left, out = dict(histogram), []
    if full := left.pop(capacity, 0):
        out.append((((capacity, 1),), full))
    bound = -(-sum(length * n for length, n in histogram.items()) // capacity)
    found, least = [], capacity
    for k in range(rounds):
        if not left:
            break
        solution, dual = solve(left, capacity, iterations)
        if k == 0:
            bound = max(bound, full + math.ceil(dual - 1e-6))
        taken, left = rounded(solution, left, least)
        out = out + taken
        rest = best_fit(left, capacity)
        found.append((sum(n for _, n in out + rest), -k, out, rest))
        if not taken and least < capacity:
            break
        # Full configurations first; where there are no more, those that waste little.
        least = capacity if taken and least == capacity else capacity * NEAR
    _, _, out, rest = min(found, key=lambda t: t[:2]) if found else (0, 0, out, [])
    return out + rest, sum(n for _, n in out), bound


def place(parts: DataFrame, capacity: int, **options) -> DataFrame:
    """``parts`` (a stored table with doc_id, piece, length) with sequence_id and offset."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    keys, bases, offsets, starts = [], [], [], []
    used: Counter = Counter()
    sequence = 0
    for config, n in plan(histogram, capacity, **options):
        at = 0
        for length, copies in config:
            for _ in range(copies):
                keys.append((length << 44) + used[length])
                starts.append(used[length])
                bases.append(sequence)
                offsets.append(at)
                used[length] += n
                at += length
        sequence += n
    order = np.argsort(np.array(keys, np.int64))
    runs = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (keys, starts, bases, offsets)])  # a row for each length of each configuration

    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("rank"))
    ranked = ranked.select(*parts.columns, "rank")
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, starts_, bases_, offsets_ = runs.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            i = np.searchsorted(keys_, (length << 44) + rank, "right") - 1
            columns = [b.column(n) for n in _PIECES.names] + [pa.array(bases_[i] + rank - starts_[i]), pa.array(offsets_[i])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return ranked.mapInArrow(task, PIECES_DDL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, **options) -> DataFrame:
    return place(materialize(encode_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, **options)
