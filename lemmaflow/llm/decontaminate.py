"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

Index. A test item is split at its last sentence into question and answer (an item of one sentence is all question). Its terms are weighted by BM25
(k1, b, idf over the items) and the weights are divided by the least score that any stretch of ``stride`` words of the item gets, so that a passage
that holds the item, or ``stride`` words of it, scores 1 or more. Postings are sorted by item and kept in blocks with their largest weight.

Search. Each document is cut into passages of ``2 * stride`` words, one every ``stride`` words, so that any stretch of ``stride`` words lies within a
passage. Every passage is a query; all items of a score of ``threshold`` or more are retrieved. Items are ordered by length and cut into ranges; the
largest weights of a passage's terms within each range are summed first, for all passages of a document at once. Where that bound
can't reach the threshold the range is skipped; the others go through block-max WAND.

Verification. A retrieved item counts as leaked if the document holds at least ``min_question`` of the distinct word ``gram``-grams of its question and
``min_answer`` of those of its answer (shorter texts count as one gram). One edited word takes up to ``gram`` grams, which are all that a short side has.
So an item also counts as leaked if, around a retrieved passage, three quarters of its words stand in their order (shifted against each other by at most three eighths of
the item's length), among them ``min_question`` of the question's and ``min_answer`` of the answer's; one word of either may always lack. Items of
three words or fewer must be whole. Overlaps are shares of grams where these suffice, else of words in order.

Test items are read in blocks of ``block_items``, with the idf and the mean length of all items, so decisions don't depend on the blocks: only one block's index is at the driver and in a task at a time, and the
documents are searched for each block. No document is shuffled; documents with a third of all rows in common are no matter.

Edge cases: words are runs of letters, digits and underscores, lower-cased. Null or empty texts and items, and items without a word, leak nothing.
Repeated items are found each under their id; repeated documents give equal rows. Null ids are kept. An empty table gives an empty
result. Texts of any length are searched whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialize

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)|\n+(?=\S)")
STRIDE, THRESHOLD, MIN_QUESTION, MIN_ANSWER, GRAM, BLOCK, RANGES, BLOCK_ITEMS = 32, 0.5, 0.6, 0.5, 5, 8, 48, 20_000
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    for at in reversed(ends):
        if words(text[at:]) and words(text[:at]):
            return words(text[:at]), words(text[at:])
    return words(text), []


def grams(ws: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


@dataclass
class Index:
    items: list[int | None] = field(default_factory=list)
    questions: list[set] = field(default_factory=list)
    answers: list[set] = field(default_factory=list)
    texts: list[tuple[list[str], int]] = field(default_factory=list)  # words of each item, how many are the question's
    terms: dict[str, int] = field(default_factory=dict)
    docs: list[list[int]] = field(default_factory=list)  # postings of each term: item numbers, rising
    weights: list[list[float]] = field(default_factory=list)
    tops: list[list[float]] = field(default_factory=list)  # largest weight of each block
    upper: list[float] = field(default_factory=list)  # largest weight of each term
    edges: list[int] = field(default_factory=list)  # first items of the ranges, and the number of items
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # largest weight of each term in each range


def build_index(rows: list[tuple[int | None, str | None]], stride: int = STRIDE, k1: float = 1.2, b: float = 0.75, gram: int = GRAM, whole: tuple[int, float, dict[str, int]] | None = None) -> Index:
    """``whole`` has number, mean length and document frequencies of all items, if ``rows`` are a block of them."""
    x, bags = Index(), []
    split = [(item_id, *question_and_answer(text or "")) for item_id, text in rows]
    for item_id, q, a in sorted((r for r in split if r[1]), key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        x.items.append(item_id)
        x.questions.append(grams(q, gram))
        x.answers.append(grams(a, gram))
        bags.append(q + a)
        x.texts.append((q + a, len(q)))
    n, mean = len(bags), sum(map(len, bags)) / max(1, len(bags))
    df = Counter(t for ws in bags for t in set(ws))
    n_all, mean, df_all = whole or (n, mean, df)
    x.terms = {t: i for i, t in enumerate(df)}
    x.docs, x.weights = [[] for _ in df], [[] for _ in df]
    idf = {t: math.log(1 + (n_all - df_all[t] + 0.5) / (df_all[t] + 0.5)) for t in df}
    for i, ws in enumerate(bags):
        norm = k1 * (1 - b + b * len(ws) / mean)
        w = {t: idf[t] * c * (k1 + 1) / (c + norm) for t, c in Counter(ws).items()}
        # A passage is a set of terms; the weakest stretch of the item sets the scale.
        scale = min(sum(w[t] for t in set(ws[s : s + stride])) for s in range(max(1, len(ws) - stride + 1)))
        for t, v in w.items():
            x.docs[x.terms[t]].append(i)
            x.weights[x.terms[t]].append(v / scale)
    x.tops = [[max(ws[i : i + BLOCK]) for i in range(0, len(ws), BLOCK)] for ws in x.weights]
    x.upper = [max(t) for t in x.tops]
    ranges = max(1, min(RANGES, n))
    x.edges = [n * i // ranges for i in range(ranges + 1)]
    of = np.searchsorted(x.edges, np.arange(n), "right") - 1
    x.bounds = np.zeros((len(df), ranges), np.float32)
    for t, (docs, ws) in enumerate(zip(x.docs, x.weights, strict=True)):
        np.maximum.at(x.bounds[t], of[docs], np.array(ws, np.float32))
    return x


def wand(x: Index, query: list[int], threshold: float, first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
    """The items from ``first`` to before ``end`` whose weights over the terms of ``query`` sum to ``threshold`` or more, by block-max WAND."""
    end = len(x.items) if end is None else end
    starts = ((t, bisect_left(x.docs[t], first)) for t in query)
    cursors = [[x.docs[t][at], t, at] for t, at in starts if at < len(x.docs[t]) and x.docs[t][at] < end]
    out = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for i, (_, t, _) in enumerate(cursors):
            bound += x.upper[t]
            if bound >= threshold:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # Block bounds of the lists up to the pivot, at the pivot's item.
        bound, next_item = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
        for _, t, at in cursors[: pivot + 1]:
            docs = x.docs[t]
            block = at // BLOCK
            while (block + 1) * BLOCK <= len(docs) and docs[(block + 1) * BLOCK - 1] < item:
                block += 1
            if block < len(x.tops[t]):
                bound += x.tops[t][block]
                next_item = min(next_item, docs[min((block + 1) * BLOCK, len(docs)) - 1] + 1)
        if bound >= threshold:
            if cursors[0][0] == item:
                score = sum(x.weights[t][at] for _, t, at in cursors[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                goal = item + 1
            else:
                goal = item
        else:
            goal = max(next_item, item + 1)
        for c in cursors[: pivot + 1]:
            docs, at = x.docs[c[1]], c[2]
            while at < len(docs) and docs[at] < goal:
                at += 1
            c[0], c[2] = (docs[at] if at < len(docs) else end), at
        cursors = [c for c in cursors if c[0] < end]
    return out


def in_order(item: list[str], n_question: int, region: list[str], min_question: float, min_answer: float) -> tuple[float, float] | None:
    """Shares of the question's and the answer's words that stand in order in one stretch of ``region``, if they and the whole are enough.

    Longest common subsequences by bit vectors: bit i of ``v`` is 0 where one more word of the item up to i can be placed. The stretches are bands of shifts (place in the region minus
    place in the item), ``lack + step`` wide, one every ``step``, so the work is the region's length times a constant, for any vocabulary."""
    n, n_answer = len(item), len(item) - n_question
    lack, step = n // 4, max(1, n // 8)
    need, need_q = n - lack, min(n_question - 1, math.ceil(min_question * n_question))
    need_a = max(0, min(n_answer - 1, math.ceil(min_answer * n_answer)))
    if need_q < 0:
        return None
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(item):
        at[w] |= 1 << i
    rows = [(j, at[w]) for j, w in enumerate(region) if w in at]
    places = [j for j, _ in rows]
    width = lack + step - 1
    band, whole, question = (1 << (width + 1)) - 1, (1 << n) - 1, (1 << n_question) - 1
    for low in range(-(width // step) * step, len(region) - need + 1, step):
        inside = rows[bisect_left(places, low) : bisect_left(places, low + width + n)]
        if len(inside) < need:
            continue
        v, alone = whole, whole ^ question  # of the whole item, of the answer alone
        for j, m in inside:
            shift = j - low - width
            m &= band << shift if shift >= 0 else band >> -shift
            u = v & m
            v = (v + u | v - u) & whole
            u = alone & m
            alone = (alone + u | alone - u) & whole
        q, a = n_question - (v & question).bit_count(), n_answer - (alone & ~question).bit_count()
        if n - v.bit_count() >= need and q >= need_q and a >= need_a:
            return q / n_question, a / n_answer if n_answer else 1.0
    return None


def search(x: Index, text: str, stride: int, threshold: float, min_question: float, min_answer: float, gram: int) -> list[tuple[int | None, float, float, float]]:
    """Leaked items of one text: (item_id, best score, question overlap, answer overlap)."""
    ws = words(text)
    ids = np.fromiter(map(x.terms.get, ws, _minus_one), dtype=np.int64, count=len(ws)) if len(ws) < len(_minus_one) else np.array([x.terms.get(w, -1) for w in ws], np.int64)
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return []
    # Bounds of each stretch of ``stride`` words, over its distinct terms; a passage is two stretches.
    keys = np.unique(known // stride * len(x.terms) + ids[known])
    part, term = np.divmod(keys, len(x.terms))
    n = max(1, -(-len(ws) // stride))
    bounds = np.zeros((n + 1, x.bounds.shape[1]), np.float32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    bounds[part[first]] = np.add.reduceat(x.bounds[term], first, axis=0)
    best: dict[int, float] = {}
    places: dict[int, list[int]] = defaultdict(list)
    for p, r in np.argwhere(bounds[:-1] + bounds[1:] >= threshold - 1e-4).tolist():
        query = np.unique(term[np.searchsorted(part, p) : np.searchsorted(part, p + 1, "right")]).tolist()
        for item, score in wand(x, query, threshold, x.edges[r], x.edges[r + 1]):
            best[item] = max(best.get(item, 0.0), score)
            places[item].append(p)
    if not best:
        return []
    have = grams(ws, gram)
    # Texts shorter than a gram count as one gram of their own length.
    by_length = {gram: have}

    def share(need: set) -> float:
        if not need:
            return 1.0
        n = len(next(iter(need)))
        if n not in by_length:
            by_length[n] = grams(ws, n)
        return len(need & by_length[n]) / len(need)

    out = []
    for item, score in sorted(best.items()):
        q, a = share(x.questions[item]), share(x.answers[item])
        if q < min_question or a < min_answer:
            item_words, n_question = x.texts[item]
            around: list[list[int]] = []  # regions that overlap are one
            for p in sorted(set(places[item])):
                first, end = max(0, p * stride - len(item_words)), (p + 2) * stride + len(item_words)
                if around and first <= around[-1][1]:
                    around[-1][1] = end
                else:
                    around.append([first, end])
            q, a = next(filter(None, (in_order(item_words, n_question, ws[first:end], min_question, min_answer) for first, end in around)), (-1.0, -1.0))
        if q >= 0:
            out.append((x.items[item], round(score, 6), round(q, 6), round(a, 6)))
    return out


_minus_one = [-1] * 100_000


def _hash(item_id: int | None, text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{item_id} {text}".encode("utf-8", "surrogatepass")) >> 1


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(map(_hash, ids, texts), pa.int64())], ["item_id", "text", "k"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, length and distinct terms of each item that has words."""
    for b in batches:
        rows = [(_hash(i, t), len(ws), sorted(set(ws))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (ws := words(t or ""))]
        yield pa.RecordBatch.from_pylist([dict(zip(("k", "n", "terms"), r, strict=True)) for r in rows], schema=pa.schema([("k", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string()))]))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", stride: int = STRIDE, threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER, gram: int = GRAM, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of each test item that a document leaks."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    blocks = -(-tests.count() // block_items)
    out = spark.createDataFrame([], DDL)
    if blocks > 1:  # idf and mean length are those of all items
        bags = materialize(tests.mapInArrow(_bags, "k long, n long, terms array<string>").withColumn("block", F.pmod("k", F.lit(blocks))), "item-terms")
        n_all, total = bags.agg(F.count("*"), F.sum("n")).first()
        df = materialize(bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("d")), "item-df")
    for k in range(blocks):
        own, whole = tests, None
        if blocks > 1:
            own = tests.mapInArrow(_with_hash, "item_id long, text string, k long").filter(F.pmod("k", F.lit(blocks)) == k).select("item_id", "text")
            terms = bags.filter(F.col("block") == k).select(F.explode("terms").alias("term")).distinct()
            whole = n_all, total / max(1, n_all), dict(df.join(terms, "term").select("term", "d").collect())  # the terms of one block
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in own.collect()], stride, gram=gram, whole=whole))  # about block_items items

        def task(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                rows = [(i, *found) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if (s := t.as_py()) for found in search(x, s, stride, threshold, min_question, min_answer, gram)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        found = texts.mapInArrow(task, DDL)
        out = found if k == 0 else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that leak no test item; rows with a null id stay."""
    return docs.join(leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")
