"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lemmaflow.llm import importance
from tests.llm.test_llm import frame, odd_docs, text


def features(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target, n=10_000, percent=25):
    s = Counter(x % n for _, t in docs for x in features(t)[1])
    t = Counter(x % n for x in (y for d in target for y in features(d)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n)))) for b in range(n)]
    rows = []
    for i, d in docs:
        w, f = features(d)
        weight = sum(gain[x % n] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return sorted([r[:4] for r in rows], key=str), [(r[0], r[3]) for r in drawn]


def check(spark, docs, target, **options):
    got = importance.resample(frame(spark, [(i, t, None, None, 0) for i, t in docs]), spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()
    rows, drawn = brute(docs, target, options.get("n_buckets", 10_000))
    assert sorted([tuple(r)[:4] for r in got], key=str) == rows
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.doc_id, r.score) for r in ranked] == drawn


def test_weights_scores_and_places(spark):
    rng = random.Random(11)
    docs = [(i, text(rng, rng.randint(0, 90)).replace(" ", rng.choice([" ", ", ", "-Q ", "\n"]))) for i in range(300)]
    target = [text(rng, 40) for _ in range(30)] + [None, ""]
    check(spark, docs, target)
    check(spark, docs, target, n_buckets=97)  # no multiple of 8 or 64, many features to a bucket


def test_odd_documents(spark):
    docs = [(r[0], r[1]) for r in odd_docs()]
    docs += [(90, "x" * 500 + " " + "é" * 300 + " " + "y" * 63 + " " + "z" * 64 + " tail"), (91, "same " * 30_000), (91, "same " * 30_000), (92, "... !!! \x00 \x7f"), (None, "w " * 25), (93, "n b c 𝒳"), (94, "ab" * 100_000)]
    check(spark, docs, ["one two three", "same same é"])
    check(spark, docs, [])
    assert importance.resample(frame(spark, []), frame(spark, [])).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 5, 6, 7, 8)], "doc_id long, text string, rank long, weight long, able long, n_words long")
    assert importance.resample(docs, docs, percent=100).select("doc_id", "n_features", "rank").collect() == [(1, 59, 1)]


def test_sliced_sum_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 97, 10_000):
        gain = rng.integers(-20_000, 20_000, n)
        gain[:: 3] = 0
        x = rng.integers(0, n, 3000)
        x[:2000] = x[0]
        assert importance.SlicedGains(gain).total(x) == int(gain[x].sum())
    assert importance.SlicedGains(np.zeros(5, np.int64)).total(np.array([1, 2])) == 0


def test_draw_prefers_the_target(spark):
    """Half of the documents share the target's words; they are drawn more often."""
    rng = random.Random(2)
    sky = lambda: " ".join(rng.choice("sun moon star sky".split()) for _ in range(60))
    docs = [(i, text(rng, 60) if i % 2 else sky(), None, None, 0) for i in range(400)]
    got = importance.resample(frame(spark, docs), spark.createDataFrame([(sky(),) for _ in range(400)], "text string")).filter("rank is not null").collect()
    assert len(got) == 100 and sum(r.doc_id % 2 == 0 for r in got) > 90
