"""Min-max hashing against all pairs."""

import random

import numpy as np

from lemmaflow.llm import minmax
from lemmaflow.llm.text import ascii_words, shingle_hashes
from lemmaflow.plans.durable import materialize
from tests.llm.test_llm import brute_components, frame, odd_docs, text

TWO = "doc_id long, text string"


def found(spark, rows, **options):
    got = minmax.components(frame(spark, rows, TWO), **options).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_matches_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(220):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9999))
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, text(rng, rng.randint(1, 90))))
    w = text(rng, 100).split()  # a chain of copies: neighbours link, the ends don't
    for i in range(300, 350):
        rows.append((i, " ".join(w)))
        for j in rng.sample(range(100), 3):
            w[j] = f"c{i}_{j}"
    rng.shuffle(rows)
    assert found(spark, rows, k=2, percent=80) == brute_components(rows, 2, 80)


def test_many_edited_copies(spark):
    """Copies of one text of which many, few or all pairs link, and copies of one of its copies; all meet in the same buckets."""
    rng = random.Random(22)
    base, rows = text(rng, 150).split(), []
    sub = [f"s{i}" if i % 12 == 0 else w for i, w in enumerate(base)]
    for i in range(700):
        w = list(base if i % 3 else sub)
        for j in rng.sample(range(150), rng.randint(5, 9)):
            w[j] = f"y{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows, k=2, percent=80) == brute_components(rows, 2, 80)


def test_odd_rows(spark):
    docs = odd_docs()
    rows = minmax.components(frame(spark, docs), k=2, percent=80).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2 and by[0].kept
    assert by[3].n_shingles == 1 and by[4].n_shingles == 2 and by[6].component_id == by[8].component_id == by[7].component_id == 5
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = [r.doc_id for r in minmax.keep_one(frame(spark, docs), k=2).collect()]
    assert kept.count(5) == 2 and 6 not in kept and 7 not in kept and kept.count(None) == 2
    assert minmax.components(frame(spark, [])).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(6)
    a = text(rng, 20_000)
    b = a.replace(a.split()[700], "changed")
    rows = [(1, a), (2, b), (3, "x" * 200_000), (4, "x" * 200_000), (5, "same " * 50_000), (6, "same " * 40_000)]
    assert found(spark, rows, k=2, percent=80) == brute_components(rows, 2, 80)


def test_clashing_columns(spark):
    docs = frame(spark, [(1, "a b c", 5, "x", 3, True), (2, "a b c", 6, "y", 4, False)], TWO + ", class_id long, key string, n long, kept boolean")
    assert sorted(map(tuple, minmax.components(docs, k=2).collect())) == [(1, 2, 1, 1, True), (2, 2, 1, 1, False)]
    assert [tuple(r) for r in minmax.keep_one(docs, k=2).collect()] == [(1, "a b c", 5, "x", 3, True)]


def test_both_ends_of_a_permutation_estimate_the_similarity():
    """Least and largest values agree as often as the sets are alike, and bands of both find what a similarity of 0.8 asks for."""
    rng = random.Random(8)
    hits, met, pairs = [], 0, 200
    for _ in range(pairs):
        w = [f"w{rng.randint(0, 10**9)}" for _ in range(180)]
        a, b = shingle_hashes(ascii_words(" ".join(w[:160])), 1), shingle_hashes(ascii_words(" ".join(w[20:])), 1)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        least, most = minmax.signatures([a, b], 64)
        hits.append([(least[0] == least[1]).mean() - j, (most[0] == most[1]).mean() - j])
        keys = minmax.band_keys(least, most)
        met += bool((keys[0] == keys[1]).any())
    assert np.abs(np.mean(hits, axis=0)).max() < 0.01 and met == pairs


def test_copies_just_below_the_link_leave_few_rows(spark, monkeypatch):
    """Copies that differ from their original by a little too much share only chance elements with each other: few of these go on to a second round, and elements grow with the copies."""
    made = {}

    def counting(df, name="stage", about_rows=None):
        out = materialize(df, name, about_rows)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minmax.jaccard, "materialize", counting)
    rng, totals = random.Random(5), []
    base = [f"b{i}" for i in range(200)]
    for copies in (100, 200):
        made.clear()
        rows = [(0, " ".join(base))]
        for i in range(1, copies + 1):
            w = list(base)
            for j in rng.sample(range(1, 199, 2), 12):  # 24 of 199 bigrams go and 24 come: 175 of 223
                w[j] = f"y{rng.randint(0, 60)}"
            rows.append((i, " ".join(w)))
        assert found(spark, rows, k=2, percent=80) == brute_components(rows, 2, 80)
        assert made["buckets"] <= 8 * copies and made["elements"] <= 100 * copies
        totals.append(made["elements"])
    assert totals[1] <= 2.1 * totals[0]


def test_connected_copies_leave_no_elements(spark, monkeypatch):
    """What differs between copies that are connected by their original isn't listed again; texts that share a passage only are judged by the first of their elements."""
    made = {}

    def counting(df, name="stage", about_rows=None):
        out = materialize(df, name, about_rows)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minmax.jaccard, "materialize", counting)
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(1, 199, 2), 0 if i == 0 else 5 if i % 30 else 14):  # 10 of 199 bigrams go and 10 come, or 28
            w[j] = f"y{rng.randint(0, 60)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(100)]
    rows += [(1000 + i, " ".join(passage + [f"w{rng.randint(0, 5000)}" for _ in range(100)])) for i in range(150)]
    assert found(spark, rows, k=2, percent=80) == brute_components(rows, 2, 80)
    assert made["live"] > 300  # large buckets of both kinds
    assert made["elements"] <= 10 * 300
