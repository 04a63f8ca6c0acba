"""Masks of many starts against plain searches, over several batches."""

import random
from collections import Counter

import pytest

from lemmaflow.operators import loops, masks


@pytest.fixture(scope="module")
def graph():
    """Two far copies of a random acyclic graph, and a chain; more nodes than a batch has bits."""
    rng = random.Random(11)
    one = {tuple(sorted(rng.sample(range(600), 2))) for _ in range(1000)}
    return sorted(one | {(a + 5000, b + 5000) for a, b in one} | {(9000 + k, 9001 + k) for k in range(6)})


def below(pairs):
    to, out = {}, {}
    for a, b in pairs:
        to.setdefault(a, []).append(b)
        to.setdefault(b, [])
    for x in sorted(to, reverse=True):
        out[x] = set(to[x]).union(*(out[y] for y in to[x]))
    return out


def test_relatives_are_stored_as_masks(spark, graph):
    assert len({x for e in graph for x in e}) > 64 * masks.WIDE
    e = spark.createDataFrame(graph, "src long, dst long")
    want = {(a, b) for a, bs in below(graph).items() for b in bs}
    place = masks.places(loops.nodes(e))
    stored = masks.reached(e, place)
    assert 4 * stored.count() < len(want), "a row stands for many pairs"
    got = Counter(map(tuple, loops.relatives(e).collect()))
    assert got == Counter([(a, b, "descendant") for a, b in want] + [(b, a, "ancestor") for a, b in want])


def test_cycles_reach_themselves(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    place = masks.places(loops.nodes(e))
    assert {tuple(r) for r in masks.pairs(masks.reached(e, place), place).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}


def test_impacts_of_all_nodes(spark, graph):
    e = spark.createDataFrame(graph, "src long, dst long")
    plain = sorted(map(tuple, loops.removal_impact(e, loops.nodes(e)).collect()))
    assert sorted(map(tuple, loops.removal_impacts(e).collect())) == plain and len({r[2] for r in plain}) > 10


def test_distances_of_all_pairs(spark, graph):
    near = {}
    for a, b in graph:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    parts, far = [], []
    for s in near:
        hops, front = {s: 0}, [s]
        while front:
            front = [y for y in {y for x in front for y in near[x]} if y not in hops and not hops.update({y: hops[front[0]] + 1})]
        parts.append(set(hops))
        far.append((s, hops.values()))
    most = max(parts, key=lambda p: (len(p), -min(p)))
    found = [h for s, hs in far if s in most for h in hs if h]
    r = loops.path_statistics(spark.createDataFrame(graph, "src long, dst long")).first()
    assert (r.mean_path, r.diameter, r.pairs) == (round(sum(found) / len(found), 6), max(found), len(found))


def test_rounds_end_with_the_last_pair(spark, monkeypatch):
    """Once all pairs of the component are met, nothing more is sent: as many rounds as the diameter."""
    rounds, plain = [], masks.materialize
    monkeypatch.setattr(masks, "materialize", lambda df, name: (rounds.append(name), plain(df, name))[1])
    r = loops.path_statistics(spark.createDataFrame([(i, i + 1) for i in range(4)] + [(10, 11)], "src long, dst long")).first()
    assert (r.mean_path, r.diameter, r.pairs) == (2.0, 4, 20)
    assert rounds.count("hops") == 4
