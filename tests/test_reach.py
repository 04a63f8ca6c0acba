"""Sets of reachable nodes as bits, against plain sets."""

import random

from lemmaflow.operators import features, loops, reach


def members(sets, place):
    of = {}
    for r in place.collect():
        of.setdefault((r["at"], r.word), []).append((r.bit, r.id))
    out = {}
    for r in sets.collect():
        out.setdefault(r.id, set()).update(x for bit, x in of[r["at"], r.word] if bit & r.bits)
    return out


def below_of(pairs, n):
    below = {x: set() for x in range(n)}
    for a, b in sorted(pairs, reverse=True):
        below[a] |= {b} | below[b]
    return below


def layered(rng, layers, width, k):
    return sorted({((i - 1) * width + rng.randrange(width), i * width + x) for i in range(1, layers) for x in range(width) for _ in range(k)})


def test_bits_are_the_closure(spark):
    rng = random.Random(4)
    pairs = layered(rng, 5, 150, 3)
    e = spark.createDataFrame(pairs, "src long, dst long")
    depth = loops.kahn_rounds(e)
    place = reach.places(depth).persist()
    down = reach.descendants(e, place)
    below = below_of(pairs, 750)
    assert members(down, place) == {x: s for x, s in below.items() if s}
    above = {}
    for x, s in below.items():
        for y in s:
            above.setdefault(y, set()).add(x)
    assert members(reach.ancestors(e, depth, place), place) == above
    assert down.count() * 5 < sum(map(len, below.values()))  # words, not members
    ends = {x for p in pairs for x in p}
    got = {r.id: r for r in features.masked(e, depth, down, place).collect()}
    assert set(got) == ends
    for x in ends:
        assert got[x].n_masked == len(below[x]) and got[x].n_seen_edges == sum(a not in below[x] and b not in below[x] for a, b in pairs)
        left = [sum(c != x and c not in below[x] for a, c in pairs if a == p) for p, y in pairs if y == x]
        assert got[x].masked_outdeg_sum == sum(left) and got[x].masked_outdeg_max == max(left, default=0)


def test_no_edges_and_one(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert reach.descendants(none, reach.places(loops.kahn_rounds(none))).count() == 0
    one = spark.createDataFrame([(7, 9)], "src long, dst long")
    place = reach.places(loops.kahn_rounds(one))
    assert members(reach.descendants(one, place), place) == {7: {9}}
