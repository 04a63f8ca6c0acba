"""Frequent sets, probes and shapes of proofs against plain Python."""

import itertools
import random
from collections import Counter

import pytest

from lemmaflow.operators import mining, proof, resolve
from lemmaflow.plans.durable import materialize


@pytest.mark.parametrize("support", [1, 4])
def test_frequent_sets(spark, support):
    r = random.Random(support)
    rows = [(t, p) for t in range(40) for p in r.sample("abcdefgh", r.randint(0, 6))] + [(99, p) for p in "abcdefgh"]
    got = {tuple(x["items"]): (x["size"], x.support) for x in mining.frequent_sets(spark.createDataFrame(rows, "theorem int, premise string"), support).collect()}
    by = [sorted(p for t, p in rows if t == n) for n in {t for t, _ in rows}]
    want = Counter(s for items in by for k in range(1, 6) for s in itertools.combinations(items, k))
    assert got == {s: (len(s), n) for s, n in want.items() if n >= support}
    two = mining.frequent_sets(spark.createDataFrame(rows, "theorem int, premise string"), support, 2)
    assert two.count() == sum(len(s) <= 2 and n >= support for s, n in want.items())


def test_frequent_sets_of_nothing(spark):
    assert mining.frequent_sets(spark.createDataFrame([], "theorem int, premise string"), 2).count() == 0


def test_frequent_sets_of_equal_theorems(spark, monkeypatch):
    """A hundred times the theorems, of the same sets, give no more occurrences; repeated rows count once, rows without a theorem or premise are only counted by themselves."""
    made = []
    monkeypatch.setattr(mining, "materialize", lambda df, name="stage": (lambda out: (made.append((name, out.count())), out)[1])(materialize(df, name)))
    for times in (1, 100):
        made.clear()
        rows = [(t, p) for i in range(times) for t, items in ((2 * i, "abc"), (2 * i + 1, "bcd")) for p in items] * 2 + [(None, "a"), (None, "b"), (0, None)]
        got = {tuple(x["items"]): x.support for x in mining.frequent_sets(spark.createDataFrame(rows, "theorem int, premise string"), 1).collect()}
        want = Counter(s for items in ("abc", "bcd") for k in range(1, 6) for s in itertools.combinations(items, k) for _ in range(times))
        assert got == want + Counter({("a",): 1, ("b",): 1, (None,): 1})
        assert max(n for name, n in made if name == "occurrences") <= 12


def test_probes(spark):
    r = random.Random(4)
    names = {".".join("".join(r.choice("abλ😀") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3))) for _ in range(150)}
    probes = {"".join(r.choice("abλ😀.") for _ in range(r.randint(1, 5))) for _ in range(120)} | set(list(names)[:9]) | {"zzz", "a%", "_"}
    want = set()
    for p in probes:
        kinds = {"exact": [n for n in names if n == p], "suffix": [n for n in names if n != p and n.endswith("." + p)]}
        kinds["contains"] = [n for n in names if p in n and n not in kinds["exact"] + kinds["suffix"]]
        want |= {(p, k, n) for k, hits in kinds.items() for n in sorted(hits, key=str.encode)[:10]}
    n = spark.createDataFrame([(x,) for x in [*names, "", None]], "full_name string")
    found = resolve.probe_all(n, spark.createDataFrame([(x,) for x in [*probes, *probes, "", None]], "probe string"))
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert resolve.probe_all(n, spark.createDataFrame([], "probe string")).count() == 0
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def shape(edges):
    """The measures of one proof."""
    nodes, kids = sorted({x for e in edges for x in e}), {}
    for a, b in edges:
        kids.setdefault(a, []).append(b)
    roots = [n for n in nodes if n not in {b for _, b in edges}]
    at = {(roots or nodes)[0]: 0}
    queue = list(at)
    for n in queue:
        for m in kids.get(n, []):
            if m not in at:
                at[m] = at[n] + 1
                queue.append(m)
    widths, out, n = Counter(at.values()), [len(kids.get(x, [])) for x in nodes], len(nodes)
    depth, mean = max(widths), len(edges) / n
    numbers = (mean, out.count(0) / n, (depth + 1) / n, sum((o - mean) ** 2 for o in out) / n)
    return (n, depth, sorted(at.values())[len(at) // 2], max(widths.values()), widths[depth // 2], *(pytest.approx(x, abs=1e-5) for x in numbers))


@pytest.mark.parametrize("small", [0, 20, 256])
def test_tree_metrics(spark, small):
    """Trees, graphs with cycles, several roots and repeated edges; in one row, in rounds, and some of both."""
    r = random.Random(small)
    proofs = {t: [(r.randrange(k), r.randrange(k + 1)) for _ in range(r.randint(1, 2 * k))] for t, k in enumerate([1, 2, 3, 5, 8, 12, 20, 12, 8, 5])}
    proofs |= {50: [(i, i + 1) for i in range(30)], 51: [(0, i) for i in range(1, 40)], 52: [(i // 2, i) for i in range(1, 60)], 53: [(0, 1), (0, 1), (1, 0)]}
    e = spark.createDataFrame([(t, a, b) for t, p in proofs.items() for a, b in p], "theorem int, src int, dst int")
    names = ["n_nodes", "depth", "median_depth", "max_width", "width_at_half_depth", "mean_out", "leaf_share", "spine_score", "imbalance"]
    got = {x.theorem: tuple(x[c] for c in names) for x in proof.tree_metrics(e, small).collect()}
    assert got == {t: shape(p) for t, p in proofs.items()}
    assert proof.tree_metrics(e.limit(0), small).count() == 0


def test_match_rate(spark):
    corpus = spark.createDataFrame([(0, "A.b.c"), (1, "c"), (2, "D.c"), (3, "e")], "seq int, full_name string")
    texts = ["theorem c : P", "lemma b.c (x) : P", "private theorem A.b.c{x}", "def x : P", "def x(y)", "@[simp] lemma y := z", " : P", "", None, "theorem A.b : P"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, statement string")
    got = {(r.measure, r.name): (r.n, r.percent) for r in resolve.match_rate(rows, corpus, k=2).collect()}
    assert got == {("matched", None): (3, 30.0), ("failed", None): (7, 70.0), ("failed_name", ""): (3, 42.8571), ("failed_name", "x"): (2, 28.5714)}
    assert sum(r.n for r in resolve.match_rate(rows, corpus, n=4).collect() if r.name is None) == 4
    assert resolve.match_rate(rows.limit(0), corpus).count() == 0
    refs = spark.createDataFrame([(1, "c"), (2, "b.c"), (3, "b"), (4, "A.b.c")], "ref_id int, surface string")
    assert {tuple(r) for r in resolve.suffix_match(refs, corpus).collect()} == {(1, "A.b.c"), (2, "A.b.c"), (4, "A.b.c")}
