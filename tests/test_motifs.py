import random
from itertools import combinations, permutations

from lemmaflow.operators import motifs
from lemmaflow.plans.durable import shared_dir


def _flow(seed, forward):
    r = random.Random(seed)
    pairs = {(a, b) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(16)) if a < b or (not forward and a != b)}
    return [(a, b, r.choice(["goal", "hyp"])) for a, b in sorted(pairs)]


def _joined(edges, a, b, inside):
    """Whether b is reached from a through steps outside the set, one at least."""
    seen, front = set(), {y for x, y, _ in edges if x == a and y not in inside}
    while front - seen:
        seen |= front
        front = {y for x, y, _ in edges if x in front and y not in inside}
    return any(x in seen and y == b for x, y, _ in edges)


def test_motifs_equal_plain_ones_without_a_table_a_round(spark, tmp_path):
    """Both kinds of proofs: edges to later steps only, and ways back. Proof "long" has a way around of 60 steps, which took a table a step."""
    flows = {"a": _flow(1, True), "b": _flow(2, False), "c": _flow(3, False), "long": [(i, i + 1, "goal") for i in range(60)] + [(0, 100, "goal"), (100, 60, "goal")]}
    heads = {t: {i: f"h{i % 3}" for i in {x for e in es for x in e[:2]}} for t, es in flows.items()}
    rows = [(t, a, b, heads[t][a], heads[t][b], k) for t, es in flows.items() for a, b, k in es]
    flow = spark.createDataFrame(rows, "theorem string, src int, dst int, src_head string, dst_head string, kind string")
    named = spark.createDataFrame([(t, i, h) for t, hs in heads.items() for i, h in hs.items()], "theorem string, idx int, head string")
    sets = {(t, m) for t, es in flows.items() for m in combinations(sorted(heads[t]), 3) if sum(any({a, b} == set(p) for a, b, _ in es) for p in combinations(m, 2)) >= 2}
    before = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    count = lambda: len(before.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(before)) if before.getFileSystem(spark._jsc.hadoopConfiguration()).exists(before) else 0
    tables = count()

    c, w = motifs.connected_motifs(flow, named, 3, 1)
    found = {(r.theorem, tuple(r.members)): r.pattern for r in w.collect()}
    assert set(found) == sets and len(found) == w.count()
    for (t, m), pattern in found.items():
        typed = ",".join(sorted({f"{m.index(a)}-{m.index(b)}:{k}" for a, b, k in flows[t] if a in m and b in m}))
        assert pattern == ">".join(heads[t][i] for i in m) + " " + typed
    support = {r.pattern: (r.support, r.witnesses) for r in c.collect()}
    assert support == {p: (len({t for (t, _), q in found.items() if q == p}), sum(q == p for q in found.values())) for p in set(found.values())}

    has = {t: {(a, b) for a, b, _ in es} for t, es in flows.items()}
    bad = {(t, m) for t, m in sets if any((a, b) not in has[t] and _joined(flows[t], a, b, m) for a in m for b in m)}
    assert {(r.theorem, tuple(r.members)) for r in motifs.detours(flow, w).collect()} == bad
    strict = {(t, m) for t, m in sets if any(_joined(flows[t], a, b, m) for a in m for b in m)}
    assert {(r.theorem, tuple(r.members)) for r in motifs.detours(flow, w, strict=True).collect()} == strict
    good = {r.pattern: (r.witnesses, r.good, r.collapsible) for r in motifs.collapsible(flow, c, w).collect()}
    assert good == {p: (n, g, n == g) for p in support for n in [support[p][1]] for g in [sum(q == p and x not in bad for x, q in found.items())]}

    assert good == {r.pattern: (r.witnesses, r.good, r.collapsible) for r in motifs.collapsible_motifs(flow, named, 3, 1).collect()}

    def reason(t, m):
        if any(m.index(b) != m.index(a) + 1 for a, b in has[t] if a in m and b in m):
            return "missing_internal_edge"
        return "intermediate_path_violation" if any((a, b) not in has[t] and _joined(flows[t], a, b, m) for a, b in combinations(m, 2)) else "ok"

    judged = {(r.theorem, tuple(r.members)): r.reason for r in motifs.collapsible_paths(flow, motifs.paths(flow, 3)).collect()}
    assert judged == {(t, m): reason(t, m) for t, es in flows.items() for m in permutations(sorted(heads[t]), 3) if {m[:2], m[1:]} <= has[t]}
    assert {"ok", "missing_internal_edge", "intermediate_path_violation"} == set(judged.values())
    assert count() == tables


def test_paths_are_judged_where_their_proof_is(spark):
    """The same paths, counts and first witnesses as by joins; a pattern with more witnesses than samples, in one theorem and in several; no path is shuffled."""
    flows = {f"p{i}": _flow(i, i % 2 == 0) for i in range(12)} | {None: [(0, 1, "goal"), (1, 2, "goal")]}
    rows = [(t, a, b, f"h{a % 2}", None if b == 8 else f"h{b % 2}", k) for t, es in flows.items() for a, b, k in es]
    flow = spark.createDataFrame(rows, "theorem string, src int, dst int, src_head string, dst_head string, kind string").repartition(3)
    want = motifs.collapsible_paths(flow, motifs.paths(flow, 3))
    plain = lambda df: sorted(map(repr, (r.asDict() for r in df.select("theorem", "members", "heads", "kinds", "reason").collect())))
    assert plain(motifs.judged_paths(flow, 3)) == plain(want) and want.count() > 100
    all_ = want.collect()
    counts = {(r.heads, tuple(r.kinds), r.reason): (r.witnesses, r.support) for r in motifs.path_reasons(flow, 3).collect()}
    assert counts == {k: (len(x), len(set(x))) for k in {(r.heads, tuple(r.kinds), r.reason) for r in all_} for x in [[r.theorem for r in all_ if (r.heads, tuple(r.kinds), r.reason) == k]]}
    for samples in (1, 5):
        some = lambda df, samples=samples: {(r.heads, tuple(r.kinds)): (r.sampled, r.good) for r in motifs.collapsible_majority(df, samples).collect()}
        assert some(motifs.first_paths(flow, 3, samples)) == some(want)
    assert motifs.first_paths(flow, 3, 1).count() < want.count() / 2
    plan = motifs.path_reasons(flow, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
