"""Small fixtures with literal results for the odd semantics, and properties."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry

from lemmaflow.functions import candidates
from lemmaflow.functions import text as t
from lemmaflow.operators import components, cycles, features, graph, loops, mining, models, motifs, object_flow, proof, reports, resolve, stats
from lemmaflow.sources import tables


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def steps(spark, proofs):
    return spark.createDataFrame([(name, i, h) for name, hs in proofs.items() for i, h in enumerate(hs)], "theorem string, idx int, head string")


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f.alias("y")).first()["y"]


def test_state_context(spark):
    state = "n m : ℕ\nh : a = b\nx : a ≤ b\nhX : Prop\ninst✝ : Mul β\n⊢ n + m\n  = m + n"
    c = one(spark, state, t.state_context(t.F.col("x")))
    assert c.variables == {"n": "ℕ", "m": "ℕ", "hX": "Prop"} and c.hypotheses == {"h": "a = b", "x": "a ≤ b"}
    assert c.typeclasses == ["Mul β"] and c.goal == "n + m = m + n" and c.goal_type == "n"
    empty = one(spark, "", t.state_context(t.F.col("x")))
    assert empty.variables == {} and empty.goal == "" and empty.typeclasses == []
    assert one(spark, "x : A\nx : B\n⊢ p", t.state_context(t.F.col("x"))).variables == {"x": "B"}


@pytest.mark.parametrize(("tactic", "word", "ident", "bucket", "family"), [
    ("rw [← Nat.add_comm]", "rw", "rw", "rw", "rw"), ("simp only [foo, *]", "simp", "simp", "simp", "simp"), ("· exact h.symm", "·", "exact", "bullet", "other"),
    ("case zero => rfl", "case", "case", "case", "other"), ("", "unknown", "unknown", "unknown", "other"), ("simp_rw [a]", "simp_rw", "simp_rw", "simp_rw", "simp_rw"), ("rfl", "rfl", "rfl", "rfl", "rfl"),
])
def test_tactic_heads(spark, tactic, word, ident, bucket, family):
    c = t.F.col("x")
    row = spark.createDataFrame([(tactic,)], "x string").select(t.head_word(c), t.head_ident(c), t.head_bucket(c), t.family(c)).first()
    assert tuple(row) == (word, ident, bucket, family)


def test_names_in_tactics(spark):
    c = t.F.col("x")
    assert one(spark, "simp only [foo, *, 3, a.b']", t.bracket_lemmas(c)) == ["foo", "*", "a.b'"]
    assert one(spark, "rw [foo, foo, h1, x, Nat.add_comm]", t.surface_premises(c)) == ["foo", "Nat.add_comm"]
    assert one(spark, "rw [foo, foo, h1, x]", t.surface_premises(c, dedupe=False)) == ["foo", "foo"]
    assert one(spark, "rw [foo, foo, h1, x] this norm_num", t.surface_premises_first(c)) == ["foo", "foo", "h1", "this", "norm_num"]
    assert one(spark, "exact h.symm x' norm_num at", t.identifier_refs(c)) == ["h", "x'", "at"]
    assert one(spark, "Foo.mp", t.is_tactic_or_hypothesis(c)) and not one(spark, "Foo.bar", t.is_tactic_or_hypothesis(c))


def test_states_and_names(spark):
    c = t.F.col("x")
    assert one(spark, "no goals", t.is_terminal(c)) and one(spark, "⊢ a\n⊢ b", t.goal_counts(c)) == 2
    d = spark.createDataFrame([("a : A\nb : B\n⊢ p", "b : B\nc : C\n⊢ q")], "x string, z string").select(t.goal_diff(c, t.F.col("z")).alias("d")).first().d
    assert (d.added, d.removed, d.kept, d.target_changed) == (["c"], ["a"], ["b"], True)
    assert one(spark, "Mathlib/Algebra/Defs.lean", t.namespace_from_path(c)) == "Mathlib.Algebra.Defs"
    assert one(spark, "A/B.lean", t.open_namespaces(c, t.F.lit("N.foo"))) == ["A", "A.B", "N"]
    assert one(spark, "/- a\n-/x -- y\nz", t.strip_comments(c)) == "x \nz"
    assert one(spark, "a bé", t.slug(c)) == "a_b_"
    assert one(spark, r"x ℕ yé", t.unicode_normalize(c)) == "x ℕ yé"
    assert one(spark, "@[simp] theorem foo.bar (x : Nat) : x = x", t.short_name(c)) == "foo.bar"
    lit = t.F.lit
    assert one(spark, "abc\ndef\nghi", t.excerpt(c, lit(1), lit(1), lit(3), lit(2))) == "bc def gh"
    assert one(spark, ["ℕ → Set α", "Finset Int"], t.namespaces_from_types(c), "array<string>") == ["Nat", "Int", "Set", "Finset"][0:3] + ["Finset"]


def test_scans(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2}\n')
    assert [tuple(r) for r in tables.scan_json(spark, str(tmp_path), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    rows = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new")], "full_name string, seq int, code string")
    assert tables.code_index(rows).first().code == "new"


def test_entropy(spark):
    s = steps(spark, {"a": ["x", "x", "y", "y"], "b": ["x", "x"]})
    rows = {r.theorem: r for r in stats.theorem_entropy(s).collect()}
    assert (rows["a"].entropy, rows["a"].potential, rows["a"].redundancy) == (1.0, 0.0, 0.0) and (rows["b"].entropy, rows["b"].redundancy) == (0.0, 0.0)
    # Bigrams xx 2, xy 1, yy 1 over six steps; x occurs 4 times, y twice.
    import math

    h = stats.conditional_entropy(s).first().conditional_entropy
    assert abs(h - (2 * math.log2(4 / 2) + math.log2(4) + math.log2(2)) / 6) < 1e-6


def test_depth_is_longest_and_level_shortest(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (5, 4)])
    assert {tuple(r) for r in loops.kahn_rounds(e).collect()} == {(1, 0), (5, 0), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in loops.bfs_levels(e).collect()} == {(1, 0), (5, 0), (2, 1), (3, 1), (4, 1)}
    t_ = {r.id: (r.y1, r.y2) for r in loops.targets(e).collect()}
    assert t_ == {1: (5.0, 2), 2: (2.0, 1), 3: (1.0, 1), 4: (0.0, 0), 5: (1.0, 1)}  # paths, not descendants
    assert {(r.start, r.id) for r in loops.closure(e).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 4)}
    assert [tuple(r) for r in loops.bfs_waves(e).orderBy("step").collect()] == [(0, 2, 1), (1, 3, 1), (2, 4, 1), (3, 5, 0)]


def test_whole_graphs_in_blocks(spark):
    pairs = [(k, k + 1) for k in range(100, 109)] + [(100, 109), (90, 100), (1, 2), (2, 3)]
    e = edges(spark, pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def reach(start, step):
        hops, front = {start: 0}, [start]
        while front:
            front = [n for n in dict.fromkeys(y for x in front for y in step(x)) if n not in hops and not hops.update({n: hops[front[0]] + 1})]
        return hops

    far = [h for s in near if s >= 90 for h in reach(s, near.get).values() if h]
    r = loops.path_statistics(e, 5).first()
    assert (r.mean_path, r.diameter, r.pairs) == (round(sum(far) / len(far), 6), max(far), len(far))
    below = {(s, x) for s in near for x in reach(s, lambda y: [b for a, b in pairs if a == y]) if x != s}
    assert Counter(map(tuple, loops.relatives(e, 5).collect())) == Counter([(a, b, "descendant") for a, b in below] + [(b, a, "ancestor") for a, b in below])
    top = loops.greatest_removal_impacts(e, 80, 5).collect()
    assert len(top) == len(near) and top[0].id == 90 and {x.id: x.impact for x in top}[108] == 0 and {x.id: x.impact for x in top}[1] == 1


def test_triangles_and_diamonds(spark):
    with_middle = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (2, 3)])
    without = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert graph.diamond_count(without).first()[0] == 1 and graph.diamond_count(with_middle).first()[0] == 0
    assert graph.ffl_count(with_middle).first()[0] == 2 and graph.ffl_count(without).first()[0] == 0
    assert graph.diamond_count(edges(spark, [(1, 2)])).first()[0] == 0
    assert {r.id: r.diamonds for r in graph.ego_diamonds(without).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def brute_diamonds(pairs):
    ns = sorted({x for p in pairs for x in p})
    up, down = {n: {a for a, b in pairs if b == n} for n in ns}, {n: {b for a, b in pairs if a == n} for n in ns}
    c = {(v, w): len(up[v] & up[w]) * len(down[v] & down[w]) for v, w in itertools.combinations(ns, 2) if (v, w) not in pairs and (w, v) not in pairs}
    return sum(c.values()), {n: sum(k for p, k in c.items() if n in p) for n in ns}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diamonds_of_any_graph(spark, seed):
    """Cycles, edges both ways and a hub, against all pairs of nodes."""
    r = random.Random(seed)
    pairs = {(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(60)) if a != b}
    pairs |= {(0, n) for n in range(1, 14)} | {(n, 0) for n in range(1, 14, seed)}
    total, each = brute_diamonds(pairs)
    e = edges(spark, sorted(pairs))
    assert graph.diamond_count(e).first()[0] == total > 0
    assert {x.id: x.diamonds for x in graph.ego_diamonds(e).collect()} == each
    assert graph.diamond_count(e.limit(0)).first()[0] == 0 and graph.ego_diamonds(e.limit(0)).count() == 0


def test_diamonds_of_a_star(spark):
    """A hub of 100,000 leaves, some of which have a child in common: the hub's neighbours aren't paired (that were five billion pairs)."""
    star = spark.range(1, 100_001).selectExpr("0L as src", "id as dst")
    e = star.union(spark.range(1, 100_001, 1000).selectExpr("id as src", "1000000 + id div 10000 as dst"))
    assert graph.diamond_count(e).first()[0] == 10 * 45
    assert graph.ego_diamonds(e).filter("diamonds > 0").count() == 100


def test_cycles(spark):
    e = edges(spark, [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (6, 6), (2, 3), (5, 7), (8, 1)])
    assert {tuple(r) for r in cycles.strong_components(e).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 8)}
    for left in (e.join(cycles.feedback_arc_set(e), ["src", "dst"], "left_anti"), e.join(cycles.feedback_vertex_set(e).withColumnRenamed("id", "src"), "src", "left_anti")):
        assert loops.is_dag(left).first().is_dag
    assert not loops.is_dag(e).first().is_dag
    assert {tuple(r) for r in components.connected_components(e).collect()} == {(i, 1) for i in (1, 2, 3, 4, 5, 7, 8)} | {(6, 6)}


def test_random_graphs(spark):
    rng = random.Random(1)
    pairs = {(a, b) for a, b in ((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(110)) if a != b}
    e = edges(spark, sorted(pairs))
    d = graph.degrees(e).collect()
    assert sum(r.in_degree for r in d) == sum(r.out_degree for r in d) == len(pairs)
    label = {r.id: r.component for r in components.connected_components(e).collect()}
    assert all(label[a] == label[b] for a, b in pairs) and all(c <= i for i, c in label.items())
    dag = edges(spark, sorted((min(p), max(p)) for p in {tuple(sorted(p)) for p in pairs}))
    depth = {r.id: r.depth for r in loops.kahn_rounds(dag).collect()}
    assert all(depth[r.src] < depth[r.dst] for r in dag.collect())
    order = loops.kahn_rounds(dag).withColumnRenamed("depth", "t")
    new = cycles.rewire(dag, order, 3)
    assert sorted(graph.degrees(new).collect()) == sorted(graph.degrees(dag).collect()) and new.distinct().count() == dag.count() and loops.is_dag(new).first().is_dag


def test_retrieval_goes_through_all_queries(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(0, 1200, 20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = models.top_k_retrieval_blocks(frame, frame.filter("vec_id % 100 = 0"), "vec_id", "embedding", 3, block=5).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(q, r + 1, i) for q, x in rows if q % 100 == 0 for r, (_, i) in enumerate(sorted((-dot(x, y), i) for i, y in rows if i != q)[:3])}
    assert {(r.query_id, r.rank, r.id) for r in got} == want and len(got) == len(want) == 36


def test_every_vector_is_a_query(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(5)]) for i in range(1, 300)]  # many ties
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(models, "_AT_ONCE", 7)
    monkeypatch.setattr(models, "_VECTORS_AT_ONCE", 40)
    got = entry.queries()["topk_retrieval_all"](spark, str(tmp_path)).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(q, r + 1, i) for q, x in rows for r, (_, i) in enumerate(sorted((-dot(x, y), i) for i, y in rows if i != q)[:10])}
    assert {(r.query_id, r.rank, r.id) for r in got} == want and len(got) == len(want) == 2990


def test_retrieval_keeps_ties_in_order(spark):
    """Copies have equal scores to the last bit, so the smaller id comes first; candidates come from a matrix product in any case."""
    rng = random.Random(9)
    some = [[rng.uniform(-1, 1) for _ in range(33)] for _ in range(40)]
    rows = [(i, some[i * 7 % 40]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    plan = models.top_k_retrieval(frame, frame.filter("vec_id % 100 = 0"), "vec_id", "embedding", 30)

    def score(a, b):
        out = 0.0
        for x, y in zip(a, b, strict=True):
            out += x * y
        return out

    want = {(q, r + 1, i) for q, x in rows if q % 100 == 0 for r, (_, i) in enumerate(sorted((-score(x, y), i) for i, y in rows if i != q)[:30])}
    assert {(r.query_id, r.rank, r.id) for r in plan.collect()} == want
    assert "MapInArrow" in plan._jdf.queryExecution().toString()


def test_all_edges_come_from_all_lines(spark, tmp_path):
    from lemmaflow.plans import views

    lines = [(1, 1, 5, 50), (1, 2, 3, 1), (1, 3, 9, 45), (2, 1, 3, 1), (2, 2, 5, 2), (3, 1, 7, None), (3, 2, 8, 3), (3, 3, 8, 50)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, views.all_edges(spark, str(tmp_path)).collect())) == [(3, 5), (3, 9), (7, 8)]
    assert sorted(map(tuple, views.edges(spark, str(tmp_path)).collect())) == [(1, 2)]


def test_loops_end_where_the_graph_does(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.id: r.depth for r in loops.kahn_rounds(chain).collect()} == {i: i for i in range(41)}
    assert loops.closure(chain).count() == 41 * 40 // 2


def test_features_of_ancestors(spark):
    from lemmaflow.operators import features, reach

    rng = random.Random(5)
    pairs = sorted({(a, b) for _ in range(60) for a, b in [sorted(rng.sample(range(25), 2))]})
    e = spark.createDataFrame(pairs, "src long, dst long")
    up = {}
    for x in range(25):
        ps = [a for a, b in pairs if b == x]
        up[x] = set(ps).union(*(up[p] for p in ps)) if ps else set()
    depth = {r.id: r.depth for r in loops.kahn_rounds(e).collect()}
    d = spark.createDataFrame(list(depth.items()), "id long, depth long")
    place = reach.places(loops.kahn_rounds(e))
    got = {r.id: r for r in features.parent_pairs(e, reach.ancestors(e, loops.kahn_rounds(e), place), place).collect()}
    reached = {r.id: r for r in features.parent_reach(e, d, reach.descendants(e, place)).collect()}
    for x in {b for _, b in pairs}:
        ps = [a for a, b in pairs if b == x]
        two = [(p, q) for p in ps for q in ps if p < q]
        jaccard = [len(up[p] & up[q]) / len(up[p] | up[q]) if up[p] | up[q] else 0 for p, q in two]
        deepest = [max((depth[a] for a in (up[p] | {p}) & (up[q] | {q})), default=0) for p, q in two]
        r = got[x]
        assert abs(r.parent_diversity - (1 - sum(jaccard) / len(two) if two else 1)) < 1e-5
        assert abs(r.mean_lca_depth - (sum(deepest) / len(two) if two else 0)) < 1e-5 and r.max_lca_depth == max(deepest, default=0)
        below = [sum(p in up[y] and depth[y] < depth[x] for y in depth) for p in ps]
        assert abs(reached[x].mean_parent_reach - sum(below) / len(below)) < 1e-5 and reached[x].max_parent_reach == max(below)


def test_null_model_swaps_enough(spark):
    rng = random.Random(3)
    e = edges(spark, sorted({(rng.randint(0, 19), rng.randint(20, 39)) for _ in range(60)}))
    order = loops.kahn_rounds(e).withColumnRenamed("depth", "t")
    new, accepted = cycles.null_model(e, order, 2)
    assert accepted >= 2 * e.count()
    assert sorted(graph.degrees(new).collect()) == sorted(graph.degrees(e).collect()) and new.distinct().count() == e.count()
    stuck = edges(spark, [(1, 2), (1, 3)])
    same, accepted = cycles.null_model(stuck, loops.kahn_rounds(stuck).withColumnRenamed("depth", "t"), idle=3)
    assert accepted == 0 and sorted(map(tuple, same.collect())) == [(1, 2), (1, 3)]


def test_resolution(spark):
    corpus = spark.createDataFrame([(i, n) for i, n in enumerate(["A.x", "B.x", "N.y", "Q.z", "Q.R.w", *[f"M{k}.many" for k in range(7)], "Nat.t", "Other.t"])], "seq int, full_name string")
    refs = [(1, "q", "A.x", [], []), (2, "B.x", "none", [], []), (3, "zzz", "none", [], []), (4, "x", None, ["Z", "B", "A"], []), (5, "t", None, [], ["Nat"]), (6, "y", None, [], []), (7, "many", None, [], [])]
    got = {r.ref_id: (r.full_name, r.method, r.confidence, r.n_candidates) for r in resolve.resolve(spark.createDataFrame(refs, "ref_id int, surface string, hint string, namespaces array<string>, types array<string>"), corpus).collect()}
    assert got == {
        1: ("A.x", "annotation", 1.0, 0), 2: ("B.x", "exact_match", 1.0, 2), 3: ("zzz", "not_found", 0.0, 0), 4: ("B.x", "namespace_match", 0.95, 2),
        5: ("Nat.t", "type_inference:Nat", 0.8, 2), 6: ("N.y", "unique_suffix", 0.6, 1), 7: ("M0.many", "ambiguous", 0.3, 7),
    }


def test_mining(spark):
    p = spark.createDataFrame([(i, x) for i, xs in enumerate(["abc", "abc", "ab", "cd"]) for x in xs], "theorem int, premise string")
    pairs = mining.frequent_pairs(p, 2)
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 3), ("a", "c", 2), ("b", "c", 2)}
    assert [tuple(r) for r in mining.frequent_triples(p, pairs, 2).collect()] == [("a", "b", "c", 2)]
    w = spark.createDataFrame([("h", "k", "t", 0, 1), ("h", "k", "t", 1, 2), ("h", "k", "t", 2, 3)], "heads string, kinds string, theorem string, first int, last int")
    assert mining.disjoint_witnesses(w).first().disjoint == 2


def test_blocks(spark):
    rows = [(1, i, x) for i, x in enumerate(["suffices h from", "  foo", "bar", "baz :=", "qux", ""])]
    got = {r.block: r.text for r in proof.tactic_blocks(spark.createDataFrame(rows, "proof int, line_no int, line string")).collect()}
    assert got == {1: "suffices h from foo", 2: "bar", 3: "baz := qux"}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.5), (4, 0, 0.1)], "id int, y int, s double")
    m = models.classification_metrics(rows, "y", "s").first()
    assert abs(m.average_precision - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-6 and abs(m.roc_auc - 0.625) < 1e-6
    assert models.ndcg_at_k(rows.withColumn("y", rows.y * 0), "y", "s", "id", 3).first().ndcg == 0.0


def test_features_see_only_the_past(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 3), (1, 4), (3, 4)])
    depth = loops.kahn_rounds(e)  # 1:0 2:1 3:2 4:3
    got = {r.id: (r.parent_outdeg_sum, r.parent_beta_max) for r in features.parent_degrees(e, depth).collect()}
    assert got == {2: (0, 0), 3: (1, 1), 4: (2, 1)}


def test_lemma_candidates(spark):
    c = t.F.col("x")
    block = "rw [← Nat.add_comm, *, _, foo'] at h; exact apply x.2, Subtype.coe_injective.injOn \\u2190 have (a)"
    assert one(spark, block, candidates.lemma_candidates(c)) == ["Nat.add_comm", "Subtype.coe_injective.injOn", "foo'", "x", "x.2"]
    assert one(spark, None, candidates.lemma_candidates(c)) == [] and one(spark, "", candidates.identifiers(c)) == []
    for token, want in [
        ("MapsTo", ["Set.MapsTo", "MapsTo"]), ("f.rootSet", ["Polynomial.rootSet", "f.rootSet"]), ("f.rootSet_finite", ["Polynomial.rootSet_finite", "f.rootSet_finite"]),
        ("le_aleph0_iff_set_countable", ["Cardinal.le_aleph0_iff_set_countable", "le_aleph0_iff_set_countable"]), ("mk_uLift", ["Cardinal.mk_uLift", "mk_uLift"]),
        ("this.countable_of_injOn", ["Set.MapsTo.countable_of_injOn"]), ("x.coe_prop", []), ("foo.2", ["foo"]), ("Foo", ["Foo", "Set.Foo"]), ("Nat.add", ["Nat.add"]),
    ]:
        assert one(spark, token, candidates.normalize_candidate(c)) == want
    classes = {"simp": "keywords_modifiers", "Or.inl": "keywords_modifiers", "A": "type_variables", "Nat": "namespaces", "this.foo": "local_var_access", "h1.2": "local_var_access", "h_pos": "local_hypotheses",
               "hab1": "local_hypotheses", "MapsTo": "type_class_annotations", "Nat.succ_le": "global_lemmas", "add_comm": "global_lemmas", "foo.mp": "global_lemmas", "foo": "other", "Foo": "other", "âx": "corrupted_unicode"}
    rows = spark.createDataFrame([(k,) for k in classes], "x string").select("x", candidates.identifier_category(c).alias("y")).collect()
    assert {r.x: r.y for r in rows} == classes


def test_goal_blocks_and_alignment(spark):
    c = t.F.col("x")
    two = one(spark, "lost : A\ncase zero\nn m : ℕ\n⊢ n\n  = m\ncase succ\nh : p ⊢ q", reports.goal_blocks(c))
    assert [(g.case_label, [tuple(d) for d in g.declared], g.target) for g in two] == [("zero", [("n", "ℕ"), ("m", "ℕ")], "n = m"), ("succ", [], "q")]
    apart = one(spark, "a : A\n⊢ p\n\nno turnstile\n\n⊢ q", reports.goal_blocks(c))
    assert [(g.hypotheses, g.target) for g in apart] == [(["a : A"], "p"), ([], "q")]
    assert one(spark, "no goals", reports.goal_blocks(c)) == [] and one(spark, None, reports.goal_blocks(c)) == []
    rows = [("a", "⊢ p", "no goals", True), ("a", "⊢ p", "?", False), ("a", None, "⊢ q", False), ("a", "⊢ p", "⊢ q", False)]
    got = reports.validation_alignment(spark.createDataFrame(rows, "theorem string, before string, after string, is_terminal boolean")).first()
    assert (got.num_tactics, got.node_alignment_rate, got.edge_alignment_rate) == (4, 0.5, 0.5)


def test_annotate_premises(spark):
    tactics = spark.createDataFrame([(1, "rw [add_comm b, f]"), (2, "rfl")], "seq long, tactic string")
    spans = spark.createDataFrame([(1, 4, 12, "Nat.add_comm"), (1, 4, 7, "Nat.add"), (1, 6, 14, "x"), (1, 16, 17, "f")], "seq long, start int, stop int, full_name string")
    got = {r.seq: (r.annotated, r.names) for r in reports.annotate_premises(tactics, spans).collect()}
    assert got == {1: ("rw [<a>add_comm</a> b, <a>f</a>]", ["Nat.add_comm", "f"]), 2: ("rfl", [])}


def test_object_flow(spark):
    """Two goals of which one waits; a hypothesis that is inherited and one that is new; a goal that nobody left open."""
    rows = [
        ("a", 0, "constructor", "h : P\n⊢ p ∧ q", "case l\nh : P\n⊢ p\ncase r\nh : P\nk : Q\n⊢ q", ["And.intro"]),
        ("a", 1, "exact h h", "case l\nh : P\n⊢ p\ncase r\nh : P\nk : Q\n⊢ q", "case r\nh : P\nk : Q\n⊢ q", None),
        ("a", 2, "exact k h", "case r\nh : P\nk : Q\n⊢ q", "no goals", ["And.intro", "foo"]),
        ("b", 0, "by\n  skip", "⊢ a", "⊢ b", []),
        ("b", 1, "simp z", "z : Z\n⊢ other", None, []),
        ("b", 2, None, "no goals", "no goals", ["foo"]),
    ]
    steps = spark.createDataFrame(rows, "theorem string, idx int, tactic string, before string, after string, premises array<string>")
    got = {(e.theorem, e.src, e.dst, e.label, e.object_id) for e in object_flow.object_flow(steps).collect()}
    goal, arg, end = "goal->goal", "premise->arg", "proof_complete"
    assert got == {
        ("a", "in", "t0", goal, "g0"), ("a", "in", "t0", arg, "p0"), ("a", "t0", "t1", goal, "g1"), ("a", "in", "t1", "h->hyp", "h0"), ("a", "t0", "t2", goal, "g2"), ("a", "t0", "t2", "k->hyp", "h1"),
        ("a", "in", "t2", "h->hyp", "h0"), ("a", "in", "t2", arg, "p0"), ("a", "in", "t2", arg, "p1"), ("a", "t2", "out", end, "g2"),
        ("b", "in", "t0", goal, "g0"), ("b", "t0", "t1", goal, "g2"), ("b", "t0", "t1", "z->hyp", "h0"), ("b", "t1", "out", end, "g2"), ("b", "in", "t2", arg, "p0"),
    }
    stats = {r.theorem: (r.n_steps, r.branching_steps, r.inputs, r.outputs, r.resynced) for r in object_flow.object_stats(steps).collect()}
    assert stats == {"a": (3, 1, 9, 3, 0), "b": (3, 0, 4, 1, 1)}  # as many inputs as edges into the steps
    assert object_flow.object_flow(steps.limit(0)).count() == 0


def test_path_and_tree_motifs(spark):
    """0 -> 1 -> 2 -> 3 with a second kind of edge 0 -> 2: its path 0 1 2 lacks an edge, 1 2 3 is good, 0 2 3 is good (the way over 1 leads to a member of an edge of its own)."""
    flow = spark.createDataFrame([("a", 0, 1, "x", "y", "goal"), ("a", 1, 2, "y", "x", "goal"), ("a", 2, 3, "x", "z", "goal"), ("a", 0, 2, "x", "x", "hyp")], "theorem string, src int, dst int, src_head string, dst_head string, kind string")
    judged = {tuple(r.members): r.reason for r in motifs.collapsible_paths(flow, motifs.paths(flow, 3)).collect()}
    assert judged == {(0, 1, 2): "missing_internal_edge", (1, 2, 3): "ok", (0, 2, 3): "ok"}
    around = spark.createDataFrame([("a", 0, 1, "x", "x", "goal"), ("a", 1, 3, "x", "x", "goal"), ("a", 0, 2, "x", "x", "hyp"), ("a", 2, 3, "x", "x", "hyp")], flow.schema)
    assert {r.reason for r in motifs.collapsible_paths(around, motifs.paths(around, 3)).collect()} == {"intermediate_path_violation"}
    trees = {(r.heads, r.kinds): r.support for r in motifs.bfs_tree_motifs(flow, 4, 1).collect()}
    assert trees == {("x>y", "goal"): 1, ("y>x", "goal"): 1, ("x>z", "goal"): 1, ("x>x", "hyp"): 1, ("x>x>z", "hyp,goal"): 1, ("y>x>z", "goal,goal"): 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_triples_of_graphs_with_cycles_and_a_hub(spark, seed):
    """Both ways between two nodes, cycles and a node that meets all others."""
    r = random.Random(seed)
    pairs = {(a, b) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(40)) if a != b} | {(0, n) for n in range(1, 12)}
    e = edges(spark, sorted(pairs))
    loops_ = {(u, v, w) for u, v in pairs for x, w in pairs if x == v and (u, w) in pairs}
    assert Counter(tuple(x) for x in graph.feedforward_loops(e).collect()) == Counter(loops_)
    want = Counter()
    for t in itertools.combinations(range(12), 3):
        inner = [(a, b) for a, b in pairs if a in t and b in t]
        if len({frozenset(x) for x in inner}) >= 2:
            want["-".join(map(str, sorted(sum(10 for _, b in inner if b == n) + sum(1 for a, _ in inner if a == n) for n in t)))] += 1
    assert {x.signature: x.n for x in graph.motif3_census(e).collect()} == want
    below = {(u, w) for u, v in pairs for x, w in pairs if x == v}
    got = graph.transitivity(e).first()
    assert (got.with_grandparents, got.transitive) == (len({w for _, w in below}), len({w for u, w in below if (u, w) in pairs}))


def test_path_counts_and_their_empty_graph(spark):
    got = {x.id: (x.y1, x.y2) for x in loops.targets(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4), (4, 5)])).collect()}
    assert got == {1: (8, 3), 2: (2, 1), 3: (2, 1), 4: (1, 1), 5: (0, 0)}
    assert loops.targets(edges(spark, [(1, 2)]).limit(0)).count() == 0
