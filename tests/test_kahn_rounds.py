"""Kahn rounds on graphs whose layers shrink: edges from earlier layers aren't read in every round."""

from lemmaflow.operators import loops


def test_walked_edges_are_left_behind(spark, monkeypatch):
    fan = [(1000 + i, i % 20) for i in range(400)]
    chain = [(i, i + 1) for i in range(19)]
    stored, write = [], loops.materialize
    monkeypatch.setattr(loops, "materialize", lambda df, name: (out := write(df, name), stored.append(out.count()) if name == "kahn-edges" else None)[0])
    got = {r.id: r.depth for r in loops.kahn_rounds(spark.createDataFrame(fan + chain, "src long, dst long")).collect()}
    assert got == {1000 + i: 0 for i in range(400)} | {i: i + 1 for i in range(20)}
    assert stored[0] == 419 and stored[1] == 19 and stored[-1] <= 2


def test_cycles_and_what_is_below_have_no_round(spark, monkeypatch):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 3), (4, 5), (1, 6)]
    assert {r.id: r.depth for r in loops.kahn_rounds(spark.createDataFrame(pairs, "src long, dst long")).collect()} == {1: 0, 2: 1, 6: 1}
    assert loops.kahn_rounds(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")).count() == 0
