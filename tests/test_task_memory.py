"""What one task holds: names and proofs are spread before they are listed or counted."""

import duckdb
import pandas as pd

import __spark_entry__ as entry
from lemmaflow.operators import reports


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_listed_after_the_only_shuffle(spark):
    blocks = spark.createDataFrame([(1, 1, " rw [a.b] "), (1, 2, "rw [a.b]"), (2, 3, "exact c.d")], "proof long, block long, text string")
    found = reports.block_names(blocks)
    plan = _plan(found)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    assert {(r.proof, r.text) for r in found.collect()} == {(1, "rw [a.b]"), (2, "exact c.d")}
    plan = _plan(entry.queries()["clean_rewrite"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_block_usage_counts_repeated_orders(spark, tmp_path):
    """Order 1 has two rows of one block and one of another; the plan keeps no set of proofs."""
    pd.DataFrame({"o_orderkey": [1, 1, 1, 2], "o_orderpriority": ["A", "A", "B", "A"]}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": [1, 1, 2], "l_partkey": [7, 8, 7]}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": [7, 8], "p_brand": ["x", "x"], "p_type": ["y", "z"]}).to_parquet(tmp_path / "part.parquet")
    found = entry.queries()["block_usage"](spark, str(tmp_path))
    assert "distinct" not in _plan(found)
    con = duckdb.connect()
    for n in ("orders", "lineitem", "part"):
        con.execute(f"create view {n} as select * from '{tmp_path}/{n}.parquet'")
    names = ["block", "premise", "n", "proofs", "percent"]
    want = con.execute(f"select {', '.join(names)} from ({entry.oracle_sql()['block_usage']})").fetchall()
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(want)
