"""Distributed ranks and running sums against plain ones."""

import random
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import models
from lemmaflow.operators.ranking import add_rank, add_running_sum


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(30)]), rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, score long, n long").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    keys = [F.desc_nulls_last("score"), F.col("id")]
    assert {r.id: r["rank"] for r in add_rank(df, keys).collect()} == {r[0]: k for k, r in enumerate(order, 1)}
    assert {r.id: r.total for r in add_running_sum(df, "n", keys, "total").collect()} == dict(zip((r[0] for r in order), accumulate(r[2] for r in order), strict=True))
    assert add_rank(df.limit(0), keys).count() == add_running_sum(df.limit(0), "n", keys, "total").count() == 0


def test_no_window_has_all_rows(spark):
    plan = add_rank(spark.range(100).repartition(4), [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate [_range" in plan  # the window is over the totals of the ranges


def test_correlations_of_all_features(spark):
    """Ties, a constant feature, a group of one row and negative numbers, against ranks by pandas."""
    r = np.random.default_rng(5)
    df = pd.DataFrame({"depth": r.integers(0, 3, 300), "a": r.integers(-3, 4, 300), "b": r.normal(size=300), "same": 1, "y1": r.integers(0, 5, 300), "y2": r.normal(size=300)})
    df = pd.concat([df, pd.DataFrame({"depth": [9], "a": [1], "b": [1.0], "same": [1], "y1": [1], "y2": [2.0]})])
    got = {(x.depth, x.feature, x.target): (x.n, x.spearman) for x in models.feature_correlations(spark.createDataFrame(df), ["a", "b", "same"], ["y1", "y2"], "depth").collect()}
    want = {(d, f, t): (len(g), round(g[f].rank().corr(g[t].rank()), 6)) for d, g in df.groupby("depth") for f in "ab" for t in ("y1", "y2") if d != 9}
    assert got == {k: (n, pytest.approx(v, abs=2e-6)) for k, (n, v) in want.items()}
    assert models.feature_correlations(spark.createDataFrame(df).limit(0), ["a"], ["y1"], "depth").count() == 0
