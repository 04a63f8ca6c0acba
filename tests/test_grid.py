"""Regressions side by side against one fit at a time."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lemmaflow.operators import grid


def test_grid_of_fits(spark):
    rng = np.random.default_rng(5)
    n = 900
    df = pd.DataFrame({"id": np.arange(n), "d": rng.integers(0, 3, n), "a": rng.normal(size=n) * 1000, "b": rng.integers(0, 5, n).astype(float), "c": 7.0})
    df["b2"] = df.b * 2 + 1
    df["t"] = np.maximum(0, np.round(3 + df.a / 1000 + df.b * (1 + df.d) + rng.normal(size=n)))
    sets = {"r0": ["a", "c"], "r1": ["a", "c", "b", "b2"]}
    rows = spark.createDataFrame(df)
    for log in (True, False):
        out = grid.linear_grid(rows, sets, "t", "d", "id", seeds=3, log_target=log)
        got = {(r.d, r.feature_set, r.seed): r for r in out.collect()}
        assert len(got) == 18
        for seed in (1, 2, 3):
            bucket = rows.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100)).alias("h")).toPandas().set_index("id").h
            pos = df[df.t > 0]
            tested = bucket.loc[pos.id].to_numpy() < 20
            for d in range(3):
                for name, cols in sets.items():
                    train, test = pos[~tested & (pos.d == d)], pos[tested & (pos.d == d)]
                    x = lambda f: np.column_stack([np.ones(len(f)), f[cols]])
                    w = np.linalg.lstsq(x(train), np.log1p(train.t) if log else train.t, rcond=None)[0]
                    p = x(test) @ w
                    p = pd.Series(np.expm1(p) if log else np.maximum(np.round(p), 0), index=test.index)
                    r = got[d, name, seed]
                    assert r.n == len(test) and abs(r.mae - (test.t - p).abs().mean()) < 1e-4
                    assert abs(r.r2 - (1 - ((test.t - p) ** 2).sum() / (len(test) * test.t.var(ddof=0)))) < 1e-4
                    assert abs(r.spearman - test.t.rank().corr(p.round(9).rank())) < 1e-3
    held = {(r.d, r.feature_set): r for r in grid.stability(out, "d").collect()}
    for key in held:
        each = [r.mae for k, r in got.items() if k[:2] == key]
        assert held[key].repeats == 3 and abs(held[key].mae_mean - np.mean(each)) < 1e-5 and abs(held[key].mae_std - np.std(each)) < 1e-5 and held[key].mae_most == max(each)


def test_groups_of_few_rows(spark):
    """Splits with a single test row, and equal truths: no rank correlation."""
    rows = spark.createDataFrame([(i, i // 4, float(i), 1) for i in range(40)], "id long, d int, a double, t long")
    out = grid.linear_grid(rows, {"r0": ["a"]}, "t", "d", "id").collect()
    assert out and all(r.spearman is None and r.r2 is None for r in out) and min(r.n for r in out) == 1
    assert all(r.mae < 1e-6 for r in out if r.n <= 2)  # two or more of the four rows were for training, so the line is level


def test_nothing_positive(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 0)], "id long, d int, a double, t long")
    assert grid.linear_grid(rows, {"r0": ["a"]}, "t", "d", "id").count() == 0
