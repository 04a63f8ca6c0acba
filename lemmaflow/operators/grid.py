"""Regressions for many groups, feature sets and seeded splits at once: one pass gathers the products of all columns, each fit is a small system of equations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .models import _ranks_within
from .stats import rounded


def _standard(rows: DataFrame, features: list[str]) -> DataFrame:
    """``x``: the features as doubles less their mean over their deviation, for distinct rows with the number ``n`` of each; nulls, NaN and constant features are 0."""
    clean = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double")) for c in features]
    mean = rows.agg(F.array(*(F.sum(F.col("n") * c) / F.sum("n") for c in clean)).alias("mean"))  # one row
    off = lambda i, c: c - F.element_at("mean", i + 1)
    # A constant feature may be off its mean by rounding.
    std = [F.when(F.min(c) < F.max(c), F.sqrt(F.sum(F.col("n") * off(i, c) * off(i, c)) / F.sum("n"))).otherwise(0.0) for i, c in enumerate(clean)]
    scale = rows.crossJoin(F.broadcast(mean)).groupBy("mean").agg(F.array(*std).alias("std"))  # one row
    x = F.zip_with(F.zip_with(F.array(*clean), "mean", lambda a, m: a - m), "std", lambda a, s: F.when(s > 0, a / s).otherwise(0.0))
    return rows.crossJoin(F.broadcast(scale)).withColumn("x", x).drop("mean", "std")


def linear_grid(rows: DataFrame, sets: dict[str, list[str]], target: str, by: str, key: str, seeds: int = 10, test_percent: int = 20, log_target: bool = True) -> DataFrame:
    """``(<by>, feature_set, seed, n, mae, r2, spearman)`` of the test rows of each fit; seeds count from 1.

    ``by`` (an integer of few values), each feature set and each seed have a least-squares fit of their own, on the training rows with a positive target (of log1p of the target, or of the target, then
    predicted as a whole number of at least 0), and are measured on the test rows with a positive one. Rows belong to a split by a hash of ``key`` and the seed. Features that depend on each
    other share their weight (the solution of the least norm). Groups without training or test rows have no row; r2 and spearman are null where the truth is constant.

    Rows alike in group, features and target are taken once, with the number of them and of those in each split's test, as they have the same predictions. Products of columns are summed for each
    (by, seed), whatever the number of rows; what is broadcast has a row for each fit."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    features = list(dict.fromkeys(f for names in sets.values() for f in names))
    width = len(features) + 2
    y = F.log1p(F.col(target).cast("double")) if log_target else F.col(target).cast("double")
    tests = [F.count_if(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < test_percent).alias(f"test_{seed}") for seed in range(1, seeds + 1)]
    data = rows.filter(F.col(target) > 0).select(F.col(by).cast("long").alias(by), key, F.col(target).cast("double").alias("truth"), y.alias("y"), *features)
    data = materialize(data.groupBy(by, "truth", "y", *features).agg(F.count("*").alias("n"), *tests), "alike")
    data = materialize(_standard(data, features).select(by, "truth", "y", "x", "n", F.array(*(f"test_{seed}" for seed in range(1, seeds + 1))).alias("tests")), "grid")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for value, g in b.groupby(by):
                z = np.column_stack([np.ones(len(g)), np.vstack(g["x"]), g["y"]])
                in_train = g["n"].to_numpy()[:, None] - np.vstack(g["tests"])
                yield pd.DataFrame({by: value, "seed": range(1, seeds + 1), "sums": [(z.T @ (z * in_train[:, [s]])).ravel() for s in range(seeds)]})

    sums = data.select(by, "y", "x", "n", "tests").mapInPandas(products, f"{by} long, seed int, sums array<double>")
    total = sums.groupBy(by, "seed").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for value, seed, flat in b.itertuples(index=False):
                m = np.asarray(flat).reshape(width, width)
                if m[0, 0] > 0:
                    for name, names in sets.items():
                        at = [0, *(1 + features.index(f) for f in names)]
                        w = np.zeros(width - 1)
                        w[at] = np.linalg.pinv(m[np.ix_(at, at)], rcond=1e-10, hermitian=True) @ m[at, -1]
                        yield pd.DataFrame({by: [value], "seed": [seed], "feature_set": [name], "w": [w]})

    fits = materialize(total.select(by, "seed", "sums").mapInPandas(solve, f"{by} long, seed int, feature_set string, w array<double>"), "fits")
    test = data.select(by, "truth", "x", F.posexplode("tests").alias("seed", "n")).filter("n > 0").withColumn("seed", F.col("seed") + 1)
    raw = F.aggregate(F.zip_with(F.slice("w", 2, width), "x", lambda a, b: a * b), F.element_at("w", 1), lambda a, x: a + x)
    # expm1 of what a fit on few rows may say of a far row stays finite.
    value = F.expm1(F.least(raw, F.lit(700.0))) if log_target else F.greatest(F.round(raw), F.lit(0.0))
    fit = [by, "feature_set", "seed"]
    scored = materialize(test.join(F.broadcast(fits), [by, "seed"]).groupBy(*fit, "truth", value.alias("predicted")).agg(F.sum("n").alias("n")), "grid-scores")
    err = F.col("truth") - F.col("predicted")
    centre = scored.groupBy(*fit).agg((F.sum(F.col("n") * F.col("truth")) / F.sum("n")).alias("centre"))
    off, n = F.col("truth") - F.col("centre"), F.sum("n")
    base = scored.join(F.broadcast(centre), fit).groupBy(*fit).agg(n.alias("n"), (F.sum(F.col("n") * F.abs(err)) / n).alias("mae"), F.when(F.min("truth") < F.max("truth"), 1 - F.sum(F.col("n") * err * err) / F.sum(F.col("n") * off * off)).alias("r2"))
    ranks = lambda c, r: _ranks_within(scored.groupBy(*fit, c).agg(F.sum("n").alias("n")), fit, c).select(*fit, c, (F.col("r") - (F.col("size") + 1) / 2).alias(r))
    both = scored.join(ranks("truth", "ra"), [*fit, "truth"]).join(ranks("predicted", "rb"), [*fit, "predicted"])
    # Ranks less their mean.
    product = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    rho = both.groupBy(*fit).agg(F.when((product("ra", "ra") > 0) & (product("rb", "rb") > 0), product("ra", "rb") / F.sqrt(product("ra", "ra")) / F.sqrt(product("rb", "rb"))).alias("spearman"))
    return base.join(rho, fit).select(*fit, "n", rounded("mae").alias("mae"), rounded("r2").alias("r2"), rounded("spearman").alias("spearman"))


def stability(grid: DataFrame, by: str, measures: tuple[str, ...] = ("mae", "spearman")) -> DataFrame:
    """``(<by>, feature_set, repeats, <measure>_mean, _std, _least, _most)`` of a grid over its seeds; the deviation is that of the population."""
    each = [rounded(f(m)).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("least", F.min), ("most", F.max))]
    return grid.groupBy(by, "feature_set").agg(F.count("*").alias("repeats"), *each)
