"""Vocabulary counts, entropies, description lengths and the like.

Sequences are ``steps(theorem, idx, head)``; citations are ``premises(theorem, premise)``, distinct. Everything is one or two
grouped aggregates; totals are taken from the counts, never from a second pass over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import add_rank


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def counts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n)``."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    return counts(rows, key).orderBy(F.desc("n"), key).limit(k)


def vocab_counts(steps: DataFrame, premises: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent heads and premises: ``(kind, name, n)``."""
    heads = top(steps, "head", k).select(F.lit("tactic").alias("kind"), F.col("head").alias("name"), "n")
    return heads.unionByName(top(premises, "premise", k).select(F.lit("premise").alias("kind"), F.col("premise").alias("name"), "n"))


def basic_statistics(sizes: DataFrame, column: str) -> DataFrame:
    return sizes.agg(F.count("*").alias("n"), rounded(F.avg(column)).alias("mean"), rounded(F.percentile(column, F.lit(0.5))).alias("median"), F.max(column).alias("max"))


def entropy(counted: DataFrame, n: str = "n") -> DataFrame:
    """Shannon entropy in bits of a table of counts: one row ``(symbols, total, entropy)``.

    H = log2(N) - sum(n log2 n) / N needs no total beforehand."""
    return counted.agg(F.count("*").alias("symbols"), F.sum(n).alias("total"), rounded(F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)).alias("entropy"))


def uniform_bits(sizes: DataFrame, tactics: int, premises: int, char_bits: int = 7) -> DataFrame:
    """``sizes(theorem, chars, n_tactics, n_premises)`` with the bits of a code of equal lengths."""
    bits = char_bits * F.col("chars") + F.col("n_tactics") * math.log2(max(tactics, 1)) + F.col("n_premises") * math.log2(max(premises, 1))
    return sizes.withColumn("bits", rounded(bits))


def ngrams(steps: DataFrame, n: int) -> DataFrame:
    """``(h1 .. hn, n)`` of adjacent heads."""
    order = Window.partitionBy("theorem").orderBy("idx")
    columns = [F.lead("head", i).over(order).alias(f"h{i + 1}") for i in range(n)]
    return steps.select(*columns).filter(F.col(f"h{n}").isNotNull()).groupBy(*[f"h{i + 1}" for i in range(n)]).agg(F.count("*").alias("n"))


def conditional_entropy(steps: DataFrame, normalized: bool = False) -> DataFrame:
    """H(head | head before). The joint is bigrams over all steps (or over all bigrams if ``normalized``), so as it stands the joint sums to less than 1."""
    one, two = counts(steps, "head"), ngrams(steps, 2)
    total = one.agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    joined = two.join(one.select(F.col("head").alias("h1"), F.col("n").alias("n1")), "h1")
    sums = joined.agg(F.sum(F.col("n") * F.log2(F.col("n") / F.col("n1"))).alias("s"), F.sum("n").alias("pairs"))
    over = F.col("pairs") if normalized else F.col("total")
    h = -F.col("s") / over
    return sums.join(F.broadcast(total)).select(rounded(h).alias("conditional_entropy"), rounded(1 - h / F.log2("v")).alias("predictability"))  # a row each


def theorem_entropy(steps: DataFrame) -> DataFrame:
    """Per theorem: entropy of its heads, log2(distinct) - entropy, and 1 - entropy / log2(distinct) (0 for one distinct head)."""
    by = steps.groupBy("theorem", "head").agg(F.count("*").alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    out = by.groupBy("theorem").agg(F.sum("n").alias("n_steps"), F.count("*").alias("n_distinct"), h.alias("h"))
    most = F.log2("n_distinct")
    return out.select("theorem", "n_steps", "n_distinct", rounded("h").alias("entropy"), rounded(most - F.col("h")).alias("potential"), rounded(F.when(F.col("n_distinct") > 1, 1 - F.col("h") / most).otherwise(0.0)).alias("redundancy"))


def ngram_patterns(steps: DataFrame, lengths: tuple[int, int] = (3, 7), theorems: int = 500, k: int = 50) -> DataFrame:
    """n-grams of the theorems of the highest potential that pay: savings = (n - 1) * count - n > 0."""
    best = theorem_entropy(steps).orderBy(F.desc("potential"), "theorem").limit(theorems).select("theorem")
    seqs = steps.join(best, "theorem", "left_semi").groupBy("theorem").agg(F.sort_array(F.collect_list(F.struct("idx", "head")))["head"].alias("heads"))
    grams = F.flatten(F.transform(F.sequence(F.lit(lengths[0]), F.lit(lengths[1])), lambda n: F.when(F.size("heads") >= n, F.transform(F.sequence(F.lit(1), F.size("heads") - n + 1), lambda i: F.slice("heads", i, n))).otherwise(F.array().cast("array<array<string>>"))))
    counted = seqs.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n >= 2")
    size = F.size("g")
    paying = counted.select(F.array_join("g", ",").alias("pattern"), size.alias("size"), "n", ((size - 1) * F.col("n") - size).alias("savings")).filter("savings > 0")
    return paying.orderBy(F.desc("savings"), "pattern").limit(k)


def rank_frequency(rows: DataFrame, key: str) -> DataFrame:
    """``(rank, key, n)``."""
    return add_rank(counts(rows, key), [F.desc("n"), F.col(key)]).select("rank", key, "n")


def length_distribution(steps: DataFrame) -> DataFrame:
    return counts(steps, "theorem").groupBy(F.col("n").alias("length")).agg(F.count("*").alias("theorems"))


def histogram(rows: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """``(bin, low, n)`` with equal bins from 0; the last one holds its upper end too; values outside are left out."""
    width = (high - low) / bins
    bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    return rows.filter(F.col(column).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).select("bin", rounded(low + F.col("bin") * width).alias("low"), "n")


def mdl_gain(theorems: DataFrame, uses: DataFrame, tactic_vocab: int = 278, premise_vocab: int = 99412) -> DataFrame:
    """Description length gain of each theorem.

    ``theorems(theorem, chars, proof_type, n_tactics, proof_chars, n_premises)``, ``uses(theorem, num_uses)``. The cost is 6 bits a character of the statement plus the proof: n log2(V_t) for
    tactic proofs, else 0.3 * 7 bits a character + premises * log2(V_p). A use replaces a pattern of ``pattern_length`` symbols by one reference."""
    bt, br = math.log2(tactic_vocab), math.log2(premise_vocab)
    tactic = F.col("proof_type") == "tactic"
    plen = F.when(tactic, F.col("n_tactics")).otherwise(F.greatest(F.lit(3), 2 * F.col("n_premises")))
    proof = F.when(tactic, F.col("n_tactics") * bt).otherwise(0.3 * 7 * F.col("proof_chars") + F.col("n_premises") * br)
    out = theorems.join(uses, "theorem", "left").withColumn("num_uses", F.coalesce("num_uses", F.lit(0))).withColumn("pattern_length", plen)
    out = out.withColumn("cost", 6 * F.col("chars") + proof).withColumn("savings_per_use", F.col("pattern_length") * bt - br).withColumn("savings", F.col("num_uses") * F.col("savings_per_use"))
    return out.select("theorem", "proof_type", "num_uses", "pattern_length", rounded("cost").alias("cost"), rounded("savings_per_use").alias("savings_per_use"), rounded("savings").alias("savings"), rounded(F.col("savings") - F.col("cost")).alias("mdl_gain"))


def extremes(rows: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """The k largest and the k smallest rows: ``(side, place, key, column)``."""
    high = rows.orderBy(F.desc(column), key).limit(k).select(F.lit("top").alias("side"), F.row_number().over(Window.orderBy(F.desc(column), key)).alias("place"), key, column)
    low = rows.orderBy(column, key).limit(k).select(F.lit("bottom").alias("side"), F.row_number().over(Window.orderBy(column, key)).alias("place"), key, column)
    return high.unionByName(low)


def namespace_counts(names: DataFrame, column: str = "full_name", k: int = 20) -> DataFrame:
    return top(names.select(F.split(column, "[.]")[0].alias("namespace")), "namespace", k)


def size_buckets(sizes: DataFrame, column: str, short: int, medium: int, k: int) -> DataFrame:
    """Short, medium and long ones: number, mean, least, most, upper median, and the first k theorems by name."""
    bucket = F.when(F.col(column) <= short, "short").when(F.col(column) <= medium, "medium").otherwise("long")
    own = Window.partitionBy("bucket").orderBy("theorem")
    rows = sizes.withColumn("bucket", bucket)
    stats = rows.groupBy("bucket").agg(F.count("*").alias("n"), rounded(F.avg(column)).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))
    first = rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k).groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("theorem")), " ").alias("first"))
    return stats.join(first, "bucket")


def longest(steps: DataFrame, k: int) -> DataFrame:
    return counts(steps, "theorem").orderBy(F.desc("n"), "theorem").limit(k).select("theorem", F.col("n").alias("n_steps"), F.row_number().over(Window.orderBy(F.desc("n"), "theorem")).alias("place"))


def pick_spread(steps: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """About k theorems of ``low`` to ``high`` steps, evenly spread over the order of length."""
    fit = counts(steps, "theorem").filter(F.col("n").between(low, high))
    ranked = add_rank(fit.select("theorem", F.col("n").alias("n_steps")), [F.col("n_steps"), F.col("theorem")], "r").withColumn("r", F.col("r") - 1)
    step = max(1, ranked.count() // k)
    return ranked.filter((F.col("r") % step == 0) & (F.col("r") < step * k)).select("theorem", "n_steps")


def repeated_steps(steps: DataFrame, columns: list[str]) -> DataFrame:
    """The first step of each theorem with the same ``columns``, in order."""
    own = Window.partitionBy("theorem", *columns).orderBy("idx")
    return steps.withColumn("place_", F.row_number().over(own)).filter("place_ = 1").drop("place_")


def state_continuity(steps: DataFrame, after: str, before: str) -> DataFrame:
    """Steps whose ``after`` isn't the next step's ``before``."""
    order = Window.partitionBy("theorem").orderBy("idx")
    nxt = steps.withColumn("next_before", F.lead(before).over(order))
    return nxt.filter(F.col("next_before").isNotNull() & ~F.col(after).eqNullSafe(F.col("next_before"))).select("theorem", "idx")


def order_by_length(steps: DataFrame, column: str) -> DataFrame:
    own = Window.partitionBy("theorem").orderBy(F.length(column), "idx")
    return steps.select("theorem", "idx", (F.row_number().over(own) - 1).alias("place"))


def extreme_theorems(steps: DataFrame, k: int = 5) -> DataFrame:
    """The k highest, middle and lowest theorems by potential, with their most common head (of equals the first by name)."""
    heads = steps.groupBy("theorem", "head").agg(F.count("*").alias("n")).groupBy("theorem").agg(F.min(F.struct((-F.col("n")).alias("m"), "head"))["head"].alias("top_head"))
    ranked = add_rank(theorem_entropy(steps).filter("n_distinct > 1").select("theorem", "potential"), [F.desc("potential"), F.col("theorem")], "r")
    total = ranked.count()
    middle = total // 2 - k // 2
    side = F.when(F.col("r") <= k, "high").when(F.col("r") > total - k, "low").when((F.col("r") > middle) & (F.col("r") <= middle + k), "middle")
    return ranked.withColumn("side", side).filter("side is not null").join(heads, "theorem").select("side", "theorem", "potential", "top_head")


def running_total(rows: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """The k largest with their running sum."""
    best = rows.orderBy(F.desc(column), key).limit(k)
    return best.select(key, column, F.sum(column).over(Window.orderBy(F.desc(column), key).rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
