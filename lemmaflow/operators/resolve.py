"""From surface names to full names of a corpus ``(seq, full_name)``, by equi-joins on exploded keys and a ranking of what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_name
from ..plans.durable import materialize


def last_part(c):
    return F.substring_index(c, ".", -1)


def name_set(corpus: DataFrame) -> DataFrame:
    return corpus.select("full_name").distinct()


def first_seen(corpus: DataFrame) -> DataFrame:
    """Distinct names with the place where each comes first."""
    return corpus.groupBy("full_name").agg(F.min("seq").alias("seq"))


def suffix_index(corpus: DataFrame) -> DataFrame:
    return name_set(corpus).groupBy(last_part(F.col("full_name")).alias("suffix")).agg(F.count("*").alias("n"), F.min("full_name").alias("first_name"))


def k_suffix_index(corpus: DataFrame, k: int = 6) -> DataFrame:
    """(suffix of 2 to k parts, full_name) for every name."""
    parts = F.split("full_name", "[.]")
    n = F.size(parts)
    keys = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(k), n))), lambda i: F.when(i <= n, F.array_join(F.slice(parts, n - i + 1, i), ".")))
    return name_set(corpus).filter(n >= 2).select(F.explode(F.array_compact(keys)).alias("suffix"), "full_name").distinct()


def resolve(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``refs(ref_id, surface, hint, namespaces array, types array of namespaces)`` -> ``(ref_id, full_name, method, confidence, n_candidates)``.

    In order: hint in the corpus, exact, (no name of that suffix: not found), first open namespace that completes it, first type namespace with a candidate, only candidate, first candidate.
    'First' is the order of the corpus."""
    names = first_seen(corpus)
    options = []

    def found(keys: DataFrame, rank: int, method, confidence: float) -> None:
        hit = keys.join(names.withColumnRenamed("full_name", "key"), "key")
        options.append(hit.select("ref_id", F.col("key").alias("full_name"), F.lit(rank).alias("rank"), F.col("place").cast("long").alias("place"), "seq", method.alias("method"), F.lit(confidence).alias("confidence")))

    found(refs.select("ref_id", F.col("hint").alias("key"), F.lit(0).alias("place")), 1, F.lit("annotation"), 1.0)
    found(refs.select("ref_id", F.col("surface").alias("key"), F.lit(0).alias("place")), 2, F.lit("exact_match"), 1.0)
    spaced = refs.select("ref_id", "surface", F.posexplode("namespaces").alias("place", "ns"))
    found(spaced.select("ref_id", F.concat_ws(".", "ns", "surface").alias("key"), "place"), 3, F.lit("namespace_match"), 0.95)
    by_suffix, by_prefix = suffix_firsts(names)
    tails = refs.select("ref_id", "types", last_part(F.col("surface")).alias("suffix"))
    typed = tails.select("ref_id", "suffix", F.posexplode("types").alias("place", "ns")).join(by_prefix, ["suffix", "ns"])
    options.append(typed.select("ref_id", "f.full_name", F.lit(4), F.col("place").cast("long"), "f.seq", F.concat(F.lit("type_inference:"), "ns"), F.lit(0.8)))
    some = tails.join(by_suffix, "suffix").select("ref_id", "n_candidates", "f")
    only = F.col("n_candidates") == 1
    options.append(some.select("ref_id", "f.full_name", F.lit(5), F.lit(0).cast("long"), "f.seq", F.when(only, "unique_suffix").otherwise("ambiguous"), F.when(only, 0.6).otherwise(0.3)))
    union = options[0]
    for o in options[1:]:
        union = union.union(o)
    best = union.groupBy("ref_id").agg(F.min(F.struct("rank", "place", "seq", "full_name", "method", "confidence")).alias("b"))
    out = refs.select("ref_id", "surface").join(best, "ref_id", "left").join(some.select("ref_id", "n_candidates"), "ref_id", "left")
    return out.select("ref_id", "surface", F.coalesce("b.full_name", "surface").alias("full_name"), F.coalesce("b.method", F.lit("not_found")).alias("method"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def suffix_firsts(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names(full_name, seq)`` -> ``(suffix, n_candidates, f)`` and ``(suffix, ns, f)``: number and first name of each last part, and the first name of each last part below each namespace.
    References meet one row of these, not all names of a common last part."""
    first, parts = F.min(F.struct("seq", "full_name")).alias("f"), F.split("full_name", "[.]")
    tails = names.select("full_name", "seq", last_part(F.col("full_name")).alias("suffix"))
    spaces = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    below = tails.filter(F.size(parts) > 1).select("full_name", "seq", "suffix", F.explode(spaces).alias("ns"))
    return tails.groupBy("suffix").agg(F.count("*").alias("n_candidates"), first), below.groupBy("suffix", "ns").agg(first)


def resolve_first(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """The first version: ``refs(ref_id, surface, types)`` -> ``(ref_id, full_name, resolved_by)``: exact, not_found, unique, the first candidate below a namespace of the types, else the first of all, as ambiguous with their number."""
    names = first_seen(corpus)
    by_suffix, by_prefix = suffix_firsts(names)
    tails = refs.select("ref_id", "surface", "types", last_part(F.col("surface")).alias("suffix"))
    typed = tails.select("ref_id", "suffix", F.explode("types").alias("ns")).join(by_prefix, ["suffix", "ns"]).groupBy("ref_id").agg(F.min(F.struct("f.seq", "f.full_name", "ns")).alias("t"))
    out = tails.join(by_suffix, "suffix", "left").join(typed, "ref_id", "left").join(names.select(F.col("full_name").alias("surface"), F.lit(True).alias("exact")), "surface", "left")
    how = F.when(F.col("exact"), "exact").when(F.col("n_candidates").isNull(), "not_found").when(F.col("n_candidates") == 1, "unique")
    how = how.when(F.col("t").isNotNull(), F.concat(F.lit("type_hint:"), "t.ns")).otherwise(F.concat(F.lit("ambiguous:"), F.col("n_candidates").cast("string")))
    full = F.when(F.col("exact") | F.col("n_candidates").isNull(), F.col("surface")).when((F.col("n_candidates") > 1) & F.col("t").isNotNull(), F.col("t.full_name")).otherwise(F.col("f.full_name"))
    return out.select("ref_id", full.alias("full_name"), how.alias("resolved_by"))


def suffix_match(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``refs(ref_id, surface)`` -> ``(ref_id, full_name)`` of the first name of the corpus that equals the surface or ends in it after a dot; refs without one have no row. An equi-join on the
    suffixes, of each of which only the first name is kept."""
    parts = F.split("full_name", "[.]")
    tails = first_seen(corpus).select("full_name", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("surface"))
    firsts = tails.groupBy("surface").agg(F.min(F.struct("seq", "full_name"))["full_name"].alias("full_name"))
    return refs.select("ref_id", "surface").join(firsts, "surface").select("ref_id", "full_name")


def match_rate(statements: DataFrame, corpus: DataFrame, n: int = 1000, seed: int = 42, k: int = 10) -> DataFrame:
    """``statements(id, statement)`` -> ``(measure, name, n, percent)``: of a seeded sample of ``n`` statements, those whose declared name is found in the corpus and those where it isn't, and the ``k``
    names that fail most often (ties by name). A statement that is null or declares no name fails, with an empty name. The order of the sample is by a hash of the id."""
    sample = statements.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}"))), "id").limit(n)
    named = sample.select(F.monotonically_increasing_id().alias("ref_id"), F.coalesce(short_name(F.col("statement")), F.lit("")).alias("surface"))
    named = materialize(named, "sample", n)
    hits = suffix_match(named.filter("surface <> ''"), corpus).select("ref_id", F.lit(True).alias("hit"))
    judged = named.join(hits, "ref_id", "left").withColumn("measure", F.when(F.col("hit"), "matched").otherwise("failed"))
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)  # over two rows, then over the names of the sample
    rates = judged.groupBy("measure").agg(F.count("*").alias("n")).select("measure", F.lit(None).cast("string").alias("name"), "n", share.alias("percent"))
    failed = judged.filter("measure = 'failed'").groupBy(F.col("surface").alias("name")).agg(F.count("*").alias("n")).select(F.lit("failed_name").alias("measure"), "name", "n", share.alias("percent"))
    return rates.union(failed.orderBy(F.desc("n"), "name").limit(k))


def match_kinds(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """``names(name, n)`` -> exact, suffix, qualified suffix or none."""
    known = name_set(corpus)
    parts = F.split("full_name", "[.]")
    tails = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 100), "."))).alias("name")).distinct()
    marked = names.join(known.select(F.col("full_name").alias("name"), F.lit(1).alias("exact")), "name", "left").join(tails.withColumn("tail", F.lit(1)), "name", "left")
    kind = F.when(F.col("exact") == 1, "exact").when((F.col("tail") == 1) & ~F.col("name").contains("."), "suffix").when(F.col("tail") == 1, "qualified_suffix").otherwise("none")
    return marked.select("name", "n", kind.alias("kind"))


def in_vs_out(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """Occurrences and names in and out of the corpus, with shares."""
    total = Window.partitionBy()
    marked = names.join(name_set(corpus).select(F.col("full_name").alias("name"), F.lit(True).alias("known")), "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    by = marked.groupBy("known").agg(F.count("*").alias("names"), F.sum("n").alias("occurrences"))
    return by.withColumn("percent", F.round(100 * F.col("occurrences") / F.sum("occurrences").over(total), 6))


def probe(names: DataFrame, probes: list[str], k: int = 10) -> DataFrame:
    """For each probe the first k names that equal, end in or contain it. One pass: the probes are few and part of the plan."""
    hits = names.select("full_name", F.explode(F.array(*map(F.lit, probes))).alias("probe")).filter(F.col("full_name").contains(F.col("probe")))
    kind = F.when(F.col("full_name") == F.col("probe"), "exact").when(F.col("full_name").endswith(F.concat(F.lit("."), "probe")), "suffix").otherwise("contains")
    order = Window.partitionBy("probe", "kind").orderBy("full_name")
    return hits.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("probe", "kind", "full_name")


def _grams(c: str, n):
    """All runs of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n)))


def probe_all(names: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    """``names(full_name)``, ``probes(probe)`` -> for each probe and kind the first k names that equal, end in (after a dot) or contain it. For any number of probes.

    Names are posted under their runs of three characters; a probe looks up the rarest of its own (one of one or two characters looks up itself), and what it finds is verified. So every join is
    on equal keys, and a probe with a run that no name has meets nothing. Nulls and empty probes find nothing."""
    asked = probes.select("probe").filter("probe <> ''").distinct()
    runs = asked.select("probe", F.explode(_grams("probe", F.least(F.lit(3), F.length("probe")))).alias("gram"))
    known = names.select("full_name").filter("full_name <> ''").distinct()
    every = F.flatten(F.array(*[F.when(F.length("full_name") >= n, _grams("full_name", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    posted = known.select("full_name", F.explode(every).alias("gram")).join(runs.select("gram").distinct(), "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = runs.join(counts, "gram", "left").groupBy("probe").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    hits = posted.join(rarest.select("probe", F.col("r.gram").alias("gram")), "gram").filter(F.col("full_name").contains(F.col("probe")))
    kind = F.when(F.col("full_name") == F.col("probe"), "exact").when(F.col("full_name").endswith(F.concat(F.lit("."), "probe")), "suffix").otherwise("contains")
    order = Window.partitionBy("probe", "kind").orderBy("full_name")
    return hits.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("probe", "kind", "full_name")


def first_definition(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs(name)``, ``files(name, file, seq)``: whether a name is defined in the files, and in which first."""
    first = files.groupBy("name").agg(F.min(F.struct("seq", "file"))["file"].alias("file"))
    return refs.join(first, "name", "left").withColumn("defined_locally", F.col("file").isNotNull())


def peel(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """``candidates(name)`` -> ``(name, peeled)``: the name if known; else without its last part, if that is known or the part is a projection; else its longest known prefix; else itself."""
    known = name_set(corpus).select(F.col("full_name").alias("prefix"))
    parts = F.split("name", "[.]")
    n = F.size(parts)
    prefixes = candidates.select("name").distinct().select("name", n.alias("parts"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("size"), F.array_join(F.slice(parts, 1, i), ".").alias("prefix")))).alias("p")).select("name", "parts", "p.*")
    best = prefixes.join(known, "prefix", "left_semi").groupBy("name").agg(F.max(F.struct("size", "prefix")).alias("b"))
    last, base = F.substring_index("name", ".", -1), F.regexp_replace("name", r"\.[^.]*$", "")
    projection = (n > 1) & (last.rlike(r"^\d+$") | last.isin("mp", "mpr", "symm", "trans"))
    found = F.when(F.col("b.size") >= n - 1, F.col("b.prefix")).when(projection, base).otherwise(F.coalesce("b.prefix", "name"))
    return candidates.select("name").distinct().join(best, "name", "left").select("name", found.alias("peeled"))


def resolve_candidates(refs: DataFrame, corpus: DataFrame, k: int = 6) -> DataFrame:
    """``refs(ref_id, token, file)``, ``corpus(seq, full_name, file)`` -> ``(ref_id, full_name, kind)``: full name, else a suffix of two or more parts, else the last part; the same file first, then fewest dots, then the name."""
    names = corpus.groupBy("full_name").agg(F.min("file").alias("in_file"))
    full = refs.join(names.withColumn("token", F.col("full_name")), "token").select("ref_id", "full_name", "file", "in_file", F.lit(1).alias("rank"), F.lit("full").alias("kind"))
    tails = k_suffix_index(corpus, k).join(names, "full_name").withColumnRenamed("suffix", "token")
    suffix = refs.join(tails, "token").select("ref_id", "full_name", "file", "in_file", F.lit(2), F.lit("suffix"))
    base = refs.withColumn("b", last_part(F.col("token"))).join(names.withColumn("b", last_part(F.col("full_name"))), "b").select("ref_id", "full_name", "file", "in_file", F.lit(3), F.lit("base"))
    order = F.struct("rank", F.when(F.col("in_file") == F.col("file"), 0).otherwise(1).alias("other_file"), (F.length("full_name") - F.length(F.replace("full_name", F.lit("."), F.lit("")))).alias("dots"), "full_name", "kind")
    return full.union(suffix).union(base).groupBy("ref_id").agg(F.min(order).alias("b")).select("ref_id", "b.full_name", "b.kind")
