"""Registers, lookups, samples and reports: small relational operators on theorem, premise and graph tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.candidates import identifier_category, identifiers, lemma_candidates
from ..plans.durable import materialize
from .resolve import peel
from .stats import rounded

#: Names that are tactics, and beginnings of local names, among names without a match.
TACTIC_NAMES = ["classical", "filter_upwards", "infer_instance", "mod_cast", "mono", "push_cast", "rwa", "split_ifs", "tfae_finish", "tfae_have"]
LOCAL_STARTS = ["h.", "h_", "hf_", "hp_", "this."]


def theorem_registry(theorems: DataFrame, steps: DataFrame) -> DataFrame:
    """``theorems(theorem, file)``, ``steps(theorem)`` -> ``(theorem, file, num_tactics, has_tactics)``."""
    n = steps.groupBy("theorem").agg(F.count("*").alias("num_tactics"))
    out = theorems.join(n, "theorem", "left").withColumn("num_tactics", F.coalesce("num_tactics", F.lit(0)))
    return out.select("theorem", "file", "num_tactics", (F.col("num_tactics") > 0).alias("has_tactics"))


def import_graph(files: DataFrame) -> DataFrame:
    """``files(path, imports array)`` -> distinct ``(src, dst, module)``; the module is the import's first dotted part."""
    return files.select(F.col("path").alias("src"), F.explode("imports").alias("dst")).distinct().withColumn("module", F.substring_index("dst", ".", 1))


def import_nodes(edges: DataFrame) -> DataFrame:
    """``(id, n_imports, n_importers)`` of all files that import or are imported."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_imports"), F.sum("i").alias("n_importers"))


def clean_rewrite(refs: DataFrame) -> DataFrame:
    """``refs(theorem, name)`` without tactic and hypothesis names, counted anew: ``(theorem, n_refs, n_names, n_dropped)``."""
    kept = ~t.is_tactic_or_hypothesis(F.col("name"))
    return refs.groupBy("theorem").agg(F.count_if(kept).alias("n_refs"), F.count_distinct(F.when(kept, F.col("name"))).alias("n_names"), F.count_if(~kept).alias("n_dropped"))


def proof_lookup(names: DataFrame, traced: DataFrame, corpus: DataFrame) -> DataFrame:
    """``names(name)``, ``traced(name, statement, proof)``, ``corpus(name, code)`` -> statement and proof from the traced table, else the statement from the code, up to its ':=' or ' where'."""
    code = corpus.select("name", F.substring_index(F.substring_index("code", ":=", 1), " where", 1).alias("code"))
    out = names.join(traced, "name", "left").join(code, "name", "left")
    source = F.when(F.col("statement").isNotNull(), "traced").when(F.col("code").isNotNull(), "corpus").otherwise("none")
    return out.select("name", F.coalesce("statement", t.strip(F.col("code"))).alias("statement"), "proof", source.alias("source"))


def nomatch_class(name: Column) -> Column:
    """Why a name may have no match: the first rule that holds."""
    local = F.lit(False)
    for x in LOCAL_STARTS:
        local = local | name.startswith(x)
    kind = F.when(name.isin(TACTIC_NAMES) | name.startswith("by_"), "looks_like_tactic").when(local | (name == "this"), "looks_like_local")
    return kind.when(name.rlike(r"^\p{Lu}") & ~name.contains("_") & ~name.contains("."), "looks_like_type").when(name.contains("."), "qualified_but_wrong_ns").otherwise("other")


def nomatch_classes(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """``names(name, n)`` that aren't in ``corpus(full_name)``, by class: ``(class, n_names, n)``."""
    left = names.join(corpus.select(F.col("full_name").alias("name")), "name", "left_anti")
    return left.groupBy(nomatch_class(F.col("name")).alias("class")).agg(F.count("*").alias("n_names"), F.sum("n").alias("n"))


def candidate_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct ``(theorem, name)`` of one version that the other lacks, with the version that has it."""
    a, b = first.select("theorem", "name").distinct(), second.select("theorem", "name").distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).union(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def unresolved_examples(refs: DataFrame, k: int = 10) -> DataFrame:
    """``refs(theorem, name, confidence)``: the k unresolved names (confidence 0) that sort first, each with its first theorem."""
    return refs.filter("confidence = 0").groupBy("name").agg(F.min("theorem").alias("theorem")).orderBy("name").limit(k)


def unresolved_names(refs: DataFrame) -> DataFrame:
    """``refs(theorem, name, confidence)`` -> ``(name, n, min_confidence, percent)`` of the names whose least confidence is 0; percent is their share of all distinct names, the same on each row."""
    names = refs.groupBy("name").agg(F.count("*").alias("n"), F.min("confidence").alias("min_confidence"))
    share = names.agg(rounded(100 * F.count_if(F.col("min_confidence") == 0) / F.count("*")).alias("percent"))  # one row
    return names.filter("min_confidence = 0").crossJoin(F.broadcast(share))


def unresolved_share_histogram(refs: DataFrame, bins: int = 50) -> DataFrame:
    """``(bin, n)``: theorems by the percentage of their references of confidence 0, in ``bins`` bins of 0 to 100, the last one closed."""
    share = refs.groupBy("theorem").agg((F.count_if(F.col("confidence") == 0) * bins / F.count("*")).alias("x"))
    return share.groupBy(F.least(F.floor("x"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def mdl_baselines(rows: DataFrame, degrees: DataFrame, tactic_vocab: int = 278, premise_vocab: int = 99412) -> DataFrame:
    """``rows`` of mdl_gain and ``degrees(theorem, in_degree, out_degree)`` -> four baselines of the gain of each theorem: random (the cost alone), single use, citations only (with the
    medians of pattern length and cost) and perfect (used along all edges)."""
    bt, br = math.log2(tactic_vocab), math.log2(premise_vocab)
    medians = rows.agg(F.median("pattern_length").alias("mp"), F.median("cost").alias("mc"))  # one row
    out = rows.join(degrees, "theorem", "left").na.fill(0, ["in_degree", "out_degree"]).crossJoin(F.broadcast(medians))
    single = F.greatest((F.col("pattern_length") - 1) * bt - br - F.col("cost"), -F.col("cost"))
    citation = F.col("num_uses") * (F.col("mp") * bt - br) - F.col("mc")
    perfect = (F.col("in_degree") + F.col("out_degree")) * (F.col("pattern_length") * bt - br) - F.col("cost")
    return out.select("theorem", rounded(-F.col("cost"), 3).alias("random"), rounded(single, 3).alias("single_use"), rounded(citation, 3).alias("citation_only"), rounded(perfect, 3).alias("perfect"))


def parseability(steps: DataFrame) -> DataFrame:
    """``steps(theorem, before, after)`` -> per theorem: steps, those whose states can be read as goals, and those with more than one goal."""
    goals = lambda c: F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit("⊢"))
    after = t.strip(F.coalesce(F.col("after"), F.lit(""))).isin("", "no goals") | (goals("after") > 0)
    return steps.groupBy("theorem").agg(
        F.count("*").alias("num_tactics"), F.count_if(goals("before") > 0).alias("parseable_before"), F.count_if(after).alias("parseable_after"), F.count_if(F.greatest(goals("before"), goals("after")) > 1).alias("multi_goal_steps")
    )


def seen_graph(edges: DataFrame, depth: DataFrame, cutoff: int, strict: bool = True) -> DataFrame:
    """The edges between nodes of a depth below ``cutoff`` (or up to it, if not ``strict``)."""
    seen = materialize(depth.filter(F.col("depth") < cutoff if strict else F.col("depth") <= cutoff).select("id"), "seen")
    return edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def mixture(parents: DataFrame, label: str) -> DataFrame:
    """``parents(id, <label>)``: how many labels the parents of each node have, and the entropy of their shares in nats."""
    n = parents.groupBy("id", label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("id"))
    return n.select("id", p.alias("p")).groupBy("id").agg(F.count("*").alias(f"n_{label}"), rounded(F.abs(F.sum(-F.col("p") * F.ln("p")))).alias(f"{label}_entropy"))


def coverage_table(rows: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """Mean of ``value`` for each ``row`` and each of the given ``columns``."""
    return rows.groupBy(row).pivot(column, columns).agg(rounded(F.avg(value), 4))


def goal_blocks(state: Column) -> Column:
    """The goals of a state, cut at blank lines or, without any, before lines that start with "case ": case label, lines before the target, (name, type) of what they declare, target.

    Null, empty states and "no goals" have none, and neither has a block without a turnstile. What stands before the first case belongs to no goal."""
    text = F.regexp_replace(F.coalesce(state, F.lit("")), "\r\n", "\n")
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: t.strip(b) != "")
    cases = F.split(F.regexp_replace(F.get(blocks, F.lit(0)), r"(?U)\n[ \t]*(?=\n)", ""), r"\n(?=case )")
    cases = F.when(F.exists(cases, lambda b: b.startswith("case ")), F.filter(cases, lambda b: b.startswith("case "))).otherwise(cases)
    blocks = F.filter(F.when(F.size(blocks) == 1, cases).otherwise(blocks), lambda b: b.contains("⊢"))
    label = lambda b: F.when(b.startswith("case "), t.strip(F.regexp_extract(b, r"^case ([^\n]*)", 1)))
    before = lambda b: F.filter(F.split(F.regexp_replace(F.substring_index(b, "⊢", 1), r"^case [^\n]*(\n|\z)|(?<=\n)[^\n]*\z", ""), "\n"), lambda x: t.strip(x) != "")
    names = lambda x: F.transform(t.words(F.regexp_extract(x, r"^([^\s:][^:]*?)\s*:", 1)), lambda n: F.struct(n.alias("name"), t.collapse(F.regexp_extract(x, r"^[^\s:][^:]*?\s*:\s*(.*)$", 1)).alias("type")))
    goal = lambda b: t.collapse(F.regexp_extract(b, r"(?s)⊢(.*)$", 1))
    return F.transform(blocks, lambda b: F.struct(label(b).alias("case_label"), before(b).alias("hypotheses"), F.flatten(F.transform(before(b), names)).alias("declared"), goal(b).alias("target")))


def validation_alignment(steps: DataFrame) -> DataFrame:
    """``steps(theorem, before, after, is_terminal)`` -> per theorem the share of steps whose states can be read (nodes), and of those with an active goal that goes on or ends (edges)."""
    rows = steps.select("theorem", goal_blocks(F.col("before")).alias("b"), (F.size(goal_blocks(F.col("after"))) > 0).alias("goes_on"), t.strip(F.coalesce("after", F.lit(""))).isin("", "no goals").alias("done"), "is_terminal")
    active = F.coalesce(F.get("b", F.lit(0))["target"], F.lit("")) != ""
    share = lambda c: rounded(F.avg(F.coalesce(c, F.lit(False)).cast("int")))
    return rows.groupBy("theorem").agg(F.count("*").alias("num_tactics"), share((F.size("b") > 0) & (F.col("done") | F.col("goes_on"))).alias("node_alignment_rate"), share(active & (F.col("goes_on") | F.col("is_terminal"))).alias("edge_alignment_rate"))


def annotate_premises(tactics: DataFrame, spans: DataFrame) -> DataFrame:
    """``tactics(seq, tactic)``, ``spans(seq, start, stop, full_name)`` (characters from 0) -> the tactic with its premises in <a> tags and their names, from left to right; a span that starts
    within one already taken is left out, the longer of two that start together is taken. A tactic without spans stays as it is."""
    per = spans.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("stop")).alias("back"), "full_name"))).alias("spans"))
    nothing = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("names"))

    def take(a, x):
        start, stop = x["start"].cast("long"), (-x["back"]).cast("long")
        cut = lambda i, j: F.substr(F.col("tactic"), (i + 1).cast("int"), (j - i).cast("int"))
        taken = F.struct(F.concat(a["text"], cut(a["at"], start), F.lit("<a>"), cut(start, stop), F.lit("</a>")).alias("text"), stop.alias("at"), F.concat(a["names"], F.array(x["full_name"])).alias("names"))
        return F.when(start >= a["at"], taken).otherwise(a)

    out = tactics.join(per, "seq", "left").withColumn("a", F.aggregate(F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)), nothing, take))
    return out.select("seq", F.concat("a.text", F.substr("tactic", (F.col("a.at") + 1).cast("int"))).alias("annotated"), "a.names")


def proof_candidates(blocks: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``blocks(proof, block, text)`` -> ``(proof, block, candidate)``, each name once a block; with ``corpus(full_name)`` names are peeled to known ones."""
    rows = blocks.select("proof", "block", F.explode(lemma_candidates(F.col("text"))).alias("candidate"))
    if corpus is None:
        return rows
    peeled = peel(rows.select(F.col("candidate").alias("name")), corpus).withColumnRenamed("name", "candidate")
    return rows.join(peeled, "candidate").select("proof", "block", F.col("peeled").alias("candidate")).distinct()


def block_names(blocks: DataFrame) -> DataFrame:
    """``blocks(proof, block, text)`` -> per proof and distinct trimmed text the sorted names of each class; blocks of the same text become one.

    Blocks are shuffled before their names are listed, so no task lists the names of a whole input file; both groupings keep that partitioning."""
    placed = blocks.select("proof", t.strip(F.col("text")).alias("trimmed"), "text").repartition("proof", "trimmed")
    rows = placed.select("proof", F.col("trimmed").alias("text"), F.explode(identifiers(F.col("text"))).alias("name")).distinct()
    return rows.groupBy("proof", "text", identifier_category(F.col("name")).alias("category")).agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))


def ego_proof_report(ego: DataFrame, traced: DataFrame, corpus: DataFrame) -> DataFrame:
    """``ego(name)``, ``traced(name, statement, proof)``, ``corpus(name, code)`` -> ``(name, source, entry)`` sorted by name; the entry is a section in Markdown."""
    rows = ego.select("name").distinct().join(traced, "name", "left").join(corpus.select("name", "code"), "name", "left")
    source = F.when(F.col("proof").isNotNull() | F.col("statement").isNotNull(), "traced").when(F.col("code").isNotNull(), "corpus").otherwise("none")
    text = F.when(source == "traced", F.coalesce("proof", F.lit(""))).otherwise(F.coalesce("code", F.lit("")))
    head = F.when((source == "traced") & (F.coalesce("statement", F.lit("")) != ""), F.concat(F.lit("**Statement:** `"), "statement", F.lit("`\n\n"))).otherwise("")
    body = F.when(text != "", F.concat(head, F.lit("```lean\n"), text, F.lit("\n```"))).otherwise("*Proof not available*")
    return rows.select("name", source.alias("source"), F.concat(F.lit("## "), F.col("name").cast("string"), F.lit("\n\n"), body).alias("entry")).orderBy("name")


def extreme_egos(edges: DataFrame, extremes: DataFrame, k: int = 3, most: int = 50) -> DataFrame:
    """``extremes(measure, side, id, degree)`` (of ``graph.extreme_nodes``) -> ``(measure, side, centre, id)``: the nodes around the k centres of each measure and side that have the highest priority.

    A centre counts for its first measure and side. Its priority is its number of neighbours and one, times 1 + degree / the highest degree on the high side of in and out, times a half on their
    low side. An ego network has at most ``most`` nodes: the centre and the neighbours of most neighbours."""
    both = materialize(edges.select(F.col("src").alias("id"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct(), "near")
    n = materialize(both.groupBy("id").agg(F.count("*").alias("n")), "near-counts")
    top = extremes.groupBy("measure").agg(F.max("degree").alias("top"))  # the highest is among the extremes
    first = extremes.groupBy("id").agg(F.min(F.struct("measure", "side", "degree")).alias("x")).select("id", "x.*").join(n, "id").join(F.broadcast(top), "measure")
    factor = F.when(F.col("measure") == "total", 1.0).when(F.col("side") == "high", 1 + F.col("degree") / F.col("top")).otherwise(0.5)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("measure", "side").orderBy(F.desc((1 + F.col("n")) * factor), "id"))).filter(F.col("r") <= k)
    centres = F.broadcast(best.select("measure", "side", F.col("id").alias("centre")))  # k for each measure and side
    around = both.join(centres, F.col("id") == F.col("centre")).select("measure", "side", "centre", F.col("near").alias("id")).join(n, "id")
    kept = around.withColumn("r", F.row_number().over(Window.partitionBy("measure", "side", "centre").orderBy(F.desc("n"), "id"))).filter(F.col("r") < most)
    return kept.select("measure", "side", "centre", "id").union(best.select("measure", "side", F.col("id").alias("centre"), "id"))
