"""Column functions on tactic strings, proof states, names and paths. All built in; none is a UDF.

White space is Java's Unicode-aware class (``(?U)``) where the data may hold more than ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\b"

#: Words that the first version of surface premises leaves out.
FIRST_KEYWORDS = [
    "apply", "at", "by", "calc", "cases", "congr", "constructor", "conv", "decide", "do", "else", "exact", "ext", "from", "fun", "have", "if", "in", "induction", "intro", "intros", "let", "linarith",
    "match", "obtain", "omega", "only", "rcases", "refine", "refl", "return", "rfl", "ring", "rw", "show", "simp", "simp_rw", "then", "trivial", "using", "where", "with",
]
#: Tactic keywords that identifier references leave out.
REFERENCE_KEYWORDS = [
    "aesop", "all_goals", "apply", "assumption", "by", "calc", "case", "cases", "change", "choose", "congr", "constructor", "contrapose", "convert", "exact", "ext", "field_simp", "first", "fun",
    "guard_hyp", "guard_target", "have", "induction", "intro", "intros", "left", "let", "linarith", "nlinarith", "norm_num", "obtain", "omega", "positivity", "rcases", "refine", "rename_i", "repeat",
    "revert", "rfl", "right", "ring", "rintro", "rw", "rwa", "set", "show", "simp", "simpa", "skip", "specialize", "split", "split_ifs", "subst", "suffices", "symm", "tidy", "trivial",
]
#: Words that are tactics or syntax, not names of results.
TACTIC_KEYWORDS = [
    "aesop", "apply", "at", "by", "by_cases", "by_contra", "calc", "cases", "classical", "congr", "constructor", "contrapose", "conv", "decide", "do", "else", "exact", "ext",
    "field_simp", "from", "fun", "have", "if", "in", "induction", "intro", "intros", "left", "let", "linarith", "match", "nlinarith", "norm_num", "obtain", "omega", "only",
    "polyrith", "positivity", "push_neg", "rcases", "refine", "refl", "return", "rfl", "right", "ring", "rintro", "rw", "show", "simp", "simp_all", "simp_rw", "split", "then",
    "trivial", "using", "where", "with",
]

#: Last name parts that mean a tactic or a local hypothesis.
TACTIC_OR_HYPOTHESIS = [
    "ac_rfl", "aesop", "apply", "assumption", "by", "cases", "congr", "constructor", "contrapose", "convert", "decide", "era", "erw", "exact", "ext", "field_simp", "from", "gcongr",
    "h1", "h2", "h3", "ha", "hb", "hc", "hd", "he", "hf", "hh", "hi", "hj", "hk", "hl", "hm", "hn", "ho", "hp", "hq", "hr", "hs", "ht", "hu", "hv", "hw", "hx", "hy", "hz", "have", "ih",
    "induction", "intro", "intros", "left", "linarith", "mp", "mpr", "native_decide", "nlinarith", "norm_num", "obtain", "omega", "polyrith", "positivity", "push_neg", "rcases",
    "refine", "refl", "rel_simp", "rfl", "right", "ring", "rw", "rwa", "show", "simp", "simpa", "split", "symm", "that", "this", "tidy", "trivial",
]

#: Marks of a type that states a relation.
RELATIONS = ["=", "≤", "≥", "<", ">", "∈", "⊆", "∣"]

#: Fixed values: (a mark in a type, the namespace it speaks for), in the order in which namespaces are tried.
TYPE_NAMESPACES = [("ℕ|Nat", "Nat"), ("ℤ|Int", "Int"), ("ℚ|Rat", "Rat"), ("ℝ|Real", "Real"), ("List", "List"), ("Set", "Set"), ("Finset", "Finset"), ("Array", "Array"), ("BitVec", "BitVec"), ("Matrix", "Matrix"), ("Polynomial", "Polynomial")]

#: Prefixes by which tactic families are told, in the order in which they are tried.
FAMILIES = [("simp_all", "simp_all"), ("simp_rw", "simp_rw"), ("simp", "simp"), ("rw", "rw"), ("rewrite", "rw"), ("intro", "intro"), ("rintro", "intro"), ("cases", "cases"), ("rcases", "cases"), ("ext", "ext"), ("constructor", "constructor"), ("apply", "apply"), ("exact", "exact"), ("aesop", "aesop")]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one blank, ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+", -1), "")


# --- tactics


def head_word(tactic: Column) -> Column:
    """First word, 'unknown' if there is none."""
    return F.coalesce(F.get(words(tactic), F.lit(0)), F.lit("unknown"))


def head_ident(tactic: Column) -> Column:
    """First identifier after leading bullets and bars; 'case' before all else."""
    t = F.regexp_replace(strip(F.coalesce(tactic, F.lit(""))), r"(?U)^([·|;]\s*)+", "")
    found = F.regexp_extract(t, IDENTIFIER, 1)
    return F.when(t.startswith("case "), "case").when(found == "", "unknown").otherwise(found)


def head_bucket(tactic: Column) -> Column:
    w = head_word(F.coalesce(tactic, F.lit("")))
    return F.when(w == "·", "bullet").when(w.isin("/", "|", "&", "-", "+", "*"), "tactical").otherwise(w)


def family(tactic: Column) -> Column:
    t = strip(F.coalesce(tactic, F.lit("")))
    first, *rest = FAMILIES
    out = F.when(t.startswith(first[0]), first[1])
    for prefix, name in rest:
        out = out.when(t.startswith(prefix), name)
    return out.when(t.isin("rfl", "decide", "assumption"), t).otherwise("other")


def head_bracket(tactic: Column) -> Column:
    return strip(F.substring_index(tactic, "[", 1))


def bracket_lemmas(tactic: Column) -> Column:
    """Names in the first bracket pair; '*' counts."""
    inside = F.regexp_extract(F.coalesce(tactic, F.lit("")), r"\[([^\]]+)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), strip), lambda t: (t == "*") | t.rlike(r"^[A-Za-z_][A-Za-z0-9_'.]*$"))


def surface_premises(tactic: Column, dedupe: bool = True) -> Column:
    """Identifiers that may name results: no keywords, single letters, or usual names of hypotheses."""
    found = F.regexp_extract_all(F.coalesce(tactic, F.lit("")), F.lit(IDENTIFIER), F.lit(1))
    kept = F.filter(found, lambda m: ~F.lower(m).isin(TACTIC_KEYWORDS) & (F.length(m) > 1) & ~m.rlike(r"^h\d*$") & ~m.isin("this", "ih", "IH"))
    return F.array_distinct(kept) if dedupe else kept


def surface_premises_first(tactic: Column) -> Column:
    """The first version: a shorter list of keywords, usual names of hypotheses stay, and so do repeated names."""
    found = F.regexp_extract_all(F.coalesce(tactic, F.lit("")), F.lit(IDENTIFIER), F.lit(1))
    return F.filter(found, lambda m: ~F.lower(m).isin(FIRST_KEYWORDS) & (F.length(m) > 1))


def identifier_refs(tactic: Column) -> Column:
    """All undotted identifiers that aren't tactic keywords, repeated as they occur."""
    return F.filter(F.regexp_extract_all(F.coalesce(tactic, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_']*"), F.lit(0)), lambda m: ~m.isin(REFERENCE_KEYWORDS))


def is_tactic_or_hypothesis(name: Column) -> Column:
    last = F.lower(strip(F.element_at(F.split(name, "[.]", -1), -1)))
    return name.isNull() | (name == "") | last.isin(TACTIC_OR_HYPOTHESIS)


# --- states


def state_context(state: Column) -> Column:
    """Struct of variables (name -> type), hypotheses (name -> type), typeclasses, goal and goal_type.

    A line that starts with the turnstile starts the goal, later lines go on with it. Of the declarations before, those of instances are type classes; a name is a
    hypothesis if it starts with h and its second letter isn't upper case, or if its type states a relation."""
    lines = F.filter(F.transform(F.split(F.coalesce(state, F.lit("")), "\n"), strip), lambda x: x != "")
    turns = F.transform(lines, lambda x: x.startswith("⊢"))
    first = F.array_position(turns, True).cast("int")
    before = F.when(first > 0, F.slice(lines, 1, first - 1)).otherwise(lines)
    after = F.when(first > 0, F.slice(lines, first, F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    # A further turnstile line starts the goal anew.
    last = F.aggregate(F.transform(after, lambda x, i: F.when(x.startswith("⊢"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    goal = F.array_join(F.transform(F.slice(after, F.greatest(last, F.lit(1)), F.greatest(F.size(after), F.lit(1))), lambda x: F.when(x.startswith("⊢"), strip(F.substr(x, F.lit(2)))).otherwise(x)), " ")
    declared = F.filter(before, lambda x: x.contains(" : "))
    names, type_ = (lambda x: F.substring_index(x, " : ", 1)), (lambda x: F.regexp_replace(x, r"(?s)^.*? : ", ""))
    is_class = lambda x: x.startswith("inst") | names(x).contains("✝")
    classes = F.transform(F.filter(declared, is_class), type_)
    pairs = F.flatten(F.transform(F.filter(declared, lambda x: ~is_class(x)), lambda x: F.transform(words(names(x)), lambda n: F.struct(n.alias("name"), strip(type_(x)).alias("type")))))
    relation = "|".join(RELATIONS)
    hyp = lambda p: (p["name"].rlike(r"(?U)^h[^\p{Lu}]")) | p["type"].rlike(relation)
    # The last declaration of a name counts.
    latest = lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: F.size(F.filter(ps, lambda q, j: (q["name"] == p["name"]) & (j > i))) == 0))
    return F.struct(
        latest(F.filter(pairs, lambda p: ~hyp(p))).alias("variables"), latest(F.filter(pairs, hyp)).alias("hypotheses"), classes.alias("typeclasses"),
        goal.alias("goal"), F.regexp_extract(F.regexp_extract(goal, r"^[^ ]*", 0), r"^([A-Za-z_][A-Za-z0-9_]*)", 1).alias("goal_type"),
    )


def goal_counts(state: Column) -> Column:
    return F.regexp_count(F.coalesce(state, F.lit("")), F.lit("⊢"))


def is_terminal(state: Column) -> Column:
    return strip(F.coalesce(state, F.lit(""))).isin("no goals", "goals accomplished")


def goal_signature(target: Column) -> Column:
    return collapse(target)


def declarations(state: Column) -> Column:
    """Names declared in a state, instances left out."""
    lines = F.transform(F.split(F.coalesce(state, F.lit("")), "\n"), strip)
    return F.array_remove(F.array_distinct(F.transform(F.filter(lines, lambda x: x.contains(":") & ~x.contains("⊢") & ~x.startswith("inst")), lambda x: F.regexp_extract(x, r"^([a-zA-Z_][a-zA-Z0-9_′]*)", 1))), "")


def target(state: Column) -> Column:
    goals = F.filter(F.split(F.coalesce(state, F.lit("")), "\n"), lambda x: x.contains("⊢"))
    return F.coalesce(strip(F.regexp_replace(F.get(goals, F.size(goals) - 1), r"^[^⊢]*⊢", "")), F.lit(""))


def goal_diff(before: Column, after: Column) -> Column:
    a, b = declarations(before), declarations(after)
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"), F.array_sort(F.array_intersect(a, b)).alias("kept"), (target(before) != target(after)).alias("target_changed"))


def _matches(pattern: str):
    return lambda t: t.rlike(pattern)


def namespaces_from_types(types: Column) -> Column:
    """Namespaces that an array of types speaks for, in the listed order."""
    return F.array_compact(F.array(*[F.when(F.exists(types, _matches(pattern)), name) for pattern, name in TYPE_NAMESPACES]))


# --- names, paths, statements


def namespace_from_path(path: Column) -> Column:
    ns = F.translate(F.regexp_replace(path, r"\.lean$", ""), "\\/", "..")
    for prefix in ("traced_mathlib4.mathlib4.", "mathlib4.", ".lake.packages."):
        ns = F.when(ns.startswith(prefix), F.substr(ns, F.lit(len(prefix) + 1))).otherwise(ns)
    return ns


def open_namespaces(path: Column, name: Column) -> Column:
    """All prefixes of the path's namespace, and the name's own namespace if it is new."""
    parts = F.when(F.coalesce(path, F.lit("")) != "", F.split(namespace_from_path(path), "[.]", -1)).otherwise(F.array().cast("array<string>"))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(parts)
    own = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when(F.coalesce(own, F.lit("")) != "", F.array_union(prefixes, F.array(own))).otherwise(F.array_distinct(prefixes))


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), 1, 180)


def file_filter(path: Column, part: str) -> Column:
    return F.translate(path, "\\", "/").contains(part.replace("\\", "/"))


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/-.*?-/", ""), r"--[^\n]*", "")


def module_label(*candidates: Column) -> Column:
    """First part of the first candidate that isn't empty, split at dots and slashes; 'unknown' without one."""
    found = F.coalesce(*[F.when(c != "", c) for c in candidates])
    return F.coalesce(F.get(F.split(found, "[./]"), F.lit(0)), F.lit("unknown"))


def short_name(statement: Column) -> Column:
    """Name of a declaration: attributes and the keyword go, then up to a bracket, colon or blank."""
    s = F.regexp_replace(strip(statement), r"^(@\[[^\]]*\]\s*)+", "")
    s = F.regexp_replace(s, r"^((private|protected|noncomputable|nonrec)\s+)*(theorem|lemma|def|instance|abbrev)\s+", "")
    return F.regexp_extract(s, r"^([^\s(\[:⦃{]*)", 1)


def excerpt(text: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column, most: int = 400) -> Column:
    """Text from (line, column) to (line, column), lines from 1 and columns from 0, blanks collapsed, cut with an ellipsis."""
    lines = F.slice(F.split(text, "\n", -1), start_line, end_line - start_line + 1)
    n = F.size(lines)
    cut = F.transform(lines, lambda x, i: F.substring(x, F.when(i == 0, start_col + 1).otherwise(1), F.when(i == n - 1, end_col - F.when(i == 0, start_col).otherwise(0)).otherwise(F.length(x))))
    flat = collapse(F.array_join(cut, " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def quality_flags(statement: Column, proof: Column, confidences: Column) -> Column:
    return F.struct((F.coalesce(statement, F.lit("")) != "").alias("has_statement"), (F.coalesce(proof, F.lit("")) != "").alias("has_proof"), F.forall(confidences, lambda c: c > 0).alias("all_premises_resolved"), F.coalesce(statement, F.lit("")).contains("\\u").alias("unicode_issue"))


def unicode_normalize(text: Column) -> Column:
    """Escapes of four hex digits become their characters."""
    parts = F.split(text, r"(?=\\u[0-9a-fA-F]{4})", -1)
    one = lambda p: F.when(p.rlike(r"^\\u[0-9a-fA-F]{4}"), F.concat(F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"), F.substr(p, F.lit(7)))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def clipped(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)
