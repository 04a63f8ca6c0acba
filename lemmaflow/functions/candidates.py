"""Names in tactic blocks that may be lemmas: candidates, their classes and their likely full names. All built in; none is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

#: Words that are never candidates.
STOP_WORDS = [
    "*", "?", "??", "False", "True", "_", "aesop", "apply", "assumption", "by", "constructor", "exact", "exists", "forall", "from", "fun", "have", "in", "intro", "intros", "let", "match", "refine",
    "rintro", "rw", "show", "simp", "simp?", "simp_all", "with",
]
#: Words after which a candidate may stand, and those after which any name is classed.
CANDIDATE_HEADS = ["apply", "exact", "have", "refine", "rw", "simp", "suffices"]
NAME_HEADS = ["apply", "cases", "exact", "have", "induction", "obtain", "rcases", "refine", "rw", "simp", "simp_rw", "simpa", "suffices", "use"]

#: Tactics, modifiers and marks.
KEYWORDS = [
    "*", "?", "??", "And", "False", "Iff", "Not", "Or", "True", "_", "_root_", "abel", "absurd", "ac_rfl", "admit", "aesop", "aesop?", "aesop_cat", "all_goals", "any_goals", "apply", "apply'",
    "apply?", "apply_fun", "assumption", "at", "beta_reduce", "borelize", "bound_tac", "by", "by_cases", "by_contra", "calc", "cases", "change", "choose", "classical", "clean", "clear",
    "clear_value", "congr", "constructor", "continuity", "contradiction", "contrapose", "conv", "conv_lhs", "conv_rhs", "convert", "convert_to", "data_refl", "dec_trivial", "decide", "decide?",
    "decreasing_by", "delta", "do", "done", "dsimp", "else", "era", "erw", "eta_reduce", "exact", "exact'", "exact?", "exactI", "exfalso", "exists", "existsi", "ext", "fail", "fail_if_success",
    "field_simp", "filter_upwards", "fin_cases", "first", "focus", "forall", "from", "fun", "fun_prop", "gcongr", "generalize", "generalizing", "group", "guard_expr", "guard_hyp", "guard_target",
    "have", "haveI", "if", "in", "induction", "infer_instance", "inferInstance", "inhabit", "injection", "interval_cases", "intro", "intros", "iterate", "left", "let", "letI", "lift", "linarith",
    "linear_combination", "match", "measurability", "mfld_simps", "mod_cast", "module", "mono", "motive", "native_decide", "nlinarith", "nontriviality", "norm_cast", "norm_cast_assert", "norm_num",
    "norm_num_ext", "norm_swap", "nth_rw", "obtain", "omega", "on_goal", "only", "pick_goal", "polyrith", "positivity", "push_cast", "push_neg", "rcases", "reassoc", "reduce", "refine", "refine'",
    "refl", "rel_simp", "rename", "rename_i", "repeat", "replace", "return", "revert", "rfl", "rfl?", "right", "ring", "ring_nf", "rintro", "rotate", "rw", "rw'", "rwa", "set", "show", "simp",
    "simp'", "simp?", "simp_all", "simp_intro", "simp_nf", "simp_rw", "simpa", "skip", "slice_lhs", "slice_rhs", "sorry", "specialize", "split", "split_ifs", "stop", "subsingleton", "subst",
    "subst_vars", "success_if_fail", "suffices", "swap", "swap_var", "symm", "tauto", "termination_by", "tfae_finish", "tfae_have", "then", "tidy", "trace", "trans", "trivial", "try", "unfold", "use",
    "using", "where", "whnf", "with", "work_on_goal", "zeta_reduce",
]
#: Projections and constructors, which count as keywords.
PROJECTIONS = ["assoc", "comm", "eq", "fst", "ge", "gt", "inl", "inr", "le", "lt", "mk", "mp", "mpr", "ne", "refl", "snd", "symm", "trans", "val"]
CONSTRUCTORS = [
    "And.intro", "And.left", "And.right", "Bool.false", "Bool.true", "Eq.refl", "Except.error", "Except.ok", "List.cons", "List.nil", "Nat.succ", "Nat.zero", "Option.none", "Option.some", "Or.inl",
    "Or.inr", "PUnit.unit", "Prod.fst", "Prod.mk", "Prod.snd", "Sum.inl", "Sum.inr", "True.intro", "Unit.unit",
]
#: Namespaces.
NAMESPACES = [
    "AddMonoidHom", "AlgHom", "Algebra", "Array", "Category", "Complex", "DFinsupp", "ENNReal", "EReal", "Field", "Filter", "Finset", "Finsupp", "Function", "Functor", "Group", "Ideal", "Int",
    "LinearMap", "List", "Matrix", "Measure", "Metric", "Module", "Monad", "MonoidHom", "Multiset", "MvPolynomial", "NNReal", "Nat", "Norm", "Option", "Pi", "Polynomial", "PowerSeries", "Prod",
    "Quotient", "Rat", "Real", "Ring", "RingHom", "Set", "Sigma", "Subalgebra", "Subgroup", "Submodule", "Submonoid", "Subring", "Subtype", "Sum", "Topology", "Vector", "WithBot", "WithTop", "WithZero",
]
#: Type classes and types.
TYPE_CLASSES = [
    "AddGroup", "AddMonoid", "Algebra", "Array", "Bijective", "BorelSpace", "CommGroup", "CommRing", "Complex", "Continuous", "Countable", "Decidable", "DecidableEq", "Field", "Finite", "Finset",
    "Fintype", "Group", "Infinite", "Injective", "Int", "Integrable", "Lattice", "LinearOrder", "List", "MapsTo", "Matrix", "Measurable", "MeasurableSpace", "MeasureSpace", "MetricSpace", "Module",
    "Monoid", "Nat", "Nonempty", "NormedRing", "NormedSpace", "Option", "OrderedRing", "OrderedSemiring", "PartialOrder", "Polynomial", "Preorder", "Prop", "Real", "Ring", "Semiring", "Set", "Sort",
    "StronglyMeasurable", "Subsingleton", "Surjective", "TopologicalSpace", "Type", "Uncountable", "Unique", "Vector",
]
#: First parts of a name that mean a local term, and last parts that mean a use of a lemma.
LOCAL_FIRST = ["assoc", "comm", "fst", "inl", "inr", "refl", "snd", "symm", "this", "trans"]
LEMMA_LAST = ["1", "2", "left", "mp", "mpr", "refl", "right", "symm", "trans"]
#: Ends of names of hypotheses that start with h.
HYPOTHESIS_ENDS = [
    "add", "assoc", "bot", "comm", "cover", "div", "eq", "frac", "le", "lt", "mem", "mul", "ne", "neg", "nonneg", "nonzero", "one", "pos", "pow", "rpow", "sub", "sum", "top", "zero",
]
#: First letters of names whose encoding broke.
BROKEN = "âãäåðñòóôõö"

_NAME = r"[A-Za-z_][A-Za-z0-9_'.]*|[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_'.]*"
_DOTTED = r"(?U)\b([A-Za-z_][A-Za-z0-9_']*(?:\.[A-Za-z0-9_']+)+)\b"
_PLAIN = r"(?U)\b([A-Za-z_][A-Za-z0-9_']*)\b"
_HYPOTHESIS = f"^([a-z][0-9]*|h[a-z]+[0-9]*|h[A-Z][a-z]*|h[a-z]?_[a-z_]+|h_[0-9]+|h_[A-Z].*|h.*_({'|'.join(HYPOTHESIS_ENDS)})|H[A-Z]?|this|ih|IH)$"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first_names(parts: Column) -> Column:
    return F.array_remove(F.transform(parts, lambda p: F.regexp_extract(p, _NAME, 0)), "")


def _listed(text: Column) -> Column:
    """The first name of each part of the lists in square brackets."""
    return _first_names(F.flatten(F.transform(_all(text, r"(?s)\[(.*?)\]", 1), lambda x: F.split(x, ","))))


def _after(text: Column, heads: list[str], end: str) -> Column:
    """The name in the word that follows one of ``heads``; ``end`` is cut from the word. A word may be a head itself, hence the look ahead."""
    follow = _all(text, rf"(?U)\b(?:{'|'.join(heads)})\b(?=\s+([^\s({{\[]+))", 1)
    return _first_names(F.transform(follow, lambda x: F.regexp_replace(F.regexp_replace(x, r"[,)\]}]+$", ""), end, "")))


def _named(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: ~x.rlike(r"^[\p{Nd}._']*$"))))


def lemma_candidates(block: Column) -> Column:
    """Sorted names of a tactic block that may be lemmas: in bracket lists, after one of seven words, and dotted ones; no stop words, no numbers. Null: none."""
    s = t.unicode_normalize(F.coalesce(block, F.lit("")))
    found = F.concat(_listed(s), _after(s, CANDIDATE_HEADS, r"\.[0-9]+$"), _all(s, _DOTTED, 1))
    return F.filter(_named(found), lambda x: ~x.isin(STOP_WORDS))


def identifier_category(name: Column) -> Column:
    """The first of nine classes whose rule holds for a name."""
    first, last, dotted = F.substring_index(name, ".", 1), F.substring_index(name, ".", -1), name.contains(".")
    local = first.isin(LOCAL_FIRST) | first.rlike(r"^(?U)\p{L}$") | first.rlike(_HYPOTHESIS)
    lemma = (dotted & name.rlike(r"^\p{Lu}")) | (name.contains("_") & ~name.startswith("_")) | (dotted & last.isin(LEMMA_LAST))
    return (
        F.when(name.rlike(f"^[{BROKEN}]"), "corrupted_unicode").when(name.isin(KEYWORDS + PROJECTIONS + CONSTRUCTORS), "keywords_modifiers").when(name.rlike("^[A-Z]$"), "type_variables")
        .when(name.isin(NAMESPACES), "namespaces").when(dotted & local, "local_var_access").when(name.rlike(_HYPOTHESIS), "local_hypotheses")
        .when(name.isin(TYPE_CLASSES), "type_class_annotations").when(lemma, "global_lemmas").otherwise("other")
    )


def identifiers(block: Column) -> Column:
    """All distinct names of a tactic block, sorted: those of ``lemma_candidates`` (after more words, stop words too) and plain identifiers."""
    s = t.unicode_normalize(F.coalesce(block, F.lit("")))
    return _named(F.concat(_listed(s), _after(s, NAME_HEADS, "$^"), _all(s, _DOTTED, 1), _all(s, _PLAIN, 1)))


def normalize_candidate(token: Column) -> Column:
    """Full names that a token may stand for, in the order in which to try them; a number at its end goes. Local terms give none.

    The first rule that holds gives a namespace that is tried before the token; a token without a rule is tried first, then in the namespace that its form suggests."""
    tok = F.regexp_replace(t.strip(token), r"\.[0-9]+$", "")
    last, low, bare = F.substring_index(tok, ".", -1), F.lower(tok), ~tok.contains(".")
    put = lambda namespace, name=tok: F.array(F.concat(F.lit(f"{namespace}."), name), tok)
    own = F.substr(tok, F.lit(6))
    rules = [
        (tok.endswith(".coe_prop"), F.array().cast("array<string>")),
        (tok == "this.countable_of_injOn", F.array(F.lit("Set.MapsTo.countable_of_injOn"))),
        (tok.startswith("this."), put("Set.MapsTo", own)),
        (tok.endswith(".injOn"), F.array(F.lit("Function.Injective.injOn"), tok)),
        (tok.contains("rootSet"), put("Polynomial", last)),
        (low.contains("aleph0") | (tok.startswith("mk_") & tok.contains("uLift")), put("Cardinal")),
        (bare & tok.contains("MapsTo"), put("Set")),
        (bare & low.contains("rootset"), F.reverse(put("Polynomial"))),
        (bare & (low.contains("aleph") | tok.startswith("mk_")), F.reverse(put("Cardinal"))),
        (bare & tok.rlike(r"^\p{Lu}.+"), F.reverse(put("Set"))),
    ]
    first, *rest = rules
    return reduce(lambda c, r: c.when(*r), rest, F.when(*first)).otherwise(F.array(tok))
