"""Registered queries of the register, lookup and report operators, and of text functions that had none."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import candidates as c
from .functions import text as t
from .operators import graph, loops, reports, resolve
from .plans import views as v
from .queries import _DEG, _DEPTH, _EGO, _MDL, _NODES, ORACLES, _hub, _mdl, register
from .sources import tables

_NAMES = r"unnest(regexp_extract_all(tactic, '\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\b', 1))"
_CONF = "v_conf as (select theorem, premise as name, case when premise in (select concat(p_brand, '.', p_type) from part where p_size < 25) then 1 else 0 end as confidence from v_prem)"


def _names(s, d, tactics=None):
    return (v.tactics(s, d) if tactics is None else tactics).select(F.col("seq").alias("theorem"), F.explode(F.regexp_extract_all("tactic", F.lit(t.IDENTIFIER), F.lit(1))).alias("name"))


def _confidences(s, d):
    known = v.table(s, d, "part").filter("p_size < 25").select(F.concat_ws(".", "p_brand", "p_type").alias("premise")).distinct().withColumn("known", F.lit(1))
    return v.premises(s, d).join(known, "premise", "left").select("theorem", F.col("premise").alias("name"), F.coalesce("known", F.lit(0)).alias("confidence"))


def _files(s, d):
    rows = v.table(s, d, "lineitem").join(v.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("path")).agg(F.collect_set(F.concat_ws(".", "p_brand", "p_type")).alias("imports"))


_IMPORTS = "v_imp as (select distinct concat('S', l_suppkey) as src, concat(p_brand, '.', p_type) as dst from lineitem join part on l_partkey = p_partkey)"


@register("corpus_flatten", "select p_brand as def_path, concat(p_type, '.', p_partkey) as full_name, p_name as code from part")
def _(s, d):
    own = F.struct(F.concat(F.col("p_type"), F.lit("."), F.col("p_partkey").cast("string")).alias("full_name"), F.col("p_name").alias("code"))
    return tables.corpus_premises(v.table(s, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.collect_list(own).alias("premises")))


@register("export_theorem_registry", "select c_custkey as theorem, c_nationkey as file, count(o_orderkey) as num_tactics, count(o_orderkey) > 0 as has_tactics from customer left join orders on c_custkey = o_custkey group by all")
def _(s, d):
    return reports.theorem_registry(v.table(s, d, "customer").select(F.col("c_custkey").alias("theorem"), F.col("c_nationkey").alias("file")), v.table(s, d, "orders").select(F.col("o_custkey").alias("theorem")))


@register("import_graph", "select src, dst, split_part(dst, '.', 1) as module from v_imp", _IMPORTS)
def _(s, d):
    return reports.import_graph(_files(s, d))


@register("import_graph_export", "select id, sum(o) as n_imports, sum(i) as n_importers from (select src as id, 1 as o, 0 as i from v_imp union all select dst, 0, 1 from v_imp) group by 1", _IMPORTS)
def _(s, d):
    return reports.import_nodes(reports.import_graph(_files(s, d)))


_DROP = "'{}'".format("', '".join(t.TACTIC_OR_HYPOTHESIS))


@register("clean_rewrite", f"select theorem, count(*) filter (not gone) as n_refs, count(distinct name) filter (not gone) as n_names, count(*) filter (gone) as n_dropped from (select theorem, name, lower(split_part(name, '.', -1)) in ({_DROP}) as gone from (select seq as theorem, {_NAMES} as name from v_tac)) group by 1", v.TACTICS)
def _(s, d):
    # Tactics are shuffled before their names are listed: the grouping keeps that partitioning, and no task lists the names of a whole input file.
    return reports.clean_rewrite(_names(s, d, v.tactics(s, d).repartition("seq")))


@register("proof_lookup", "select p_partkey as name, case when p_partkey % 2 = 0 then p_type when p_partkey % 3 > 0 then p_brand end as statement, case when p_partkey % 2 = 0 then p_name end as proof, case when p_partkey % 2 = 0 then 'traced' when p_partkey % 3 > 0 then 'corpus' else 'none' end as source from part")
def _(s, d):
    """Parts as results: even ones are traced, those that three doesn't divide have code."""
    p = v.table(s, d, "part").withColumn("name", F.col("p_partkey"))
    traced = p.filter("name % 2 = 0").select("name", F.col("p_type").alias("statement"), F.col("p_name").alias("proof"))
    return reports.proof_lookup(p.select("name"), traced, p.filter("name % 3 > 0").select("name", F.concat("p_brand", F.lit(" := by where "), "p_name").alias("code")))


@register("nomatch_classes", f"select case when name in ('classical', 'filter_upwards', 'infer_instance', 'mod_cast', 'mono', 'push_cast', 'rwa', 'split_ifs', 'tfae_finish', 'tfae_have') or starts_with(name, 'by_') then 'looks_like_tactic' when regexp_matches(name, '^(h[.]|h_|hf_|hp_|this[.]|this$)') then 'looks_like_local' when regexp_matches(name, '^[A-Z]') and not contains(name, '_') and not contains(name, '.') then 'looks_like_type' when contains(name, '.') then 'qualified_but_wrong_ns' else 'other' end as class, count(*) as n_names, cast(sum(n) as bigint) as n from (select name, count(*) as n from (select {_NAMES} as name from v_tac) group by 1) where name not in (select full_name from v_corpus) group by 1", v.TACTICS, v.CORPUS)
def _(s, d):
    return reports.nomatch_classes(_names(s, d).groupBy("name").agg(F.count("*").alias("n")), v.corpus(s, d))


@register("unresolved_examples", "select name, min(theorem) as theorem from v_conf where confidence = 0 group by 1 order by name limit 10", v.PREMISES, _CONF)
def _(s, d):
    return reports.unresolved_examples(_confidences(s, d))


@register("resolved_share_histogram", "select cast(least(floor(x), 49) as bigint) as bin, count(*) as n from (select theorem, count(*) filter (confidence = 0) * 50 / count(*) as x from v_conf group by 1) group by 1", v.PREMISES, _CONF)
def _(s, d):
    return reports.unresolved_share_histogram(_confidences(s, d))


@register("mdl_baselines", "with md as (select median(pattern_length) as mp, median(cost) as mc from mdl), b as (select mdl.*, mp, mc, coalesce(in_degree, 0) as i, coalesce(out_degree, 0) as o from mdl cross join md left join dg on id = theorem) select theorem, round(-cost, 3) as random, round(greatest((pattern_length - 1) * log2(278) - log2(99412) - cost, -cost), 3) as single_use, round(num_uses * (mp * log2(278) - log2(99412)) - mc, 3) as citation_only, round((i + o) * (pattern_length * log2(278) - log2(99412)) - cost, 3) as perfect from b", v.EDGES, _NODES, _DEG, _MDL)
def _(s, d):
    return reports.mdl_baselines(_mdl(s, d), graph.degrees(v.edges(s, d)).withColumnRenamed("id", "theorem"))


@register("parseability", "with x as (select p_size as theorem, length(before) - length(replace(before, '⊢', '')) as b, length(a) - length(replace(a, '⊢', '')) as k, a from (select p_size, before, case when p_size % 5 = 0 then 'no goals' else concat('x z : ', p_type, chr(10), '⊢ ', p_name, chr(10), chr(10), 'case b', chr(10), '⊢ q') end as a from v_st)) select theorem, count(*) as num_tactics, count(*) filter (b > 0) as parseable_before, count(*) filter (a = 'no goals' or k > 0) as parseable_after, count(*) filter (greatest(b, k) > 1) as multi_goal_steps from x group by 1", v.STATES)
def _(s, d):
    sizes = v.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("theorem"))
    return reports.parseability(v.states(s, d).join(sizes, "seq"))


@register("goal_blocks", "select seq, 0 as place, null as case_label, 3 as n_hypotheses, concat(p_name, ' more') as target from v_st", v.STATES)
def _(s, d):
    got = v.states(s, d).select("seq", F.posexplode(reports.goal_blocks(F.col("before"))).alias("place", "g"))
    return got.select("seq", "place", "g.case_label", F.size("g.hypotheses").alias("n_hypotheses"), "g.target")


@register("goal_signature", r"select seq, trim(regexp_replace(before, '\s+', ' ', 'g')) as signature from v_st", v.STATES)
def _(s, d):
    return v.states(s, d).select("seq", t.goal_signature(F.col("before")).alias("signature"))


@register("unicode_normalize", r"select p_partkey as seq, concat(p_name, ' ∀ ', p_type, ' \u00g0') as text from part")
def _(s, d):
    return v.table(s, d, "part").select(F.col("p_partkey").alias("seq"), t.unicode_normalize(F.concat("p_name", F.lit(r" ∀ "), "p_type", F.lit(r" \u00g0"))).alias("text"))


@register("excerpt_by_span", r"with l as (select p_partkey as seq, string_split(concat(p_name, '  of ', chr(10), p_type, chr(10), p_brand), chr(10)) as ls from part) select seq, trim(regexp_replace(concat(substr(ls[1], 3), ' ', substr(ls[2], 1, 5)), '\s+', ' ', 'g')) as excerpt from l")
def _(s, d):
    text = F.concat("p_name", F.lit("  of \n"), "p_type", F.lit("\n"), "p_brand")
    return v.table(s, d, "part").select(F.col("p_partkey").alias("seq"), t.excerpt(text, F.lit(1), F.lit(2), F.lit(2), F.lit(5)).alias("excerpt"))


@register("quality_flags", "select o_orderkey as theorem, o_orderpriority <> '' as has_statement, o_orderstatus <> '' as has_proof, c.ok as all_premises_resolved, contains(o_orderpriority, '\\u') as unicode_issue from orders join (select theorem, min(confidence) = 1 as ok from v_conf group by 1) c on theorem = o_orderkey", v.PREMISES, _CONF)
def _(s, d):
    confidences = _confidences(s, d).groupBy("theorem").agg(F.collect_list("confidence").alias("c"))
    rows = v.table(s, d, "orders").join(confidences, F.col("o_orderkey") == F.col("theorem"))
    return rows.select("theorem", t.quality_flags(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("c")).alias("q")).select("theorem", "q.*")


@register("match_rate_sample", f"with sm as materialized (select {v.SHORT_NAME} as name from v_stmt order by md5(concat(seq, '#42')), seq limit 1000), k as materialized (select distinct full_name from v_corpus), j as (select name, name <> '' and exists (select 1 from k where full_name = name or ends_with(full_name, '.' || name)) as hit from sm), f as (select name, count(*) as n from j where not hit group by 1) select case when hit then 'matched' else 'failed' end as measure, null as name, count(*) as n, round(100.0 * count(*) / (select count(*) from j), 4) as percent from j group by hit union all (select 'failed_name', name, n, round(100.0 * n / (select sum(n) from f), 4) from f order by n desc, name limit 10)", v.STATEMENTS, v.CORPUS)
def _(s, d):
    return resolve.match_rate(v.statements(s, d).withColumnRenamed("seq", "id"), v.corpus(s, d))


@register("mismatch_annotated", "select seq, tactic from v_tac where tactic <> replace(tactic, 'rw [', 'rw [<a>')", v.TACTICS)
def _(s, d):
    return v.tactics(s, d).filter(F.col("tactic") != F.replace("tactic", F.lit("rw ["), F.lit("rw [<a>")))


@register("coverage_table", "select o_orderpriority as strategy, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as \"F\", round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as \"O\", round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as \"P\" from orders group by 1")
def _(s, d):
    return reports.coverage_table(v.table(s, d, "orders").withColumnRenamed("o_orderpriority", "strategy"), "strategy", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@register("seen_graph", "select src, dst from v_edges join dp on id = dst where depth < 3", v.EDGES, _NODES, _DEPTH)
def _(s, d):
    return reports.seen_graph(v.edges(s, d), loops.kahn_rounds(v.edges(s, d)), 3)


@register("feat_mixture", "with n as (select dst as id, o_orderpriority as module, count(*) as n from v_edges join orders on o_orderkey = src group by all), p as (select id, n / sum(n) over (partition by id) as p from n) select id, count(*) as n_module, round(abs(sum(-p * ln(p))), 6) as module_entropy from p group by 1", v.EDGES)
def _(s, d):
    """The priority of an order is its module."""
    module = v.table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_orderpriority").alias("module"))
    return reports.mixture(v.edges(s, d).join(module, "src").select(F.col("dst").alias("id"), "module"), "module")


_LIST = r"regexp_extract_all(regexp_extract(x, '\[(.*?)\]', 1), '[^,]+')"
_NAME = r"[A-Za-z_][A-Za-z0-9_''.]*"
_AFTER = "list_transform(regexp_extract_all(x, '\\b{}\\b\\s+([^\\s({{\\[]+)', 1), lambda w: regexp_replace(w, '[,)\\]}}]+$', ''))"


def _found(heads: str, more: str) -> str:
    """SQL for the names of a tactic ``x``: of its list, after the heads, dotted ones and ``more``."""
    after = ", ".join(_AFTER.format(h) for h in heads.split())
    return f"list_concat(list_transform(list_concat({_LIST}, {after}), lambda w: regexp_extract(w, '{_NAME}')), regexp_extract_all(x, '\\b([A-Za-z_][A-Za-z0-9_'']*(?:\\.[A-Za-z0-9_'']+)+)\\b', 1){more})"


_CANDIDATES = "v_cand as (select distinct seq, name from (select seq, unnest(" + _found("apply exact have refine rw simp suffices", "") + ") as name from (select seq, tactic as x from v_tac)) where name not in ('', '_', 'by', 'fun', 'have', 'in', 'let', 'show', 'simp', 'rw', 'exact', 'apply', 'intro', 'refine', 'with', 'from') and not regexp_matches(name, '^[0-9._'']*$'))"


@register("lemma_candidates", "select seq, name from v_cand", v.TACTICS, _CANDIDATES)
def _(s, d):
    return v.tactics(s, d).select("seq", F.explode(c.lemma_candidates(F.col("tactic"))).alias("name"))


@register("normalize_candidate", "select seq, array_to_string(case when seq % 4 = 0 then ['Set.MapsTo.' || p_brand, 'this.' || p_brand] when seq % 4 = 1 then ['Cardinal.mk_uLift_' || p_size, 'mk_uLift_' || p_size] when seq % 4 = 2 then ['Polynomial.rootSet', 'f.rootSet'] else ['Abc' || p_size, 'Set.Abc' || p_size] end, ' ') as names from (select p_partkey as seq, * from part)")
def _(s, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    token = F.when(k == 0, F.concat(F.lit("this."), "p_brand", F.lit(".2"))).when(k == 1, F.concat(F.lit("mk_uLift_"), size)).when(k == 2, "f.rootSet").otherwise(F.concat(F.lit("Abc"), size))
    return v.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.array_join(c.normalize_candidate(token), " ").alias("names"))


def _blocks(s, d):
    """Tactics of the parts whose keys leave the same remainder are the blocks of a proof."""
    return v.tactics(s, d).select((F.col("seq") % 97).alias("proof"), F.col("seq").alias("block"), F.col("tactic").alias("text"))


@register("proof_candidates", "select seq % 97 as proof, seq as block, name as candidate from v_cand", v.TACTICS, _CANDIDATES)
def _(s, d):
    return reports.proof_candidates(_blocks(s, d))


@register("proof_candidates_peeled", "with nm as (select distinct replace(replace(full_name, '#', ''), ' ', '_') as full_name from v_corpus), p as (select seq, name, string_split(name, '.') as ps from v_cand), x as (select seq, name, ps, i, array_to_string(ps[1:i], '.') as prefix from p, lateral (select unnest(range(1, len(ps) + 1)) as i)), b as (select name, max(i) as i, arg_max(prefix, i) as prefix from x where prefix in (select full_name from nm) group by 1) select distinct seq % 97 as proof, seq as block, case when i >= len(ps) - 1 then prefix when len(ps) > 1 and ps[len(ps)] in ('mp', 'mpr', 'symm', 'trans') then array_to_string(ps[1 : len(ps) - 1], '.') else coalesce(prefix, p.name) end as candidate from p left join b using (name)", v.TACTICS, v.CORPUS, _CANDIDATES)
def _(s, d):
    known = v.corpus(s, d).withColumn("full_name", F.replace(F.replace("full_name", F.lit("#"), F.lit("")), F.lit(" "), F.lit("_")))
    return reports.proof_candidates(_blocks(s, d), known)


#: Heads and projections of a second line that cites the part's full name.
_ENDS = [["exact ", "apply ", "refine "], [".symm h", ".mp", " h", ".trans x", ".missing y"]]
_LONGER = v.TACTICS.replace("' using ', p_name)", "' using ', p_name, chr(10), {}[p_partkey % 3 + 1], replace(concat(p_brand, '.', replace(p_type, ' ', '_'), '.', replace(p_name, ' ', '_')), '#', ''), {}[p_size % 5 + 1])".format(*_ENDS))
_DIFF = [ORACLES[n].replace(v.TACTICS, _LONGER) for n in ("proof_candidates", "proof_candidates_peeled")]


@register("v1_v2_candidate_diff", f"with a as (select distinct proof as theorem, candidate as name from ({_DIFF[0]})), b as (select distinct proof as theorem, candidate as name from ({_DIFF[1]})) select theorem, name, 'first' as only_in from (select * from a except select * from b) union all select theorem, name, 'second' from (select * from b except select * from a)")
def _(s, d):
    """Candidates as they stand in the blocks beside those peeled to known names, of tactics with a second line that cites a projection of a name."""
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    last = v.corpus(s, d).join(v.table(s, d, "part"), F.col("seq") == F.col("p_partkey")).select(F.col("seq").alias("block"), F.concat(pick(_ENDS[0], F.col("seq")), F.translate("full_name", " #", "_"), pick(_ENDS[1], F.col("p_size"))).alias("last"))
    blocks = _blocks(s, d).join(last, "block").withColumn("text", F.concat_ws("\n", "text", "last")).drop("last")
    known = v.corpus(s, d).withColumn("full_name", F.translate("full_name", " #", "_"))
    first, second = (reports.proof_candidates(blocks, c).select(F.col("proof").alias("theorem"), F.col("candidate").alias("name")) for c in (None, known))
    return reports.candidate_diff(first, second)


_CLASSES = "v_id as (select distinct seq, name from (select seq, unnest(" + _found("apply cases exact have induction obtain rcases refine rw simp simp_rw simpa suffices use", ", regexp_extract_all(x, '\\b([A-Za-z_][A-Za-z0-9_'']*)\\b', 1)") + ") as name from (select seq, tactic as x from v_tac)) where not regexp_matches(name, '^[0-9._'']*$'))"
_CLASS = "case when name in ('{}') then 'keywords_modifiers' when regexp_matches(name, '^[A-Z]$') then 'type_variables' when name in ('{}') then 'namespaces' when contains(name, '.') and (split_part(name, '.', 1) in ('assoc', 'comm', 'fst', 'inl', 'inr', 'refl', 'snd', 'symm', 'this', 'trans') or regexp_matches(split_part(name, '.', 1), '^([A-Za-z]|[a-z][0-9]+|h[a-z]+[0-9]*)$')) then 'local_var_access' when regexp_matches(name, '^([a-z][0-9]*|h[a-z]+[0-9]*|h[A-Z][a-z]*)$') or name = 'this' then 'local_hypotheses' when name in ('{}') then 'type_class_annotations' when (contains(name, '.') and regexp_matches(name, '^[A-Z]')) or (contains(name, '_') and name[1] <> '_') then 'global_lemmas' else 'other' end".format("', '".join(x.replace("'", "''") for x in c.KEYWORDS + c.PROJECTIONS + c.CONSTRUCTORS), "', '".join(c.NAMESPACES), "', '".join(c.TYPE_CLASSES))


@register("identifier_categories", f"select {_CLASS} as category, name, count(*) as n from v_id group by all", v.TACTICS, _CLASSES)
def _(s, d):
    names = v.tactics(s, d).select(F.explode(c.identifiers(F.col("tactic"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.select(c.identifier_category(F.col("name")).alias("category"), "name", "n")


@register("block_names", f"with x as (select distinct seq % 97 as proof, trim(tactic) as text, name from v_id join v_tac using (seq)) select proof, text, {_CLASS} as category, string_agg(name, ' ' order by name) as names from x group by all", v.TACTICS, _CLASSES)
def _(s, d):
    return reports.block_names(_blocks(s, d))


@register("annotate_premises", "with x as (select seq, tactic, regexp_extract(tactic, '\\[([^,]*),', 1) as a, regexp_extract(tactic, ' using (.*)$', 1) as b from v_tac) select seq, concat(split_part(tactic, '[', 1), '[<a>', a, '</a>, *', split_part(split_part(tactic, ', *', 2), ' using ', 1), ' using <a>', b, '</a>') as annotated, concat(a, '|', b) as names from x", v.TACTICS)
def _(s, d):
    """The name in the list, its last letters (which lie within it, so that they are left out) and the part's name are the spans."""
    a, b = F.regexp_extract("tactic", r"\[([^,]*),", 1), F.regexp_extract("tactic", " using (.*)$", 1)
    at = F.length(F.substring_index("tactic", "[", 1)) + 1
    span = lambda start, stop, name: F.struct(start.alias("start"), stop.alias("stop"), name.alias("full_name"))
    spans = F.array(span(F.length("tactic") - F.length(b), F.length("tactic"), b), span(at + 2, at + F.length(a), F.lit("within")), span(at, at + F.length(a), a))
    tactics = v.tactics(s, d)
    return reports.annotate_premises(tactics, tactics.select("seq", F.explode(spans).alias("x")).select("seq", "x.*")).withColumn("names", F.array_join("names", "|"))


@register("validation_alignment", "select p_size as theorem, count(*) as num_tactics, 1 as node_alignment_rate, round(avg(case when p_size % 5 > 0 or p_partkey % 2 = 0 then 1 else 0 end), 6) as edge_alignment_rate from part group by 1")
def _(s, d):
    """Parts of one size are the steps of a theorem; even ones are terminal."""
    sizes = v.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("theorem"))
    return reports.validation_alignment(v.states(s, d).join(sizes, "seq").withColumn("is_terminal", F.col("seq") % 2 == 0))


@register("ego_proof_report", "select id as name, case when id % 2 = 0 then 'traced' when id % 3 > 0 then 'corpus' else 'none' end as source, concat('## ', id, chr(10), chr(10), case when id % 2 = 0 then concat('**Statement:** `', o_orderpriority, '`', chr(10), chr(10), '```lean', chr(10), o_orderstatus, chr(10), '```') when id % 3 > 0 then concat('```lean', chr(10), o_orderpriority, chr(10), '```') else '*Proof not available*' end) as entry from eg join orders on o_orderkey = id", v.EDGES, _NODES, _DEG, _EGO)
def _(s, d):
    """Even orders are traced, those that three doesn't divide have code."""
    o, e = v.table(s, d, "orders").withColumn("name", F.col("o_orderkey")), v.edges(s, d)
    traced = o.filter("name % 2 = 0").select("name", F.col("o_orderpriority").alias("statement"), F.col("o_orderstatus").alias("proof"))
    return reports.ego_proof_report(graph.ego_network(e, _hub(e)).withColumnRenamed("id", "name"), traced, o.filter("name % 3 > 0").select("name", F.col("o_orderpriority").alias("code")))


@register("extreme_ego_extract", "with l as (select id, 'in' as measure, in_degree as degree from dg union all select id, 'out', out_degree from dg union all select id, 'total', in_degree + out_degree from dg), r as (select *, row_number() over (partition by measure order by degree desc, id) as h, row_number() over (partition by measure order by degree, id) as k from l), e as (select measure, 'high' as side, id, degree from r where h <= 5 union all select measure, 'low', id, degree from r where k <= 5 and (measure = 'total' or degree = 0)), b as (select src as id, dst as near from v_edges union select dst, src from v_edges), n as (select id, count(*) as n from b group by 1), f as (select *, row_number() over (partition by id order by measure, side, degree) as k from e), g as (select f.*, n, (1 + n) * case when measure = 'total' then 1.0 when side = 'high' then 1 + degree / (select max(degree) from e x where x.measure = f.measure) else 0.5 end as score from f join n using (id) where k = 1), c as (select *, row_number() over (partition by measure, side order by score desc, id) as p from g), a as (select measure, side, c.id as centre, near as id, row_number() over (partition by c.id order by m.n desc, near) as q from c join b on b.id = c.id join n m on m.id = near where p <= 3) select measure, side, centre, id from a where q < 50 union all select measure, side, id, id from c where p <= 3", v.EDGES, _NODES, _DEG)
def _(s, d):
    e = v.edges(s, d)
    return reports.extreme_egos(e, graph.extreme_nodes(e))
