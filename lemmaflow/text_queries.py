"""Registered queries of the text, name and resolution operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as t
from .operators import resolve
from .plans import views as v
from .queries import register

_IDS = r"regexp_extract_all(tactic, '\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\b', 1)"
_KEYS = "[" + ", ".join(f"'{k}'" for k in t.TACTIC_KEYWORDS) + "]"
_TH = "[" + ", ".join(f"'{k}'" for k in t.TACTIC_OR_HYPOTHESIS) + "]"


@register("tactic_heads", f"select seq, string_split(tactic, ' ')[1] as head_word, case when starts_with(tactic, '·') then 'exact' else {_IDS}[1] end as head_ident, case when starts_with(tactic, '·') then 'bullet' else string_split(tactic, ' ')[1] end as head_bucket, trim(split_part(tactic, '[', 1)) as head_bracket, case when starts_with(tactic, 'simp') then 'simp' when starts_with(tactic, 'rfl') or starts_with(tactic, '·') then 'other' else string_split(tactic, ' ')[1] end as family from v_tac", v.TACTICS)
def _(s, d):
    c = F.col("tactic")
    return v.tactics(s, d).select("seq", t.head_word(c).alias("head_word"), t.head_ident(c).alias("head_ident"), t.head_bucket(c).alias("head_bucket"), t.head_bracket(c).alias("head_bracket"), t.family(c).alias("family"))


@register("bracket_lemmas", r"select seq, array_to_string(list_filter(list_transform(string_split(regexp_extract(tactic, '\[([^\]]+)\]', 1), ','), lambda x: trim(x)), lambda x: x = '*' or regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_''.]*$')), ' ') as lemmas from v_tac", v.TACTICS)
def _(s, d):
    return v.tactics(s, d).select("seq", F.array_join(t.bracket_lemmas(F.col("tactic")), " ").alias("lemmas"))


_SURFACE = f"list_filter({_IDS}, lambda x: not list_contains({_KEYS}, lower(x)) and length(x) > 1 and not regexp_matches(x, '^h[0-9]*$') and x not in ('this', 'ih', 'IH'))"


@register("surface_premises", f"with x as (select seq, {_SURFACE} as a from v_tac), y as (select seq, a, list_filter(a, lambda e, i: list_position(a, e) = i) as d from x) select y.seq, array_to_string(d, ' ') as v2, array_to_string(list_filter({_IDS}, lambda x: not list_contains(string_split('apply at by calc cases congr constructor conv decide do else exact ext from fun have if in induction intro intros let linarith match obtain omega only rcases refine refl return rfl ring rw show simp simp_rw then trivial using where with', ' '), lower(x)) and length(x) > 1), ' ') as v1 from y join v_tac using (seq)", v.TACTICS)
def _(s, d):
    c = F.col("tactic")
    return v.tactics(s, d).select("seq", F.array_join(t.surface_premises(c), " ").alias("v2"), F.array_join(t.surface_premises_first(c), " ").alias("v1"))


@register("identifier_refs", "select x as name, count(*) as n from (select unnest(regexp_extract_all(tactic, '[A-Za-z_][A-Za-z0-9_'']*')) as x from v_tac) where not list_contains(string_split('aesop all_goals apply assumption by calc case cases change choose congr constructor contrapose convert exact ext field_simp first fun guard_hyp guard_target have induction intro intros left let linarith nlinarith norm_num obtain omega positivity rcases refine rename_i repeat revert rfl right ring rintro rw rwa set show simp simpa skip specialize split split_ifs subst suffices symm tidy trivial', ' '), x) group by 1", v.TACTICS)
def _(s, d):
    refs = v.tactics(s, d).select(F.explode(t.identifier_refs(F.col("tactic"))).alias("name"))
    return refs.groupBy("name").agg(F.count("*").alias("n"))


@register("is_tactic_or_hyp", f"select name, list_contains({_TH}, lower(split_part(name, '.', -1))) as drop, count(*) as n from (select unnest({_IDS}) as name from v_tac) group by all", v.TACTICS)
def _(s, d):
    ids = v.tactics(s, d).select(F.explode(F.regexp_extract_all("tactic", F.lit(t.IDENTIFIER), F.lit(1))).alias("name"))
    return ids.groupBy("name").agg(F.count("*").alias("n")).withColumn("drop", t.is_tactic_or_hypothesis(F.col("name")))


@register("state_context", "select seq, concat('x=', p_type, ' y=', p_type) as variables, concat('hk', p_size, '=', p_brand, ' = 1') as hypotheses, concat('Mul ', p_brand) as typeclasses, concat(p_name, ' more') as goal, regexp_extract(p_name, '^([A-Za-z_][A-Za-z0-9_]*)', 1) as goal_type from v_st", v.STATES)
def _(s, d):
    c = v.states(s, d).select("seq", t.state_context(F.col("before")).alias("c"))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return c.select("seq", flat("c.variables").alias("variables"), flat("c.hypotheses").alias("hypotheses"), F.array_join("c.typeclasses", ",").alias("typeclasses"), "c.goal", "c.goal_type")


@register("goal_counts", "select seq, len(before) - len(replace(before, '⊢', '')) as goals_before, len(after) - len(replace(after, '⊢', '')) as goals_after, trim(after) in ('no goals', 'goals accomplished') as is_terminal from v_st", v.STATES)
def _(s, d):
    return v.states(s, d).select("seq", t.goal_counts(F.col("before")).alias("goals_before"), t.goal_counts(F.col("after")).alias("goals_after"), t.is_terminal(F.col("after")).alias("is_terminal"))


@register("goal_diff", "select seq, case when p_size % 5 = 0 then '' else '' end as added, concat('hk', p_size, case when p_size % 5 = 0 then ',x' else '' end) as removed, case when p_size % 5 = 0 then '' else 'x' end as kept, true as target_changed from v_st", v.STATES)
def _(s, d):
    c = v.states(s, d).select("seq", t.goal_diff(F.col("before"), F.col("after")).alias("c"))
    return c.select("seq", *[F.array_join(f"c.{n}", ",").alias(n) for n in ("added", "removed", "kept")], "c.target_changed")


@register("namespaces_from_types", "select seq, array_to_string(list_filter([case when contains(p_type, 'Nat') then 'Nat' end, case when contains(p_type, 'Int') then 'Int' end, case when contains(p_type, 'Set') then 'Set' end], lambda x: x is not null), ',') as namespaces from v_st", v.STATES)
def _(s, d):
    parts = v.table(s, d, "part")
    return parts.select(F.col("p_partkey").alias("seq"), F.array_join(t.namespaces_from_types(F.array("p_type")), ",").alias("namespaces"))


_PATHS = "v_path as (select page_id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '.html', '.lean') as path from pages)"


def _paths(s, d):
    path = F.replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit(".html"), F.lit(".lean"))
    return v.table(s, d, "pages").select("page_id", path.alias("path"))


@register("namespace_from_path", r"select page_id, replace(regexp_replace(path, '\.lean$', ''), '/', '.') as namespace from v_path", _PATHS)
def _(s, d):
    return _paths(s, d).select("page_id", t.namespace_from_path(F.col("path")).alias("namespace"))


@register("open_namespaces", r"with p as (select page_id, string_split(replace(regexp_replace(path, '\.lean$', ''), '/', '.'), '.') as parts from v_path), q as (select page_id, list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '.')) as ps from p) select page_id, array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), ' ') || ' A' || page_id as namespaces from q", _PATHS)
def _(s, d):
    name = F.concat(F.lit("A"), F.col("page_id").cast("string"), F.lit(".lemma"))
    return _paths(s, d).select("page_id", F.array_join(t.open_namespaces(F.col("path"), name), " ").alias("namespaces"))


@register("file_filter", "select page_id, path from v_path where contains(path, 'example.org/en')", _PATHS)
def _(s, d):
    return _paths(s, d).filter(t.file_filter(F.col("path"), "example.org\\en"))


@register("module_label", "select string_split(path, '.')[1] as module, count(*) as n from v_path group by 1", _PATHS)
def _(s, d):
    return _paths(s, d).groupBy(t.module_label(F.lit(None).cast("string"), F.col("path")).alias("module")).agg(F.count("*").alias("n"))


@register("theorem_slug", "select seq, left(regexp_replace(full_name, '[^A-Za-z0-9_.-]+', '_', 'g'), 180) as slug from v_corpus", v.CORPUS)
def _(s, d):
    return v.corpus(s, d).select("seq", t.slug(F.col("full_name")).alias("slug"))


@register("theorem_short_name", f"select seq, {v.SHORT_NAME} as short_name from v_stmt", v.STATEMENTS)
def _(s, d):
    return v.statements(s, d).select("seq", t.short_name(F.col("statement")).alias("short_name"))


@register("strip_comments", r"select doc_id, md5(regexp_replace(regexp_replace(concat('/- head', chr(10), '-/', text, '-- tail'), '(?s)/-.*?-/', '', 'g'), '--[^\n]*', '', 'g')) as code_md5 from documents where text is not null")
def _(s, d):
    docs = v.table(s, d, "documents").filter("text is not null")
    code = F.concat(F.lit("/- head\n-/"), F.col("text"), F.lit("-- tail"))
    return docs.select("doc_id", F.md5(F.encode(t.strip_comments(code), "UTF-8")).alias("code_md5"))


@register("compact_projection", "select doc_id, left(text, 150) as state, left(text, 120) as tactic from documents")
def _(s, d):
    return v.table(s, d, "documents").select("doc_id", t.clipped(F.col("text"), 150).alias("state"), t.clipped(F.col("text"), 120).alias("tactic"))


@register("scan_theorems", "select doc_id, n_chars from documents where text is not null")
def _(s, d):
    """Documents written as JSON lines, with a broken and a blank line, and read by schema."""
    from .plans.durable import new_path
    from .sources.tables import scan_json

    path = new_path(s, "json")
    good = v.table(s, d, "documents").select(F.to_json(F.struct("doc_id", "text", "n_chars")).alias("value"))
    good.union(s.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return scan_json(s, path, "doc_id long, text string, n_chars long").filter("text is not null").select("doc_id", "n_chars")


@register("scan_tactic_theorems", "select theorem, count(*) as n_tactics from v_steps where substr(theorem, 1, 1) <> '1' group by 1", v.STEPS)
def _(s, d):
    from .sources.tables import tactic_theorems

    kind = F.when(F.substring("theorem", 1, 1) == "1", "term").otherwise("tactic")
    records = v.steps(s, d).groupBy("theorem").agg(F.collect_list("head").alias("tactics")).withColumn("proof_type", kind)
    return tactic_theorems(records).select("theorem", F.size("tactics").cast("long").alias("n_tactics"))


@register("corpus_code_index", "select full_name, arg_max(concat(p_type, seq), seq) as code from (select *, p_type from v_corpus join part on p_partkey = seq) group by 1", v.CORPUS)
def _(s, d):
    from .sources.tables import code_index

    rows = v.corpus(s, d).join(v.table(s, d, "part"), F.col("seq") == F.col("p_partkey")).select("full_name", "seq", F.concat("p_type", F.col("seq").cast("string")).alias("code"))
    return code_index(rows)


@register("premise_registry_unique", "select full_name, def_path, seq from (select full_name, p_brand as def_path, seq, row_number() over (partition by full_name, p_brand order by seq) as k from v_corpus join part on p_partkey = seq) where k = 1", v.CORPUS)
def _(s, d):
    from .sources.tables import unique_premises

    rows = v.corpus(s, d).join(v.table(s, d, "part"), F.col("seq") == F.col("p_partkey")).select(F.lit(None).cast("string").alias("fullName"), "full_name", F.col("p_brand").alias("def_path"), "seq")
    return unique_premises(rows, ["fullName", "full_name"])


@register("export_edges", "select theorem, idx, head as premises from v_steps", v.STEPS)
def _(s, d):
    from .sources.tables import theorem_edges

    records = v.steps(s, d).groupBy("theorem").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("head").alias("tactic"), F.array("head").alias("premises")))).alias("tactics"))
    return theorem_edges(records).select("theorem", F.col("idx").cast("long").alias("idx"), F.array_join("premises", ",").alias("premises"))


@register("csv_sink", "select p_partkey as id, round(p_retailprice, 2) as price from part")
def _(s, d):
    from .plans.durable import new_path

    path = new_path(s, "csv")
    v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.round("p_retailprice", 2).alias("price")).write.csv(path, header=True)
    return s.read.schema("id long, price double").csv(path, header=True)


@register("parquet_stage_io", "select * from v_steps", v.STEPS)
def _(s, d):
    from .plans.durable import materialize

    return materialize(v.steps(s, d), "steps")


# --- resolution

#: A reference per part: its last name part, or with its type in front, or its full name; open namespaces brand and brand.type.
_REFS = "v_ref as (select p_partkey as ref_id, case p_size % 4 when 0 then concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')) when 1 then concat('X', p_partkey) else replace(p_name, ' ', '_') end as surface, case when p_size % 7 = 0 then concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')) else 'none' end as hint, case when p_size % 3 = 0 then [p_brand, concat(p_brand, '.', p_type)] else []::varchar[] end as namespaces, case when p_size % 5 = 0 then [p_brand] else []::varchar[] end as types from part), nm as (select full_name, min(seq) as seq from v_corpus group by 1)"


def _refs(s, d):
    p = v.table(s, d, "part")
    name, size = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size")
    full = F.concat_ws(".", "p_brand", "p_type", name)
    none = F.array().cast("array<string>")
    surface = F.when(size % 4 == 0, full).when(size % 4 == 1, F.concat(F.lit("X"), F.col("p_partkey").cast("string"))).otherwise(name)
    return p.select(F.col("p_partkey").alias("ref_id"), surface.alias("surface"), F.when(size % 7 == 0, full).otherwise("none").alias("hint"), F.when(size % 3 == 0, F.array("p_brand", F.concat_ws(".", "p_brand", "p_type"))).otherwise(none).alias("namespaces"), F.when(size % 5 == 0, F.array("p_brand")).otherwise(none).alias("types"))


@register("resolve_premise_v2", "with ns as (select ref_id, surface, unnest(namespaces) as ns, generate_subscripts(namespaces, 1) as place from v_ref), suf as (select ref_id, n.full_name, n.seq, types from v_ref join nm n on split_part(surface, '.', -1) = split_part(n.full_name, '.', -1)), smm as (select ref_id, count(*) as n, arg_min(full_name, seq) as f from suf group by 1), opt as (select ref_id, 1 as rank, 0 as place, seq, full_name, 'annotation' as method, 1.0 as confidence from v_ref join nm on hint = full_name union all select ref_id, 2, 0, seq, full_name, 'exact_match', 1.0 from v_ref join nm on surface = full_name union all select ref_id, 3, place, seq, full_name, 'namespace_match', 0.95 from ns join nm on full_name = concat(ns, '.', surface) union all select ref_id, 4, 0, seq, full_name, concat('type_inference:', types[1]), 0.8 from suf where len(types) > 0 and starts_with(full_name, concat(types[1], '.')) union all select ref_id, 5, 0, 0, f, case when n = 1 then 'unique_suffix' else 'ambiguous' end, case when n = 1 then 0.6 else 0.3 end from smm), best as (select *, row_number() over (partition by ref_id order by rank, place, seq) as k from opt) select r.ref_id, r.surface, coalesce(b.full_name, r.surface) as full_name, coalesce(method, 'not_found') as method, coalesce(confidence, 0.0) as confidence, coalesce(n, 0) as n_candidates from v_ref r left join best b on b.ref_id = r.ref_id and k = 1 left join smm on smm.ref_id = r.ref_id", v.CORPUS, _REFS)
def _(s, d):
    return resolve.resolve(_refs(s, d), v.corpus(s, d))


@register("resolve_premise_v1", "with suf as (select ref_id, n.full_name, n.seq, types from v_ref join nm n on split_part(surface, '.', -1) = split_part(n.full_name, '.', -1)), c as (select ref_id, count(*) as n, arg_min(full_name, seq) as f from suf group by 1), ty as (select ref_id, arg_min(full_name, seq) as f, min(types[1]) as ns from suf where len(types) > 0 and starts_with(full_name, concat(types[1], '.')) group by 1) select r.ref_id, case when r.surface in (select full_name from nm) or c.n is null then r.surface when c.n > 1 and ty.f is not null then ty.f else c.f end as full_name, case when r.surface in (select full_name from nm) then 'exact' when c.n is null then 'not_found' when c.n = 1 then 'unique' when ty.f is not null then concat('type_hint:', ty.ns) else concat('ambiguous:', c.n) end as resolved_by from v_ref r left join c using (ref_id) left join ty using (ref_id)", v.CORPUS, _REFS)
def _(s, d):
    return resolve.resolve_first(_refs(s, d), v.corpus(s, d))


@register("corpus_name_set", "select distinct full_name from v_corpus", v.CORPUS)
def _(s, d):
    return resolve.name_set(v.corpus(s, d))


@register("suffix_index", "select split_part(full_name, '.', -1) as suffix, count(distinct full_name) as n, min(full_name) as first_name from v_corpus group by 1", v.CORPUS)
def _(s, d):
    return resolve.suffix_index(v.corpus(s, d))


@register("k_suffix_index", "select distinct array_to_string(p[len(p) - k + 1 :], '.') as suffix, full_name from (select full_name, string_split(full_name, '.') as p, unnest([2, 3, 4, 5, 6]) as k from v_corpus) where k <= len(p)", v.CORPUS)
def _(s, d):
    return resolve.k_suffix_index(v.corpus(s, d))


_NAMES = "v_nm as (select surface as name, count(*) as n from v_ref group by 1)"


@register("match_in_corpus", "select name, n, case when name in (select full_name from nm) then 'exact' when not contains(name, '.') and name in (select split_part(full_name, '.', -1) from nm) then 'suffix' when exists (select 1 from nm where ends_with(full_name, '.' || name)) then 'qualified_suffix' else 'none' end as kind from v_nm", v.CORPUS, _REFS, _NAMES)
def _(s, d):
    return resolve.match_kinds(_refs(s, d).groupBy(F.col("surface").alias("name")).agg(F.count("*").alias("n")), v.corpus(s, d))


@register("in_vs_out_of_corpus", "with m as (select name in (select full_name from nm) as known, n from v_nm) select known, count(*) as names, sum(n) as occurrences, round(100.0 * sum(n) / sum(sum(n)) over (), 6) as percent from m group by 1", v.CORPUS, _REFS, _NAMES)
def _(s, d):
    return resolve.in_vs_out(_refs(s, d).groupBy(F.col("surface").alias("name")).agg(F.count("*").alias("n")), v.corpus(s, d))


@register("name_contains_probe", "with p(probe) as (values ('STEEL'), ('red'), ('Brand#11')), h as (select probe, full_name, case when full_name = probe then 'exact' when ends_with(full_name, '.' || probe) then 'suffix' else 'contains' end as kind from (select distinct full_name from v_corpus) join p on contains(full_name, probe)), r as (select *, row_number() over (partition by probe, kind order by full_name) as k from h) select probe, kind, full_name from r where k <= 10", v.CORPUS)
def _(s, d):
    return resolve.probe(resolve.name_set(v.corpus(s, d)), ["STEEL", "red", "Brand#11"])


@register("name_contains_all", "with p as (select distinct unnest(string_split(p_name, ' ')) as probe from part union select p_type from part union select concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')) from part union select replace(p_name, ' ', '_') from part), h as (select probe, full_name, case when full_name = probe then 'exact' when ends_with(full_name, '.' || probe) then 'suffix' else 'contains' end as kind from (select distinct full_name from v_corpus) join p on contains(full_name, probe)), r as (select *, row_number() over (partition by probe, kind order by full_name) as k from h where probe <> '') select probe, kind, full_name from r where k <= 10", v.CORPUS)
def _(s, d):
    """Probes are all words, types, last parts and full names of the parts."""
    part, names = v.table(s, d, "part"), resolve.name_set(v.corpus(s, d))
    words = part.select(F.explode(F.split("p_name", " ")).alias("probe")).union(part.select("p_type")).union(names).union(part.select(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return resolve.probe_all(names, words)


@register("defined_locally", "with f as (select full_name as name, arg_min(p_brand, seq) as file from v_corpus join part on p_partkey = seq where p_size < 25 group by 1) select n.name, f.file, f.file is not null as defined_locally from v_nm n left join f using (name)", v.CORPUS, _REFS, _NAMES)
def _(s, d):
    files = v.corpus(s, d).join(v.table(s, d, "part").filter("p_size < 25"), F.col("seq") == F.col("p_partkey")).select(F.col("full_name").alias("name"), F.col("p_brand").alias("file"), "seq")
    return resolve.first_definition(_refs(s, d).select(F.col("surface").alias("name")).distinct(), files)


@register("suffix_theorem_match", "select ref_id, arg_min(full_name, seq) as full_name from v_ref join nm on full_name = surface or ends_with(full_name, '.' || surface) group by 1", v.CORPUS, _REFS)
def _(s, d):
    return resolve.suffix_match(_refs(s, d), v.corpus(s, d))




@register("peel_candidate", "with c as (select distinct case when ref_id % 3 = 0 then surface || '.mp' when ref_id % 3 = 1 then surface || '.foo.bar' else surface end as name from v_ref), p as (select name, string_split(name, '.') as ps from c), x as (select name, ps, i, array_to_string(ps[1:i], '.') as prefix from p, lateral (select unnest(range(1, len(ps) + 1)) as i)), b as (select name, max(i) as i, arg_max(prefix, i) as prefix from x where prefix in (select full_name from nm) group by 1) select p.name, case when i >= len(ps) - 1 then prefix when len(ps) > 1 and ps[len(ps)] in ('mp', 'mpr', 'symm', 'trans') then array_to_string(ps[1 : len(ps) - 1], '.') else coalesce(prefix, p.name) end as peeled from p left join b using (name)", v.CORPUS, _REFS)
def _(s, d):
    r = F.col("ref_id") % 3
    name = F.when(r == 0, F.concat("surface", F.lit(".mp"))).when(r == 1, F.concat("surface", F.lit(".foo.bar"))).otherwise(F.col("surface"))
    return resolve.peel(_refs(s, d).select(name.alias("name")), v.corpus(s, d))


@register("resolve_candidate", "with nf as (select full_name, min(p_brand) as in_file from v_corpus join part on p_partkey = seq group by 1), r as (select v_ref.ref_id, surface as token, p_type as file from v_ref join part on p_partkey = v_ref.ref_id), o as (select ref_id, full_name, file, in_file, 1 as rank, 'full' as kind from r join nf on full_name = token union all select ref_id, full_name, file, in_file, 2, 'suffix' from r join nf on contains(token, '.') and (full_name = token or ends_with(full_name, '.' || token)) union all select ref_id, full_name, file, in_file, 3, 'base' from r join nf on split_part(token, '.', -1) = split_part(full_name, '.', -1)), b as (select *, row_number() over (partition by ref_id order by rank, case when in_file = file then 0 else 1 end, len(full_name) - len(replace(full_name, '.', '')), full_name) as k from o) select ref_id, full_name, kind from b where k = 1", v.CORPUS, _REFS)
def _(s, d):
    parts = v.table(s, d, "part")
    names = v.corpus(s, d).join(parts.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("file")), "seq")
    refs = _refs(s, d).select("ref_id", F.col("surface").alias("token")).join(parts.select(F.col("p_partkey").alias("ref_id"), F.col("p_type").alias("file")), "ref_id")
    return resolve.resolve_candidates(refs, names)
