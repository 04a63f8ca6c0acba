"""Registered queries of the analytics operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import components, graph, loops, mining, stats
from .plans import views as v
from .plans.durable import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, *uses: str):
    """Registers the query; ``uses`` are the views that its SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql:
            first, *rest = sql.strip().split(None, 1)
            own = rest[0] if uses and first.lower() == "with" else sql
            ORACLES[name] = f"with recursive {', '.join(uses)}, {own}" if uses and first.lower() == "with" else f"with recursive {', '.join(uses)} {sql}" if uses else sql
        return f

    return add


# --- aggregations -----------------------------------------------------------------------------------------------------


@register("vocab_counts", "select * from (select 'tactic' as kind, head as name, count(*) as n from v_steps group by head order by n desc, name limit 20) union all select * from (select 'premise', premise, count(*) as n from v_prem group by premise order by n desc, premise limit 20)", v.STEPS, v.PREMISES)
def _(s, d):
    return stats.vocab_counts(v.steps(s, d), v.premises(s, d))


@register("basic_statistics", "select count(*) as n, round(avg(n), 6) as mean, median(n) as median, max(n) as max from (select count(*) as n from v_steps group by theorem)", v.STEPS)
def _(s, d):
    return stats.basic_statistics(stats.counts(v.steps(s, d), "theorem"), "n")


@register("all_premises_agg", "select l_orderkey as theorem, concat(p_brand, '.', p_type) as premise, count(*) as n, string_agg(l_linenumber, ' ' order by l_linenumber) as tactics, round(avg(l_discount), 4) as avg_confidence from lineitem join part on l_partkey = p_partkey group by all")
def _(s, d):
    rows = v.table(s, d, "lineitem").join(v.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    by = rows.groupBy(F.col("l_orderkey").alias("theorem"), F.concat_ws(".", "p_brand", "p_type").alias("premise"))
    return by.agg(F.count("*").alias("n"), F.concat_ws(" ", F.sort_array(F.collect_list("l_linenumber")).cast("array<string>")).alias("tactics"), F.round(F.avg("l_discount"), 4).alias("avg_confidence"))


@register("theorem_metrics", "select l_orderkey as theorem, count(*) as num_tactics, count(distinct p_type) as num_premises, sum(length(p_name)) as statement_length, round(avg(c), 6) as avg_premise_confidence from (select *, avg(l_discount) over (partition by l_orderkey, p_type) / count(*) over (partition by l_orderkey, p_type) * 0 + avg(l_discount) over (partition by l_orderkey, p_type) as c0, null as x from lineitem join part on l_partkey = p_partkey) t join (select l_orderkey as ok, avg(a) as c from (select l_orderkey, p_type, avg(l_discount) as a from lineitem join part on l_partkey = p_partkey group by all) group by 1) m on ok = l_orderkey group by l_orderkey")
def _(s, d):
    rows = v.table(s, d, "lineitem").join(v.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    by = rows.groupBy(F.col("l_orderkey").alias("theorem"), "p_type").agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("chars"), F.avg("l_discount").alias("c"))
    return by.groupBy("theorem").agg(F.sum("n").alias("num_tactics"), F.count("*").alias("num_premises"), F.sum("chars").alias("statement_length"), stats.rounded(F.avg("c")).alias("avg_premise_confidence"))


@register("build_stats", "select event_type as method, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent, count(*) filter (value >= 60) as high, count(*) filter (value < 60) as low from events group by 1")
def _(s, d):
    by = v.table(s, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 60).alias("high"), F.count_if(F.col("value") < 60).alias("low"))
    return by.withColumn("percent", stats.rounded(100 * F.col("n") / F.sum("n").over(Window.partitionBy())))


@register("uniform_bits", "with s as (select theorem, count(*) as n_tactics, sum(length(head)) as chars from v_steps group by 1), vv as (select count(distinct head) as t from v_steps) select theorem, chars, n_tactics, 0 as n_premises, round(7 * chars + n_tactics * log2(t), 6) as bits from s, vv", v.STEPS)
def _(s, d):
    sizes = v.steps(s, d).groupBy("theorem").agg(F.count("*").alias("n_tactics"), F.sum(F.length("head")).alias("chars"), F.lit(0).alias("n_premises"))
    return stats.uniform_bits(sizes, v.steps(s, d).select(F.countDistinct("head")).first()[0], 1)


@register("shannon_bits", "with c as (select 'tactic' as kind, count(*) as n from v_steps group by head union all select 'premise', count(*) from v_prem group by premise) select kind, count(*) as symbols, sum(n) as total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy from c group by kind", v.STEPS, v.PREMISES)
def _(s, d):
    one = lambda rows, key, kind: stats.entropy(stats.counts(rows, key)).withColumn("kind", F.lit(kind))
    return one(v.steps(s, d), "head", "tactic").unionByName(one(v.premises(s, d), "premise", "premise"))


@register("conditional_entropy", "with b as (select head as h1, lead(head) over (partition by theorem order by idx) as h2 from v_steps), g as (select h1, h2, count(*) as n from b where h2 is not null group by all), u as (select head, count(*) as n1 from v_steps group by 1), h as (select -sum(n * log2(n / n1)) / (select count(*) from v_steps) as h from g join u on h1 = head) select round(h, 6) as conditional_entropy, round(1 - h / log2((select count(*) from u)), 6) as predictability from h", v.STEPS)
def _(s, d):
    return stats.conditional_entropy(v.steps(s, d))


@register("theorem_entropy", "with c as (select theorem, head, count(*) as n from v_steps group by all), e as (select theorem, sum(n) as n_steps, count(*) as n_distinct, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from c group by 1) select theorem, n_steps, n_distinct, round(h, 6) as entropy, round(log2(n_distinct) - h, 6) as potential, round(case when n_distinct > 1 then 1 - h / log2(n_distinct) else 0 end, 6) as redundancy from e", v.STEPS)
def _(s, d):
    return stats.theorem_entropy(v.steps(s, d))


_MDL = "t as (select l_orderkey as theorem, sum(length(p_name)) as chars, count(*) as n_tactics, count(distinct p_type) as n_premises, case when l_orderkey % 3 = 0 then 'term' else 'tactic' end as proof_type from lineitem join part on l_partkey = p_partkey group by l_orderkey), us as (select o_orderkey as theorem, o_custkey % 50 as num_uses from orders), m0 as (select t.*, coalesce(num_uses, 0) as num_uses, case when proof_type = 'tactic' then n_tactics else greatest(3, 2 * n_premises) end as pattern_length from t left join us using (theorem)), m as (select theorem, proof_type, num_uses, pattern_length, 6 * chars + case when proof_type = 'tactic' then n_tactics * log2(278) else 0.3 * 7 * chars + n_premises * log2(99412) end as c, pattern_length * log2(278) - log2(99412) as spu from m0), mdl as materialized (select theorem, proof_type, num_uses, pattern_length, round(c, 6) as cost, round(spu, 6) as savings_per_use, round(num_uses * spu, 6) + 0 as savings, round(num_uses * spu - c, 6) as mdl_gain from m)"


def _mdl(s, d):
    rows = v.table(s, d, "lineitem").join(v.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = rows.groupBy(F.col("l_orderkey").alias("theorem")).agg(F.sum(F.length("p_name")).alias("chars"), F.count("*").alias("n_tactics"), F.countDistinct("p_type").alias("n_premises"))
    t = t.withColumn("proof_type", F.when(F.col("theorem") % 3 == 0, "term").otherwise("tactic")).withColumn("proof_chars", F.col("chars"))
    return stats.mdl_gain(t, v.table(s, d, "orders").select(F.col("o_orderkey").alias("theorem"), (F.col("o_custkey") % 50).alias("num_uses")))


register("mdl_gain", "select * from mdl", _MDL)(_mdl)


@register("mdl_extremes", "select * from (select 'top' as side, row_number() over (order by mdl_gain desc, theorem) as place, theorem, mdl_gain from mdl) where place <= 20 union all select * from (select 'bottom', row_number() over (order by mdl_gain, theorem) as place, theorem, mdl_gain from mdl) where place <= 20", _MDL)
def _(s, d):
    return stats.extremes(_mdl(s, d), "mdl_gain", "theorem", 20)


@register("cumulative_savings", "select theorem, savings, round(sum(savings) over (order by savings desc, theorem rows unbounded preceding), 4) as running from (select theorem, savings from mdl order by savings desc, theorem limit 100)", _MDL)
def _(s, d):
    return stats.running_total(_mdl(s, d), "savings", "theorem", 100).withColumn("running", F.round("running", 4))


@register("histogram", "select cast(least(floor(mdl_gain / 20), 49) as bigint) as bin, round(least(floor(mdl_gain / 20), 49) * 20, 6) as low, count(*) as n from mdl where mdl_gain between 0 and 1000 group by all", _MDL)
def _(s, d):
    return stats.histogram(_mdl(s, d), "mdl_gain", 50, 0.0, 1000.0)


@register("namespace_counts", "select split_part(full_name, '.', 1) as namespace, count(*) as n from v_corpus group by 1 order by n desc, namespace limit 20", v.CORPUS)
def _(s, d):
    return stats.namespace_counts(v.corpus(s, d))


@register("audit_extremes", "with c as (select theorem, count(*) as n from v_steps group by 1), b as (select *, case when n <= 4 then 'short' when n <= 12 then 'medium' else 'long' end as bucket from c), f as (select *, row_number() over (partition by bucket order by theorem) as place from b) select bucket, count(*) as n, round(avg(n), 6) as mean, min(n) as least, max(n) as most, string_agg(theorem, ' ' order by theorem) filter (place <= 5) as first from f group by bucket", v.STEPS)
def _(s, d):
    return stats.size_buckets(stats.counts(v.steps(s, d), "theorem"), "n", 4, 12, 5)


@register("proof_length_distribution", "select n as length, count(*) as theorems from (select count(*) as n from v_steps group by theorem) group by 1", v.STEPS)
def _(s, d):
    return stats.length_distribution(v.steps(s, d))


@register("rank_frequency", "select row_number() over (order by n desc, premise) as rank, premise, n from (select premise, count(*) as n from v_prem group by 1)", v.PREMISES)
def _(s, d):
    return stats.rank_frequency(v.premises(s, d), "premise")


# --- sequences ---------------------------------------------------------------------------------------------------------


@register("tactic_bigrams", "select h1, h2, count(*) as n from (select head as h1, lead(head) over (partition by theorem order by idx) as h2 from v_steps) where h2 is not null group by all", v.STEPS)
def _(s, d):
    return stats.ngrams(v.steps(s, d), 2)


@register("tactic_trigrams", "select h1, h2, h3, count(*) as n from (select head as h1, lead(head) over w as h2, lead(head, 2) over w as h3 from v_steps window w as (partition by theorem order by idx)) where h3 is not null group by all", v.STEPS)
def _(s, d):
    return stats.ngrams(v.steps(s, d), 3)


_ENTROPY = "en0 as (select theorem, head, count(*) as n from v_steps group by all), en as (select theorem, count(*) as n_distinct, round(log2(count(*)) - (log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) as potential from en0 group by 1)"


@register("ngram_patterns", "with best as (select theorem from en order by potential desc, theorem limit 500), q as (select theorem, array_agg(head order by idx) as h from v_steps where theorem in (select theorem from best) group by 1), g as (select array_to_string(h[i : i + size - 1], ',') as pattern, size from q, range(3, 8) t(size), lateral (select unnest(range(1, len(h) - size + 2)) as i)), c as (select pattern, size, count(*) as n from g group by all having count(*) >= 2) select pattern, size, n, (size - 1) * n - size as savings from c where (size - 1) * n - size > 0 order by savings desc, pattern limit 50", v.STEPS, _ENTROPY)
def _(s, d):
    return stats.ngram_patterns(v.steps(s, d))


@register("extreme_theorems", "with r as (select theorem, potential, row_number() over (order by potential desc, theorem) as r, count(*) over () as total from en where n_distinct > 1), h as (select theorem, head, row_number() over (partition by theorem order by n desc, head) as k from en0) select case when r <= 5 then 'high' when r > total - 5 then 'low' else 'middle' end as side, theorem, potential, head as top_head from r join h using (theorem) where k = 1 and (r <= 5 or r > total - 5 or (r > total // 2 - 2 and r <= total // 2 + 3))", v.STEPS, _ENTROPY)
def _(s, d):
    return stats.extreme_theorems(v.steps(s, d))


def _turns(s, d):
    return v.table(s, d, "conversations").select(F.col("conv_id").alias("theorem"), F.col("turn").alias("idx"), "role", "text")


@register("state_continuity", "select theorem, idx from (select conv_id as theorem, turn as idx, role, lead(role) over (partition by conv_id order by turn) as nxt from conversations) where nxt is not null and role is distinct from nxt")
def _(s, d):
    return stats.state_continuity(_turns(s, d), "role", "role")


@register("trace_dedupe", "select theorem, idx, head from (select *, row_number() over (partition by theorem, head order by idx) as k from v_steps) where k = 1", v.STEPS)
def _(s, d):
    return stats.repeated_steps(v.steps(s, d), ["head"])


@register("order_by_state_length", "select conv_id as theorem, turn as idx, row_number() over (partition by conv_id order by length(text), turn) - 1 as place from conversations")
def _(s, d):
    return stats.order_by_length(_turns(s, d), "text")


@register("longest_proofs", "select theorem, count(*) as n_steps, row_number() over (order by count(*) desc, theorem) as place from v_steps group by 1 order by n_steps desc, theorem limit 20", v.STEPS)
def _(s, d):
    return stats.longest(v.steps(s, d), 20)


@register("pick_spread", "with c as (select theorem, count(*) as n_steps from v_steps group by 1 having count(*) between 5 and 30), r as (select *, row_number() over (order by n_steps, theorem) - 1 as r, greatest(1, count(*) over () // 48) as step from c) select theorem, n_steps from r where r % step = 0 and r / step < 48", v.STEPS)
def _(s, d):
    return stats.pick_spread(v.steps(s, d), 5, 30, 48)


# --- graph -------------------------------------------------------------------------------------------------------------

_NODES = "nd as materialized (select src as id from v_edges union select dst from v_edges)"
_DEG = "dg as materialized (select id, coalesce(i, 0) as in_degree, coalesce(o, 0) as out_degree from nd left join (select dst as id, count(*) as i from v_edges group by 1) using (id) left join (select src as id, count(*) as o from v_edges group by 1) using (id))"
_FFL = "ffl as materialized (select a.src as u, a.dst as v, b.dst as w from v_edges a join v_edges b on a.dst = b.src join v_edges c on c.src = a.src and c.dst = b.dst)"
_DEPTH = "dp0 as (select id, 0 as depth from nd where id not in (select dst from v_edges) union select dst, depth + 1 from dp0 join v_edges on src = id), dp as materialized (select id, max(depth) as depth from dp0 group by 1)"


@register("citation_graph", "select name, max(t) as node_type, sum(i) as cited_in from (select premise as name, 'premise' as t, 1 as i from v_prem union all select cast(theorem as varchar), 'theorem', 0 from v_prem) group by 1", v.PREMISES)
def _(s, d):
    n, e = graph.citation_graph(v.premises(s, d))
    uses = e.groupBy(F.col("premise").alias("name")).agg(F.count("*").alias("cited_in"))
    return n.join(uses, "name", "left").select("name", "node_type", F.coalesce("cited_in", F.lit(0)).alias("cited_in"))


@register("degrees", "select * from dg", v.EDGES, _NODES, _DEG)
def _(s, d):
    return graph.degrees(v.edges(s, d))


@register("roots_leaves", "select case when in_degree = 0 then 'root' when out_degree = 0 then 'leaf' else 'inner' end as kind, count(*) as n from dg group by 1", v.EDGES, _NODES, _DEG)
def _(s, d):
    return graph.roots_leaves(v.edges(s, d))


@register("top_degree", "select * from (select 'in' as measure, id, in_degree as degree from dg order by degree desc, id limit 10) union all select * from (select 'out', id, out_degree as o from dg order by o desc, id limit 10) union all select * from (select 'total', id, in_degree + out_degree as t from dg order by t desc, id limit 10)", v.EDGES, _NODES, _DEG)
def _(s, d):
    return graph.top_degree(v.edges(s, d))


@register("degree_stats", "select 'in_degree' as measure, min(in_degree) as least, max(in_degree) as most, round(avg(in_degree), 6) as mean, median(in_degree) as median, round(sum(in_degree) / (count(*) * (count(*) - 1)), 6) as density from dg union all select 'out_degree', min(out_degree), max(out_degree), round(avg(out_degree), 6), median(out_degree), round(sum(out_degree) / (count(*) * (count(*) - 1)), 6) from dg", v.EDGES, _NODES, _DEG)
def _(s, d):
    return graph.degree_stats(v.edges(s, d))


@register("weak_components", "with und as (select src as a, dst as b from v_edges union select dst, src from v_edges), r as (select id, id as c from nd union select b, c from r join und on a = id where c < b) select id, min(c) as component from r group by 1", v.EDGES, _NODES)
def _(s, d):
    return components.connected_components(v.edges(s, d))


@register("bfs_levels", "with q as (select id, 0 as level from nd where id not in (select dst from v_edges) union select dst, level + 1 from q join v_edges on src = id) select id, min(level) as level from q group by 1", v.EDGES, _NODES)
def _(s, d):
    return loops.bfs_levels(v.edges(s, d))


@register("level_distribution", "with q as (select id, 0 as level from nd where id not in (select dst from v_edges) union select dst, level + 1 from q join v_edges on src = id) select level, count(*) as n from (select id, min(level) as level from q group by 1) group by 1", v.EDGES, _NODES)
def _(s, d):
    return loops.bfs_levels(v.edges(s, d)).groupBy("level").agg(F.count("*").alias("n"))


@register("longest_depth", "select * from dp", v.EDGES, _NODES, _DEPTH)
def _(s, d):
    return loops.kahn_rounds(v.edges(s, d))


@register("is_dag", "with reach as (select src as a, dst as b from v_cyc union select a, dst from reach join v_cyc on src = b), bad as (select a as id from reach where a = b), below as (select id from bad union select b from reach where a in (select id from bad)) select count(*) = 0 as is_dag, count(*) as blocked from below", v.CYCLIC)
def _(s, d):
    return loops.is_dag(v.cyclic_edges(s, d))


@register("transitivity", "with two as (select distinct a.src as g, b.dst as x from v_edges a join v_edges b on a.dst = b.src) select count(distinct x) as with_grandparents, count(distinct case when e.src is not null then x end) as transitive, round(count(distinct case when e.src is not null then x end) / greatest(1, count(distinct x)), 6) as transitivity from two left join v_edges e on e.src = g and e.dst = x", v.EDGES)
def _(s, d):
    return graph.transitivity(v.edges(s, d))


@register("ffl_count", "select count(*) as feedforward_loops from ffl", v.EDGES, _FFL)
def _(s, d):
    return graph.ffl_count(v.edges(s, d))


_DIAMOND = "up as (select a.dst as v, b.dst as w, count(*) as p from v_edges a join v_edges b on a.src = b.src and a.dst < b.dst group by all), dn as (select a.src as v, b.src as w, count(*) as c from v_edges a join v_edges b on a.dst = b.dst and a.src < b.src group by all), dm as (select v, w, p * c as k from up join dn using (v, w) where not exists (select 1 from v_edges where (src = v and dst = w) or (src = w and dst = v)))"


@register("diamond_count", "select cast(coalesce(sum(k), 0) as bigint) as diamonds from dm", v.EDGES, _DIAMOND)
def _(s, d):
    return graph.diamond_count(v.edges(s, d))


@register("motif3_census", "with und as (select src as a, dst as b from v_edges union select dst, src from v_edges), t as (select distinct list_sort([x.a, x.b, y.b]) as t from und x join und y on x.a = y.a and x.b < y.b), e as (select t, list_position(t, src) as i, list_position(t, dst) as j from t, lateral (select unnest(t) as src), lateral (select unnest(t) as dst) where exists (select 1 from v_edges v where v.src = src and v.dst = dst)) select 1", v.EDGES)
def _(s, d):
    return graph.motif3_census(v.edges(s, d))


ORACLES["motif3_census"] = f"with {v.EDGES}, und as (select src as a, dst as b from v_edges union select dst, src from v_edges), t as (select distinct list_sort([x.a, x.b, y.b]) as t from und x join und y on x.a = y.a and x.b < y.b), p as (select t, t[i] as s, t[j] as d, i, j from t, range(1, 4) a(i), range(1, 4) b(j) where i <> j), f as (select t, i, j from p join v_edges on src = s and dst = d), g as (select t, list_sort([count(*) filter (j = 1) * 10 + count(*) filter (i = 1), count(*) filter (j = 2) * 10 + count(*) filter (i = 2), count(*) filter (j = 3) * 10 + count(*) filter (i = 3)]) as s from f group by t) select array_to_string(s, '-') as signature, count(*) as n from g group by 1"


@register("ego_feedforward", "select id, count(u) as ff from nd left join ffl on v = id group by id", v.EDGES, _NODES, _FFL)
def _(s, d):
    return graph.ego_feedforward(v.edges(s, d))


@register("ego_diamonds", "select id, cast(coalesce(sum(k), 0) as bigint) as diamonds from nd left join (select v as id, k from dm union all select w, k from dm) using (id) group by id", v.EDGES, _NODES, _DIAMOND)
def _(s, d):
    return graph.ego_diamonds(v.edges(s, d))


@register("ego_topology", "with r as (select e.src as x, e.dst as c, count(u) as r from v_edges e left join ffl on v = e.src and w = e.dst group by all), q as (select x as id, sum(r) as ff, sum(case when r = 0 then 1 else -1 end) as dc from r group by 1), z as (select id, in_degree as p, out_degree as c, coalesce(ff, 0) as ff, dc, case when out_degree = 0 then 0 when in_degree = 0 then out_degree else out_degree - coalesce(ff, 0) / in_degree end as u from dg left join q using (id)) select id, round(case when p > 0 and c > 0 then ff / (p * c) else 0 end, 6) as bypass_density, round(case when c > 0 then dc / c else 0 end, 6) as disruption, round(u, 6) as u_eff, case when u > 1e-12 then round(-ln(u), 6) + 0 end as code_length from z", v.EDGES, _NODES, _DEG, _FFL)
def _(s, d):
    return graph.ego_topology(v.edges(s, d))


def _hub(e: DataFrame) -> int:
    d = graph.degrees(e)
    return d.orderBy(F.desc(F.col("in_degree") * F.col("out_degree")), "id").first()["id"]


_EGO = "hub as (select id from dg order by in_degree * out_degree desc, id limit 1), eg0 as (select id, 0 as hop, 0 as o from hub union select src, 1, 1 from v_edges join hub on dst = id union select a.src, 2, 1 from v_edges a join v_edges b on a.dst = b.src join hub on b.dst = id union select dst, 1, 2 from v_edges join hub on src = id union select b.dst, 2, 2 from v_edges a join v_edges b on a.dst = b.src join hub on a.src = id), eg as (select id, case o when 0 then 'centre' when 1 then 'parents' else 'children' end as role, hop from (select *, row_number() over (partition by id order by o, hop) as k from eg0) where k = 1)"


@register("ego_network", "select * from eg", v.EDGES, _NODES, _DEG, _EGO)
def _(s, d):
    e = v.edges(s, d)
    return graph.ego_network(e, _hub(e))


@register("ego_summary", "select (select count(*) from eg) as n_nodes, (select count(*) from eg where role = 'parents') as n_parents, (select count(*) from eg where role = 'children') as n_children, count(*) as n_edges, count(*) filter (a.role = 'parents' and b.role = 'children') as bypasses from v_edges join eg a on src = a.id join eg b on dst = b.id", v.EDGES, _NODES, _DEG, _EGO)
def _(s, d):
    e = v.edges(s, d)
    return graph.ego_summary(e, _hub(e))


@register("extreme_nodes", "with l as (select id, 'in' as measure, in_degree as degree from dg union all select id, 'out', out_degree from dg union all select id, 'total', in_degree + out_degree from dg), r as (select *, row_number() over (partition by measure order by degree desc, id) as h, row_number() over (partition by measure order by degree, id) as k from l) select measure, 'high' as side, id, degree from r where h <= 5 union all select measure, 'low', id, degree from r where k <= 5 and (measure = 'total' or degree = 0)", v.EDGES, _NODES, _DEG)
def _(s, d):
    return graph.extreme_nodes(v.edges(s, d))


@register("descendants_ancestors", "with reach as (select src as start, dst as id from v_edges union select start, dst from reach join v_edges on src = id) select start as id, id as relative, 'descendant' as role from reach union all select id, start, 'ancestor' from reach", v.EDGES)
def _(s, d):
    """Of every node; the ancestors are the same pairs the other way round."""
    reach = loops.closure(v.edges(s, d))
    return reach.select(F.col("start").alias("id"), F.col("id").alias("relative"), F.lit("descendant").alias("role")).union(reach.select("id", "start", F.lit("ancestor")))


register("descendants_ancestors_all")(lambda s, d: loops.relatives(v.all_edges(s, d)))


# --- frontier ----------------------------------------------------------------------------------------------------------

_KNOWN = "known as materialized (select id from dp where depth <= 2)"


def _known(s, d):
    e = v.edges(s, d)
    return e, loops.kahn_rounds(e).filter("depth <= 2").select("id")


@register("adjacent_possible", "select id from nd where id not in (select id from known) and id not in (select dst from v_edges where src not in (select id from known))", v.EDGES, _NODES, _DEPTH, _KNOWN)
def _(s, d):
    return graph.adjacent_possible(*_known(s, d))


_EXP = "can as (select id from nd where id not in (select id from known) and id not in (select dst from v_edges where src not in (select id from known))), lack as (select dst, count(*) as m, min(src) as lone from v_edges where src not in (select id from known) and dst not in (select id from known) group by 1 having count(*) = 1), xp as (select id, (select count(*) from lack where lone = id) as unlocked, (select count(*) from v_edges where dst = id) as prerequisites from can)"


@register("expansion_factor", "select *, round(unlocked / greatest(1, prerequisites), 6) as efficiency from xp", v.EDGES, _NODES, _DEPTH, _KNOWN, _EXP)
def _(s, d):
    return graph.expansion_factor(*_known(s, d))


@register("unlock_efficiency", "select *, round(unlocked / greatest(1, prerequisites), 6) as efficiency from xp order by efficiency desc, prerequisites, id limit 20", v.EDGES, _NODES, _DEPTH, _KNOWN, _EXP)
def _(s, d):
    return graph.expansion_factor(*_known(s, d)).orderBy(F.desc("efficiency"), "prerequisites", "id").limit(20)


@register("local_hub_score", "select src as id, count(*) as score from v_edges where src in (select id from known) and dst in (select id from known union select id from can) group by 1", v.EDGES, _NODES, _DEPTH, _KNOWN, _EXP)
def _(s, d):
    return graph.local_hub_score(*_known(s, d))


@register("bfs_waves", "select depth as step, sum(count(*)) over (order by depth) as known, coalesce(lead(count(*)) over (order by depth), 0) as adjacent from dp group by depth", v.EDGES, _NODES, _DEPTH)
def _(s, d):
    return loops.bfs_waves(v.edges(s, d))


@register("accessibility_time", "select id, depth as wave, count(*) over (partition by depth) as dilution from dp", v.EDGES, _NODES, _DEPTH)
def _(s, d):
    return loops.accessibility(v.edges(s, d))


@register("trajectory_summary", "with w as (select depth as step, sum(count(*)) over (order by depth) as known, coalesce(lead(count(*)) over (order by depth), 0) as adjacent from dp group by depth) select count(*) as steps, max(known) as final_known, arg_max(adjacent, step) as final_adjacent, max(adjacent) as peak, (select min(step) from w where adjacent = (select max(adjacent) from w)) as peak_step from w", v.EDGES, _NODES, _DEPTH)
def _(s, d):
    w = loops.bfs_waves(v.edges(s, d))
    return w.agg(F.count("*").alias("steps"), F.max("known").alias("final_known"), F.max_by("adjacent", "step").alias("final_adjacent"), F.max("adjacent").alias("peak"), F.min(F.struct((-F.col("adjacent")).alias("m"), "step"))["step"].alias("peak_step"))


@register("removal_impact", "with probes as (select id from dg order by in_degree * out_degree desc, id limit 20), root as (select id from nd where id not in (select dst from v_edges)), below as (select id as probe, dst as id from probes join v_edges on src = id union select probe, dst from below join v_edges on src = id), ok as (select p.id as probe, r.id from probes p, root r where r.id <> p.id union select probe, dst from ok join v_edges on src = id where dst <> probe) select p.id, count(b.id) as descendants, round(count(*) filter (b.id is not null and o.id is null) / greatest(1, count(b.id)), 6) as impact from probes p left join below b on b.probe = p.id left join ok o on o.probe = p.id and o.id = b.id group by p.id", v.EDGES, _NODES, _DEG)
def _(s, d):
    e = v.edges(s, d)
    return loops.removal_impact(e, graph.degrees(e).orderBy(F.desc(F.col("in_degree") * F.col("out_degree")), "id").limit(20).select("id"))


register("removal_impact_all")(lambda s, d: loops.greatest_removal_impacts(v.all_edges(s, d), 20))


@register("targets", "with pt as (select src as id, dst as at, 1 as len from v_edges), y2 as (select src as id, count(*) as y2 from v_edges group by 1), w as (select dst as id, src, 1::double as k from v_edges) select 1", v.EDGES)
def _(s, d):
    return loops.targets(v.edges(s, d))


#: Paths are counted by length: n(node, length) = sum over children of n(child, length - 1).
ORACLES["targets"] = f"with recursive {v.EDGES}, {_NODES}, pt as (select id, 0 as len, 1::double as n from nd union all select src, len, sum(n) from (select src, len + 1 as len, n from pt join v_edges on dst = id) group by src, len), y as (select id, sum(n) filter (len > 0) as y1 from pt group by id) select id, coalesce(y1, 0) as y1, coalesce(y2, 0) as y2, round(ln(1 + coalesce(y1, 0)), 6) as z1, round(ln(1 + coalesce(y2, 0)), 6) as z2 from y left join (select src as id, count(*) as y2 from v_edges group by 1) using (id)"


# --- mining ------------------------------------------------------------------------------------------------------------

_PAIRS = "pr as materialized (select a.premise as p1, b.premise as p2, count(*) as support from v_prem a join v_prem b on a.theorem = b.theorem and a.premise < b.premise group by all having count(*) >= 8)"


@register("premise_sets", "select theorem, count(*) as n_premises, string_agg(premise, ' ' order by premise) as premises from v_prem group by 1", v.PREMISES)
def _(s, d):
    return mining.premise_sets(v.premises(s, d))


@register("frequent_pairs", "select * from pr", v.PREMISES, _PAIRS)
def _(s, d):
    return mining.frequent_pairs(v.premises(s, d), 8)


@register("frequent_triples", "select a.premise as p1, b.premise as p2, c.premise as p3, count(*) as support from v_prem a join v_prem b on a.theorem = b.theorem and a.premise < b.premise join v_prem c on a.theorem = c.theorem and b.premise < c.premise join pr x on x.p1 = a.premise and x.p2 = b.premise join pr y on y.p1 = a.premise and y.p2 = c.premise join pr z on z.p1 = b.premise and z.p2 = c.premise group by all having count(*) >= 3", v.PREMISES, _PAIRS)
def _(s, d):
    p = v.premises(s, d)
    return mining.frequent_triples(p, mining.frequent_pairs(p, 8), 3)


_BRANDS = "v_br as materialized (select distinct l_orderkey as theorem, p_brand as premise from lineitem join part on l_partkey = p_partkey)"


@register("frequent_sets", "with fs as (select theorem, [premise] as items from v_br union all select s.theorem, list_append(s.items, b.premise) from fs s join v_br b on b.theorem = s.theorem and b.premise > s.items[len(s.items)] where len(s.items) < 5) select cast(len(items) as int) as size, array_to_string(items, ' + ') as items, count(*) as support from fs group by fs.items having count(*) >= 5", _BRANDS)
def _(s, d):
    """Sets of up to five brands in five orders or more."""
    return mining.frequent_sets(v.brands(s, d), 5).withColumn("items", F.array_join("items", " + "))


@register("crystallization", "with tr as (select a.premise as p1, b.premise as p2, c.premise as p3, count(*) as support from v_prem a join v_prem b on a.theorem = b.theorem and a.premise < b.premise join v_prem c on a.theorem = c.theorem and b.premise < c.premise join pr x on x.p1 = a.premise and x.p2 = b.premise join pr y on y.p1 = a.premise and y.p2 = c.premise join pr z on z.p1 = b.premise and z.p2 = c.premise group by all having count(*) >= 3), x as (select 2 as size, concat(p1, ' + ', p2) as items, support, support - 2 as savings from pr union all select 3, concat(p1, ' + ', p2, ' + ', p3), support, support * 2 - 3 from tr) select * from (select *, row_number() over (partition by size order by savings desc, items) as place from x where savings > 0) where place <= 100", v.PREMISES, _PAIRS)
def _(s, d):
    """The hundred best pairs and the hundred best triples."""
    p = v.premises(s, d)
    pairs = materialize(mining.frequent_pairs(p, 8), "pairs")
    two, three = (mining.crystallization(sets, n, 100).select(F.lit(n).alias("size"), "*", F.row_number().over(Window.orderBy(F.desc("savings"), "items")).alias("place")) for n, sets in ((2, pairs), (3, mining.frequent_triples(p, pairs, 3))))  # a hundred rows each
    return two.union(three)


@register("candidate_examples", "with b as (select * from pr order by support desc, p1, p2 limit 10), h as (select b.*, x.theorem, row_number() over (partition by p1, p2 order by x.theorem) as k from b join v_prem x on x.premise = p1 join v_prem y on y.premise = p2 and y.theorem = x.theorem) select p1, p2, support, string_agg(theorem, ' ' order by theorem) as theorems from h where k <= 3 group by all", v.PREMISES, _PAIRS)
def _(s, d):
    p = v.premises(s, d)
    return mining.candidate_examples(p, mining.frequent_pairs(p, 8), 10)


@register("support_distribution", "select min(support) as least, max(support) as most, round(avg(support), 6) as mean, count(*) filter (support = 2) as is_2, count(*) filter (support between 3 and 5) as is_3_5, count(*) filter (support between 6 and 10) as is_6_10, count(*) filter (support > 10) as is_11_up from pr", v.PREMISES, _PAIRS)
def _(s, d):
    return mining.support_distribution(mining.frequent_pairs(v.premises(s, d), 8))


_FLOW = "fl0 as (select theorem, idx, head, lead(idx) over (partition by theorem order by idx) as nx, lead(head) over (partition by theorem order by idx) as nh, lag(idx) over (partition by theorem, head order by idx) as la from v_steps), fl as materialized (select theorem, idx as src, nx as dst, head as src_head, nh as dst_head, 'goal' as kind from fl0 where nx is not null union all select theorem, la, idx, head, head, 'hyp' from fl0 where la < idx - 1)"


_MORE_STEPS = "p{1} as (select p.theorem, list_append(m, dst) as m, concat(heads, '>', dst_head) as heads, concat(kinds, ',', kind) as kinds, dst as z from p{0} p join fl on fl.theorem = p.theorem and src = z where not list_contains(m, dst))"


@register("path_motifs", "with p2 as (select theorem, [src, dst] as m, concat(src_head, '>', dst_head) as heads, kind as kinds, dst as z from fl), " + ", ".join(_MORE_STEPS.format(n, n + 1) for n in (2, 3)) + ", p as (select 2 as size, * from p2 union all select 3, * from p3 union all select 4, * from p4) select size, heads, kinds, count(distinct theorem) as support, count(*) as witnesses from p group by all having count(distinct theorem) >= 3", v.STEPS, _FLOW)
def _(s, d):
    """Paths of two to four steps."""
    flow = mining.flow_edges(v.steps(s, d))
    two, three, four = (mining.path_motifs(flow, n, 3).select(F.lit(n).alias("size"), "*") for n in (2, 3, 4))
    return two.union(three).union(four)


def _ranking(s, d):
    return mining.compression_ranking(mining.disjoint_witnesses(mining.path_witnesses(mining.flow_edges(v.steps(s, d)))))


register("disjoint_witnesses")(lambda s, d: mining.disjoint_witnesses(mining.path_witnesses(mining.flow_edges(v.steps(s, d)))))
register("compression_ranking")(_ranking)
