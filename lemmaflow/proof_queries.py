"""Registered queries of the proof-graph, cycle and sampling operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import cycles, graph, loops, mining, models, object_flow, proof, reports, stats
from .operators.ranking import add_rank
from .plans import views as v
from .plans.durable import materialize
from .queries import _DEG, _DEPTH, _FLOW, _NODES, register

_TRANS = "tr as (select theorem, idx, head as before, lead(head) over (partition by theorem order by idx) as after from v_steps qualify after is not null), sn0 as (select theorem, state, min(pos) as pos, max(o) as o from (select theorem, before as state, 2 * idx as pos, 1 as o from tr union all select theorem, after, 2 * idx + 1, 0 from tr) group by all), sn as (select theorem, state, row_number() over (partition by theorem order by pos) - 1 as node, o from sn0), se as (select tr.theorem, a.node as src, b.node as dst, idx from tr join sn a on a.theorem = tr.theorem and a.state = before join sn b on b.theorem = tr.theorem and b.state = after), fe as materialized (select distinct theorem, src, dst from se where src < dst)"
_LEVELS = "lv0 as (select theorem, src as node, 0 as level from fe union select theorem, dst, 0 from fe union select lv0.theorem, dst, level + 1 from lv0 join fe on fe.theorem = lv0.theorem and src = node), lv as materialized (select theorem, node, max(level) as level from lv0 group by all)"


def _trans(s, d):
    return proof.transitions(v.steps(s, d))


@register("proof_state_dag", "select theorem, state, node, node = 0 as is_initial, o = 0 as is_terminal from sn", v.STEPS, _TRANS)
def _(s, d):
    return proof.state_nodes(_trans(s, d))


@register("proof_tree_build", "select * from se", v.STEPS, _TRANS)
def _(s, d):
    return proof.state_edges(_trans(s, d))


@register("proof_dag_levels", "select * from lv", v.STEPS, _TRANS, _LEVELS)
def _(s, d):
    return proof.levels(proof.forward_edges(_trans(s, d)))


_BREADTH = "rt as (select theorem, min(src) as root from fe where not exists (select 1 from fe f where f.theorem = fe.theorem and f.dst = fe.src) group by 1), bf0 as (select theorem, root as node, 0 as level from rt union select bf0.theorem, dst, level + 1 from bf0 join fe on fe.theorem = bf0.theorem and src = node), bf as materialized (select theorem, node, min(level) as level from bf0 group by all)"


@register("tree_metrics", "with w as (select theorem, level, count(*) as w from bf group by all), m as (select theorem, level, row_number() over (partition by theorem order by level) - 1 as place, count(*) over (partition by theorem) as n from bf), a as (select theorem, max(level) as depth, max(w) as max_width from w group by 1), nd as (select theorem, src as node from fe union select theorem, dst from fe), od as (select nd.theorem, nd.node, count(fe.src) as o from nd left join fe on fe.theorem = nd.theorem and fe.src = nd.node group by all), s as (select theorem, count(*) as n_nodes, round(avg(o), 6) as mean_out, round(count(*) filter (o = 0) / count(*), 6) as leaf_share, round(var_pop(o), 6) as imbalance from od group by 1) select s.theorem, n_nodes, depth, m.level as median_depth, max_width, w.w as width_at_half_depth, mean_out, leaf_share, round((depth + 1) / n_nodes, 6) as spine_score, imbalance from s join a using (theorem) join m on m.theorem = s.theorem and m.place = m.n // 2 join w on w.theorem = s.theorem and w.level = depth // 2", v.STEPS, _TRANS, _BREADTH)
def _(s, d):
    return proof.tree_metrics(proof.forward_edges(_trans(s, d)))


@register("tdg_hyp_flow", "select * from fl", v.STEPS, _FLOW)
def _(s, d):
    return mining.flow_edges(v.steps(s, d))


@register("tdg_summary", "select kind, src_head, dst_head, count(*) as n, count(distinct theorem) as theorems from fl group by all", v.STEPS, _FLOW)
def _(s, d):
    return proof.flow_summary(mining.flow_edges(v.steps(s, d)))


@register("tdg_subgraph_signature", "with q as (select theorem, string_agg(head, ',' order by idx) as signature from v_steps where idx < 6 group by 1) select signature, count(*) as n, min(theorem) as first from q group by 1 having count(*) >= 2", v.STEPS)
def _(s, d):
    return proof.head_signatures(v.steps(s, d))


@register("ranking_compare", "with p as (select concat(src_head, '>', dst_head) as heads, kind as kinds, count(*) as hits, count(distinct theorem) as support from fl group by all) select *, row_number() over (order by hits desc, heads, kinds) as by_hits, row_number() over (order by support desc, heads, kinds) as by_support from p", v.STEPS, _FLOW)
def _(s, d):
    p = mining.path_witnesses(mining.flow_edges(v.steps(s, d))).groupBy("heads", "kinds").agg(F.count("*").alias("hits"), F.countDistinct("theorem").alias("support"))
    for c in ("hits", "support"):
        p = add_rank(p, [F.desc(c), F.col("heads"), F.col("kinds")], f"by_{c}")
    return p


@register("candidate_witness_sample", "with w as (select concat(src_head, '>', dst_head) as heads, kind as kinds, theorem, src as first, dst as last from fl), c as (select heads, kinds, count(*) as n from w group by all order by n desc, heads, kinds limit 10), r as (select w.*, row_number() over (partition by w.heads, w.kinds order by theorem, first, last) as k from w join c on c.heads = w.heads and c.kinds = w.kinds) select heads, kinds, theorem, first, last, k from r where k <= 3", v.STEPS, _FLOW)
def _(s, d):
    w = mining.path_witnesses(mining.flow_edges(v.steps(s, d)))
    best = w.groupBy("heads", "kinds").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "heads", "kinds").limit(10)
    order = Window.partitionBy("heads", "kinds").orderBy("theorem", "first", "last")
    return w.join(F.broadcast(best.drop("n")), ["heads", "kinds"]).withColumn("k", F.row_number().over(order)).filter("k <= 3")  # ten candidates


@register("stratified_sample", "with c as (select theorem, count(*) as n from v_steps group by 1), b as (select *, case when n <= 4 then 0 when n <= 12 then 1 else 2 end as bucket from c), r as (select *, row_number() over (partition by bucket order by md5(theorem || '#7')) as r from b) select bucket, theorem, n from r where r <= case when bucket = 0 then 10 else 20 end", v.STEPS)
def _(s, d):
    return proof.stratified_sample(stats.counts(v.steps(s, d), "theorem"), [4, 12], [10, 20, 20])


@register("reservoir_sample", "select theorem from (select distinct theorem from v_steps) order by md5(theorem || '#20260314') limit 25", v.STEPS)
def _(s, d):
    return v.steps(s, d).select("theorem").distinct().orderBy(F.md5(F.concat("theorem", F.lit("#20260314")))).limit(25)


@register("tactic_blocks", "with l as (select doc_id as proof, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents), r as (select *, length(line) - length(ltrim(line, ' ')) as indent from l where trim(line, ' ') <> ''), m as (select *, case when coalesce(indent > lag(indent) over w or regexp_matches(lag(rtrim(line, ' ')) over w, '(from|:=|=>|do)$'), false) then 0 else 1 end as start from r window w as (partition by proof order by line_no)), b as (select *, sum(start) over (partition by proof order by line_no rows unbounded preceding) as block from m) select proof, block, count(*) as n_lines, md5(string_agg(trim(line, ' '), ' ' order by line_no)) as text_md5 from b group by all")
def _(s, d):
    return proof.tactic_blocks(v.lines(s, d).withColumnRenamed("doc_id", "proof")).select("proof", "block", "n_lines", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


_REACH = "rc as materialized (select src as a, dst as b from v_cyc union select a, dst from rc join v_cyc on src = b)"


@register("scc", "with n as (select src as id from v_cyc union select dst from v_cyc) select id, least(id, coalesce((select min(x.b) from rc x join rc y on y.a = x.b and y.b = x.a where x.a = id), id)) as component from n", v.CYCLIC, _REACH)
def _(s, d):
    return cycles.strong_components(v.cyclic_edges(s, d))


_SCC = "c as (select id, least(id, coalesce((select min(x.b) from rc x join rc y on y.a = x.b and y.b = x.a where x.a = id), id)) as component from (select src as id from v_cyc union select dst from v_cyc))"


@register("feedback_arc_set", "with i as (select src, dst from v_cyc join c a on src = a.id join c b on dst = b.id where a.component = b.component), w as (select id, sum(n) as w from (select src as id, -1 as n from i union all select dst, 1 from i) group by id) select src, dst from i join w a on src = a.id join w b on dst = b.id where a.w > b.w or a.w = b.w and src >= dst", v.CYCLIC, _REACH, _SCC)
def _(s, d):
    return cycles.feedback_arc_set(v.cyclic_edges(s, d))


@register("feedback_vertex_set")
def _(s, d):
    return cycles.feedback_vertex_set(v.cyclic_edges(s, d))


@register("null_model_rewire")
def _(s, d):
    e = v.all_edges(s, d)
    return cycles.null_model(e, loops.kahn_rounds(e).withColumnRenamed("depth", "t"))[0]


@register("motif_zscore")
def _(s, d):
    """z of the number of feed-forward loops against five rewired graphs."""
    e = materialize(v.all_edges(s, d), "edges")
    order = materialize(loops.kahn_rounds(e).withColumnRenamed("depth", "t"), "order")
    null = [graph.ffl_count(cycles.null_model(e, order, seed=seed)[0]) for seed in range(5)]
    union = null[0]
    for n in null[1:]:
        union = union.union(n)
    stat = union.agg(F.avg("feedforward_loops").alias("mean"), F.stddev_pop("feedforward_loops").alias("std"))
    return graph.ffl_count(e).join(stat).select("feedforward_loops", stats.rounded("mean").alias("null_mean"), stats.rounded(F.when(F.col("std") > 0, (F.col("feedforward_loops") - F.col("mean")) / F.col("std")).otherwise(0.0)).alias("z"))  # a row each


@register("out_in_ratio_histogram", "select cast(floor(log10(greatest(out_degree / (in_degree + 1), 0.001)) * 10) as bigint) as bin, count(*) as n from dg group by 1", v.EDGES, _NODES, _DEG)
def _(s, d):
    ratio = F.col("out_degree") / (F.col("in_degree") + 1)
    return graph.degrees(v.edges(s, d)).groupBy(F.floor(F.log10(F.greatest(ratio, F.lit(0.001))) * 10).alias("bin")).agg(F.count("*").alias("n"))


@register("import_closure_order", "select id, row_number() over (order by depth desc, id) as place from dp", v.EDGES, _NODES, _DEPTH)
def _(s, d):
    return add_rank(loops.kahn_rounds(v.edges(s, d)), [F.desc("depth"), F.col("id")], "place").select("id", "place")


@register("navigation_list", "with o as (select id, out_degree, row_number() over (order by (out_degree = 0), id) as place, count(*) over () as total from dg) select id, place, coalesce(lead(id) over (order by place), first_value(id) over (order by place)) as next_id, coalesce(lag(id) over (order by place), last_value(id) over (order by place rows between unbounded preceding and unbounded following)) as prev_id from o", v.EDGES, _NODES, _DEG)
def _(s, d):
    rows = add_rank(graph.degrees(v.edges(s, d)), [(F.col("out_degree") == 0).asc(), F.col("id").asc()], "place").select("id", "place")
    total = rows.count()
    beside = lambda step, name: rows.select(F.col("id").alias(name), ((F.col("place") - 1 + step + total) % max(1, total) + 1).alias("place"))
    return rows.join(beside(-1, "next_id"), "place").join(beside(1, "prev_id"), "place")


@register("topk_retrieval", "with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as id, list_sum([qv[i]::double * embedding[i]::double for i in range(1, len(qv) + 1)]) as score from embeddings, q where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, rank, id, round(score, 5) as score from r where rank <= 10")
def _(s, d):
    e = v.table(s, d, "embeddings")
    return models.top_k_retrieval_blocks(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@register("topk_retrieval_all", "with q as (select vec_id as query_id, embedding as qv from embeddings), s as (select query_id, vec_id as id, list_sum([qv[i]::double * embedding[i]::double for i in range(1, len(qv) + 1)]) as score from embeddings, q where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, rank, id, round(score, 5) as score from r where rank <= 10")
def _(s, d):
    """Every row is a query."""
    e = v.table(s, d, "embeddings")
    return models.top_k_retrieval_blocks(e, e, "vec_id", "embedding", 10)


@register("level_success_rates", "select idx as depth, count(*) as n, round(avg(case when head = 'purchase' then 1 else 0 end) * 100, 6) as success_percent from v_steps group by 1", v.STEPS)
def _(s, d):
    return v.steps(s, d).groupBy(F.col("idx").alias("depth")).agg(F.count("*").alias("n"), stats.rounded(F.avg((F.col("head") == "purchase").cast("int")) * 100).alias("success_percent"))


@register("block_usage", "with b as (select o_orderpriority as block, o_orderkey from orders), x as (select block, premise, count(*) as n, count(distinct theorem) as proofs from v_prem join b on o_orderkey = theorem group by all) select block, premise, n, proofs, round(100.0 * n / sum(n) over (partition by block), 6) as percent from x", v.PREMISES)
def _(s, d):
    # Premises are distinct within a theorem, so with a row for each theorem and block a joined row is a proof, and its orders are a count: no set of proofs is kept.
    b = v.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("block"), F.col("o_orderkey").alias("theorem")).agg(F.count("*").alias("k"))
    x = v.premises(s, d).join(b, "theorem").groupBy("block", "premise").agg(F.sum("k").alias("n"), F.count("*").alias("proofs"))
    return x.withColumn("percent", stats.rounded(100 * F.col("n") / F.sum("n").over(Window.partitionBy("block"))))


@register("category_summary", "with c as (select split_part(premise, '.', 1) as category, premise, count(*) as n from v_prem group by all), r as (select *, row_number() over (partition by category order by n desc, premise) as k from c) select category, count(*) as n_unique, sum(n) as total, string_agg(premise, ' | ' order by k) filter (k <= 3) as top from r group by 1", v.PREMISES)
def _(s, d):
    c = v.premises(s, d).groupBy("premise").agg(F.count("*").alias("n")).withColumn("category", F.substring_index("premise", ".", 1))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "premise")))
    top = F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "premise"))))["premise"], " | ")
    return r.groupBy("category").agg(F.count("*").alias("n_unique"), F.sum("n").alias("total"), top.alias("top"))


@register("unresolved_names", "with k as (select distinct concat(p_brand, '.', p_type) as premise from part where p_size < 25), a as (select p.premise as name, count(*) as n, min(case when k.premise is null then 0.0 else 1.0 end)::double as min_confidence from v_prem p left join k on p.premise = k.premise group by 1) select name, n, min_confidence, round(100.0 * count(*) over () / (select count(*) from a), 6) as percent from a where min_confidence = 0", v.PREMISES)
def _(s, d):
    """percent: unresolved names among all distinct names."""
    known = v.table(s, d, "part").filter("p_size < 25").select(F.concat_ws(".", "p_brand", "p_type").alias("premise")).distinct().withColumn("known", F.lit(1.0))
    refs = v.premises(s, d).join(known, "premise", "left").select(F.col("premise").alias("name"), F.coalesce("known", F.lit(0.0)).alias("confidence"))
    return reports.unresolved_names(refs)


_OBJECTS = "ob as (select *, sum(fresh::int) over (partition by theorem order by idx) as chain, not done and not fresh and p_type <> last_type as made from v_tr), ox as (select *, max(case when made then idx end) over (partition by theorem, chain order by idx rows between unbounded preceding and 1 preceding) as m, first_value(p_type) over (partition by theorem, chain order by idx) as first_type, first_value(idx) over (partition by theorem, chain order by idx) as first_idx from ob), oy as (select ox.*, coalesce(m, (select max(o.idx) from ob o where o.theorem = ox.theorem and o.made and o.idx < ox.first_idx and o.p_type = ox.first_type)) as x from ox)"


@register("tdg_build", "select theorem::varchar as theorem, case when fresh then 'in' else concat('t', last) end as src, concat('t', idx) as dst, 'goal_to_goal' as edge_type, 'goal->goal' as label, 'goal' as object_kind, 0.99 as confidence from oy union all select theorem::varchar, case when x is null then 'in' else concat('t', x) end, concat('t', idx), 'hyp_to_goal', 'x->hyp', 'hypothesis', 0.90 from oy union all select theorem::varchar, 'in', concat('t', idx), 'premise_use', 'premise->arg', 'premise', 0.75 from oy union all select theorem::varchar, concat('t', idx), 'out', 'goal_to_goal', 'proof_complete', 'goal', 0.99 from oy where done", v.TRACES, _OBJECTS)
def _(s, d):
    return object_flow.object_flow(v.traces(s, d)).drop("object_id")


@register("tdg_build_stats", "select theorem::varchar as theorem, count(*) as n_steps, count(*) filter (fresh and not done) as branching_steps, count(*) * 3 as inputs, sum(case when done then 0 when fresh then 3 when p_type = last_type then 1 else 3 end) as outputs, count(*) filter (fresh and last is not null) as resynced from v_tr group by 1", v.TRACES)
def _(s, d):
    return object_flow.object_stats(v.traces(s, d))


@register("tdg_io", "select theorem, idx, case when done then '' else 'x' end as inputs, '' as outputs, p_brand as premise_refs, fresh or done as target_changed from v_tr", v.TRACES)
def _(s, d):
    return object_flow.step_io(v.traces(s, d))
