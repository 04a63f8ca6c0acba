"""Registered queries of the feature, target and model operators."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F

from . import report_queries  # noqa: F401  (feat_mixture is a block of the dataset)
from .operators import features, grid, loops, models, reach
from .operators.graph import reverse
from .plans import views as v
from .plans.durable import materialize
from .queries import _DEG, _DEPTH, _NODES, ORACLES, QUERIES, register

_PAR = "par as materialized (select e.dst as v, a.depth as d, e.src as p, b.depth as dp from v_edges e join dp a on a.id = e.dst join dp b on b.id = e.src)"
_SEEN = "sn as materialized (select v, d, p, dp, (select count(*) from par y where y.p = x.p and y.d < x.d) as out_seen, (select count(*) from par y where y.p = x.p and y.d < x.d and y.d = x.dp + 1) as beta from par x)"
_VIEWS = (v.EDGES, _NODES, _DEPTH, _DEG, _PAR)


def _graph(s, d):
    e = materialize(v.edges(s, d), "edges")
    return e, materialize(loops.kahn_rounds(e), "depth")


@register("feat_parent_degrees", "select v as id, count(*) as parent_count, sum(out_seen) as parent_outdeg_sum, round(avg(in_degree), 6) as parent_indeg_mean, round(avg(out_seen), 6) as parent_outdeg_mean, round(avg(dp), 6) as parent_depth_mean, round(avg(beta), 6) as parent_beta_mean, max(in_degree) as parent_indeg_max, max(out_seen) as parent_outdeg_max, max(dp) as parent_depth_max, max(beta) as parent_beta_max from sn join dg on dg.id = p group by v", *_VIEWS, _SEEN)
def _(s, d):
    return features.parent_degrees(*_graph(s, d))


@register("feat_survival_rate", "with fc as (select p, min(d) as f from par group by 1), r as (select fr.d, t.depth as t, avg(case when f < fr.d then 1.0 else 0.0 end) as rate from (select distinct depth as d from dp) fr join dp t on t.depth < fr.d left join fc on fc.p = t.id group by all) select v as id, round(avg(rate), 6) as parent_survival_mean from par join r on r.d = par.d and r.t = par.dp group by v", *_VIEWS)
def _(s, d):
    return features.survival_feature(*_graph(s, d))


@register("feat_upstream", "with two as (select distinct a.dst as v, b.src as u from v_edges a join v_edges b on a.src = b.dst), bo as (select dst as v, src as u from v_edges union select v, u from two), n as (select v, count(*) as n from bo group by 1), m as (select x.v, count(*) as m from bo x join v_edges on src = x.u join bo y on y.v = x.v and y.u = dst group by 1) select id, coalesce((select count(*) from two where v = id), 0) as grandparents, coalesce(n, 0) as upstream_nodes, round(case when n > 1 then coalesce(m, 0) / (n * (n - 1)) else 0 end, 6) as upstream_density from nd left join n on n.v = id left join m on m.v = id", *_VIEWS)
def _(s, d):
    return features.upstream(v.edges(s, d))


@register("feat_peek", "with g as (select a.src as id, count(distinct b.dst) as k2 from v_edges a join v_edges b on a.dst = b.src group by 1) select id, out_degree as k1, coalesce(k2, 0) as k2 from dg left join g using (id)", *_VIEWS)
def _(s, d):
    return features.peek(v.edges(s, d))


@register("feat_parentset_rarity", "with ps as (select dp.id, depth, coalesce(string_agg(src, ',' order by src), '') as k from dp left join v_edges on dst = dp.id group by all) select id, (select count(*) from ps y where y.k = x.k and y.depth < x.depth) as rarity from ps x", *_VIEWS)
def _(s, d):
    return features.parentset_rarity(*_graph(s, d))


@register("feat_parentset_similarity", "with sh as (select a.v, b.v as w, count(*) as s from par a join par b on a.p = b.p and b.d < a.d group by all), j as (select v, w, s / (x.in_degree + y.in_degree - s) as j from sh join dg x on x.id = v join dg y on y.id = w), r as (select *, row_number() over (partition by v order by j desc, w) as r from j) select dp.id, coalesce(round(avg(j), 6), 0) as similarity_mean, coalesce(round(max(j), 6), 0) as similarity_max from dp left join r on r.v = dp.id and r <= 25 group by dp.id".replace("r <= 25", "r.r <= 25"), *_VIEWS)
def _(s, d):
    return features.parentset_similarity(*_graph(s, d))


@register("feat_cooccurrence", "with pp as (select x.v, x.d, x.p as a, y.p as b from par x join par y on x.v = y.v and x.p < y.p), c as (select v, (select count(*) from pp o where o.a = i.a and o.b = i.b and o.d < i.d) as c from pp i) select dp.id, coalesce(round(avg(c), 6), 0) as cooccurrence_mean, coalesce(max(c), 0) as cooccurrence_max from dp left join c on c.v = dp.id group by dp.id", *_VIEWS)
def _(s, d):
    return features.cooccurrence(*_graph(s, d))


_TARGETS = "pt as (select id, 0 as len, 1::double as n from nd union all select src, len, sum(n) from (select src, len + 1 as len, n from pt join v_edges on dst = id) group by src, len), tg as materialized (select id, coalesce(y1, 0) as y1, coalesce(y2, 0) as y2, depth from (select id, sum(n) filter (len > 0) as y1 from pt group by id) left join (select src as id, count(*) as y2 from v_edges group by 1) using (id) join dp using (id))"


def _heights(s, d):
    """The graph with the depth and the height of each node."""
    e, depth = _graph(s, d)
    return e, depth, materialize(loops.kahn_rounds(reverse(e)), "height")


def _targets(s, d):
    e, depth, height = _heights(s, d)
    return e, depth, materialize(loops.targets(e, height), "targets")


def _rows(s, d):
    _, depth, t = _targets(s, d)
    return t.join(depth, "id")


@register("target_structure", "select depth, target, count(*) as n, round(avg(case when y = 0 then 1 else 0 end), 6) as zero_share, round(avg(y), 6) as mean, round(quantile_cont(y, 0.5), 6) as median, round(quantile_cont(y, 0.9), 6) as p90, round(quantile_cont(y, 0.99), 6) as p99, max(y) as most from (select depth, 'y1' as target, y1::double as y from tg union all select depth, 'y2', y2::double from tg) group by all", v.EDGES, _NODES, _DEPTH, _TARGETS)
def _(s, d):
    return models.target_structure(_rows(s, d))


@register("y1_by_y2_bucket", "select case when y2 >= 5 then '5+' else cast(y2 as varchar) end as bucket, count(*) as n, round(avg(y1), 6) as mean, round(median(y1), 6) as median from tg group by 1", v.EDGES, _NODES, _DEPTH, _TARGETS)
def _(s, d):
    return models.y1_by_y2_bucket(_rows(s, d))


def _modules(s, d):
    """The priority of an order is its module."""
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("module"))


@register("feature_dataset")
def _(s, d):
    e, depth, height = _heights(s, d)
    return features.dataset(e, depth, materialize(loops.targets(e, height), "targets"), _modules(s, d), height)


#: What may be known of a node at its own depth; children (k1, k2) are not.
_FEATURES = ["depth", "indeg_seen", "parent_count", "parent_outdeg_sum"]
_FEATURES += [f"parent_{n}_{a}" for n in ("indeg", "outdeg", "depth", "beta") for a in ("mean", "max")]
_FEATURES += ["parent_survival_mean", "grandparents", "upstream_nodes", "upstream_density", "rarity", "similarity_mean", "similarity_max", "cooccurrence_mean", "cooccurrence_max"]
_FEATURES += ["mean_parent_reach", "max_parent_reach", "parent_diversity", "mean_lca_depth", "max_lca_depth", "n_module", "module_entropy"]


def _dataset(s, d):
    return materialize(QUERIES["feature_dataset"](s, d), "dataset")


@register("two_stage_model")
def _(s, d):
    """Both targets: paths on a log scale, children as counts."""
    rows = _dataset(s, d)
    fitted = lambda t: models.two_stage(rows, _FEATURES, "id", t, log_target=t == "y1", boosted_classes=True).select(F.lit(t).alias("target"), "*")
    with ThreadPool(2) as pool:
        one, two = pool.map(fitted, ("y1", "y2"))
    return one.union(two)


#: Labels and scores of documents: quality is the truth, the length of the text the score.
_SCORED = "sc as (select doc_id, quality, n_chars from labels join documents using (doc_id))"


def _scored(s, d):
    return v.table(s, d, "labels").join(v.table(s, d, "documents"), "doc_id").select("doc_id", "quality", "n_chars")


@register("classification_metrics", "with b as (select n_chars, sum(quality) as p, count(*) as n from sc group by 1), c as (select p, n, sum(p) over w as tp, sum(n) over w as a from b window w as (order by n_chars desc rows unbounded preceding)) select cast(sum(n) as bigint) as n, cast(sum(p) as bigint) as positives, round(sum(p * tp / a) / sum(p), 6) as average_precision, round(sum((n - p) * (tp - p / 2)) / (sum(p) * sum(n - p)), 6) as roc_auc from c", _SCORED)
def _(s, d):
    return models.classification_metrics(_scored(s, d), "quality", "n_chars")


@register("regression_metrics", "with r as (select quality, n_chars, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2 as ra, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as rb from sc) select round(avg(abs(quality - n_chars)), 6) as mae, round(1 - sum((quality - n_chars) ** 2) / (count(*) * var_pop(quality)), 6) as r2, count(*) as n, round(corr(ra, rb), 6) as spearman from r", _SCORED)
def _(s, d):
    return models.regression_metrics(_scored(s, d), "quality", "n_chars")


@register("ndcg_at_k", "with a as (select quality, row_number() over (order by n_chars desc, doc_id) as r from sc), b as (select quality, row_number() over (order by quality desc, doc_id) as r from sc) select round((select sum(quality / log2(r + 1)) from a where r <= 100) / (select sum(quality / log2(r + 1)) from b where r <= 100), 6) as ndcg", _SCORED)
def _(s, d):
    return models.ndcg_at_k(_scored(s, d), "quality", "n_chars", "doc_id", 100)


@register("baselines", "with r as (select t.id, t.y2, coalesce(max(g.out_degree), 0) as pm, any_value(t.depth) as depth from tg t left join v_edges on dst = t.id left join dg g on g.id = src group by t.id, t.y2), f as (select regr_slope(y2, pm) as s1, regr_intercept(y2, pm) as i1, regr_slope(y2, depth) as s2, regr_intercept(y2, depth) as i2 from r) select round(avg(abs(y2)), 6) as zero_mae, round(avg(abs(y2 - (i1 + s1 * pm))), 6) as parent_max_mae, round(avg(abs(y2 - (i2 + s2 * depth))), 6) as depth_mae from r, f", v.EDGES, _NODES, _DEPTH, _DEG, _TARGETS)
def _(s, d):
    from .operators import graph

    e, depth, t = _targets(s, d)
    best = e.join(graph.degrees(e).select(F.col("id").alias("src"), "out_degree"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("out_degree").alias("pm"))
    return models.baselines(t.join(depth, "id").join(best, "id", "left").na.fill(0, ["pm"]), "y2", "pm", "depth")


@register("feature_correlations")
def _(s, d):
    """All features of the dataset with both targets, depth by depth."""
    return models.feature_correlations(_dataset(s, d), _FEATURES, ["y1", "y2"], "depth")


@register("split_stability", "with m as (select doc_id, n_chars, seed, ('0x' || substr(md5(concat(doc_id, '#', seed)), 1, 8))::bigint % 100 as h from documents, range(1, 11) t(seed)), a as (select seed, avg(n_chars) as m from m where h < 20 group by 1) select count(*) as splits, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, round(min(m), 6) as least, round(max(m), 6) as most from a")
def _(s, d):
    return models.split_stability(v.table(s, d, "documents"), "doc_id", "n_chars")


@register("cascaded_model")
def _(s, d):
    return models.cascaded(_dataset(s, d), _FEATURES, "id", "y2", "y1")


@register("cascaded_by_class")
def _(s, d):
    """Errors of the cascade over all test rows and per predicted number of children."""
    return models.cascade_by_class(materialize(models.cascaded(_dataset(s, d), _FEATURES, "id", "y2", "y1"), "cascade"))


_REACH = "reach as (select src as start, dst as id from v_edges union select start, dst from reach join v_edges on src = id)"


@register("feat_parent_reach", "with n as (select e.dst, e.src, count(*) filter (b.depth < a.depth) as n from v_edges e join dp a on a.id = e.dst left join reach r on r.start = e.src left join dp b on b.id = r.id group by all) select dst as id, round(avg(n), 6) as mean_parent_reach, max(n) as max_parent_reach from n group by 1", v.EDGES, _NODES, _DEPTH, _REACH)
def _(s, d):
    e, depth = _graph(s, d)
    return features.parent_reach(e, depth, reach.descendants(e, reach.places(depth)))


@register("feat_parent_diversity", "with up as (select start as x, id as p, 0 as own from reach union all select distinct src, src, 1 from v_edges), l as (select e.dst as id, e.src as p, x, own from v_edges e join up on up.p = e.src), sz as (select id as p, count(*) as n from reach group by 1), pr as (select a.dst as id, a.src as p, b.src as q, coalesce(x.n, 0) as np, coalesce(y.n, 0) as nq from v_edges a join v_edges b on a.dst = b.dst and a.src < b.src left join sz x on x.p = a.src left join sz y on y.p = b.src), sh as (select a.id, a.p, b.p as q, count(*) filter (a.own = 0 and b.own = 0) as c, max(depth) as deep from l a join l b on a.id = b.id and a.x = b.x and a.p < b.p join dp on dp.id = a.x group by all), t as (select pr.id, case when np + nq - coalesce(c, 0) > 0 then coalesce(c, 0) / (np + nq - coalesce(c, 0)) else 0 end as j, coalesce(deep, 0) as deep from pr left join sh using (id, p, q)), g as (select id, avg(j) as j, avg(deep) as d, max(deep) as m from t group by 1) select distinct dst as id, round(1 - coalesce(j, 0), 6) as parent_diversity, round(coalesce(d, 0), 6) as mean_lca_depth, coalesce(m, 0) as max_lca_depth from v_edges left join g on g.id = dst", v.EDGES, _NODES, _DEPTH, _REACH)
def _(s, d):
    """Diversity of the parents and depth of their last common ancestors, which come from the same pairs."""
    e, depth = _graph(s, d)
    place = materialize(reach.places(depth), "places")
    return features.parent_pairs(e, reach.ancestors(e, depth, place), place)


_MASKED = "od as (select src, count(*) as k, count(*) filter (y.depth = x.depth + 1) as nx from v_edges join dp x on x.id = src join dp y on y.id = dst group by 1), rn as (select start, count(*) as n from reach group by 1), hi as (select e.dst as v, e.src as p, count(*) as h from v_edges e join v_edges c on c.src = e.src join reach r on r.start = e.dst and r.id = c.dst group by all), pv as (select e.dst as v, k - 1 - coalesce(h, 0) as o, nx - case when a.depth = b.depth + 1 then 1 else 0 end as b, rp.n - coalesce(rv.n, 0) - 1 as n from v_edges e join od on od.src = e.src join dp a on a.id = e.dst join dp b on b.id = e.src join rn rp on rp.start = e.src left join rn rv on rv.start = e.dst left join hi on hi.v = e.dst and hi.p = e.src), pm as (select v, sum(o) as os, max(o) as om, max(b) as bm, round(avg(n), 6) as na, max(n) as nm from pv group by 1), le as (select start, count(*) as l from reach join v_edges on dst = reach.id group by 1)"


@register("feat_masked", "select nd.id, coalesce(n, 0) as n_masked, (select count(*) from v_edges) - coalesce(l, 0) as n_seen_edges, coalesce(os, 0) as masked_outdeg_sum, coalesce(om, 0) as masked_outdeg_max, coalesce(bm, 0) as masked_beta_max, coalesce(na, 0) as masked_reach_mean, coalesce(nm, 0) as masked_reach_max from nd left join rn on rn.start = nd.id left join le on le.start = nd.id left join pm on pm.v = nd.id", v.EDGES, _NODES, _DEPTH, _REACH, _MASKED)
def _(s, d):
    """What the mask changes; the other features of the masked set (depth, degrees and depths of parents, diversity, ancestors, two steps up, modules) lie above the node and stay as in feature_dataset."""
    e, depth = _graph(s, d)
    place = materialize(reach.places(depth), "places")
    return features.masked(e, depth, reach.descendants(e, place), place)


_LOW = "lo as (select src, dst from v_edges join dp on dp.id = dst where depth < 2), cb as (select src as a, dst as b from lo union select dst, src from lo), cc as (select a, b from cb union select cc.a, cb.b from cc join cb on cb.a = cc.b), cm as materialized (select a as id, least(a, min(b)) as c from cc group by 1)"


@register("feat_parent_components", "with n as (select e.dst as id, coalesce(c, e.src) as c, count(*) as n from v_edges e join dp on dp.id = e.dst and depth = 2 left join cm on cm.id = e.src group by all), p as (select id, n / sum(n) over (partition by id) as p from n) select id, count(*) as n_component, round(abs(sum(-p * ln(p))), 6) as component_entropy from p group by 1", v.EDGES, _NODES, _DEPTH, _LOW)
def _(s, d):
    """Frontier at depth two."""
    return features.parent_components(*_graph(s, d), 2)


@register("feature_importance")
def _(s, d):
    """Importances of the features in boosted trees for whether a node has children, over all depths."""
    return models.importances(_dataset(s, d).withColumn("has_children", (F.col("y2") > 0).cast("double")), _FEATURES, "has_children")


#: What is known at a node's own depth, then its children, then its grandchildren too.
_R0 = [f for f in _FEATURES if f != "depth"]
_SETS = {"r0": _R0, "r1": [*_R0, "k1"], "r2": [*_R0, "k1", "k2"]}


def _grids(s, d):
    rows = _dataset(s, d)
    return {t: grid.linear_grid(rows, _SETS, t, "depth", "id", log_target=t == "y1") for t in ("y1", "y2")}


@register("model_grid")
def _(s, d):
    """Errors of a straight-line fit for each target, depth, feature set and seeded split."""
    one, two = (g.select(F.lit(t).alias("target"), "*") for t, g in _grids(s, d).items())
    return one.union(two)


@register("split_stability_models")
def _(s, d):
    """The same over its ten splits."""
    one, two = (grid.stability(g, "depth").select(F.lit(t).alias("target"), "*") for t, g in _grids(s, d).items())
    return one.union(two)


#: The dataset is the join of its blocks' own SQL.
_BLOCKS = ["feat_parent_degrees", "feat_survival_rate", "feat_upstream", "feat_parentset_rarity", "feat_parentset_similarity", "feat_cooccurrence", "feat_parent_reach", "feat_parent_diversity", "feat_mixture", "feat_peek"]
_COLUMNS = ", ".join(f"coalesce({c}, {int(c == 'parent_diversity')}) as {c}" for c in [*_FEATURES[2:], "k1", "k2"])
_JOINS = " ".join(f"left join ({ORACLES[b]}) b{i} using (id)" for i, b in enumerate(_BLOCKS))
ORACLES["feature_dataset"] = f"with recursive {v.EDGES}, {_NODES}, {_DEPTH}, {_DEG}, {_TARGETS} select id, depth, in_degree as indeg_seen, {_COLUMNS}, y1, y2 from dp join dg using (id) {_JOINS} join (select id, y1, y2 from tg) t using (id)"
ORACLES["feature_correlations"] = f"with f as materialized ({ORACLES['feature_dataset']}), l as (unpivot (select depth, {', '.join(f'{c}::double as {c}' for c in _FEATURES[1:])}, y1 as t1, y2::double as t2 from f) on {', '.join(_FEATURES[1:])} into name feature value x), m as (select depth, feature, x, unnest(['y1', 'y2']) as target, unnest([t1, t2]) as y from l), k as (select *, rank() over (partition by depth, feature, target order by x) + (count(*) over (partition by depth, feature, target, x) - 1) / 2 as rx, rank() over (partition by depth, feature, target order by y) + (count(*) over (partition by depth, feature, target, y) - 1) / 2 as ry from m) select depth, feature, target, count(*) as n, round(corr(rx, ry), 6) + 0 as spearman from k group by all having min(x) < max(x) and min(y) < max(y)"
