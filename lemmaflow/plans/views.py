"""The tables that the registered queries read, bound to the given ones. Each has the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(theorem, idx, head): a user's events of one week are the steps of one proof."""
    week = F.date_trunc("week", "ts")
    order = Window.partitionBy("user_id", week).orderBy("ts", "event_id")
    name = F.concat(F.col("user_id").cast("string"), F.lit("/"), week.cast("date").cast("string"))
    return table(spark, sf_dir, "events").select(name.alias("theorem"), (F.row_number().over(order) - 1).alias("idx"), F.col("event_type").alias("head"))


def premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(theorem, premise), distinct: an order cites the kinds of its parts."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("theorem"), F.concat_ws(".", "p_brand", "p_type").alias("premise")).distinct()


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(theorem, premise): an order cites the brands of its parts, a row for each line."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("theorem"), F.col("p_brand").alias("premise"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), distinct, no loops: an order cites the last one before it that took as many of the same part. Of all lines."""
    before = Window.partitionBy("l_partkey", "l_quantity").orderBy("l_orderkey", "l_linenumber")
    pairs = table(spark, sf_dir, "lineitem").select(F.lag("l_orderkey").over(before).alias("src"), F.col("l_orderkey").alias("dst"))
    return pairs.filter("src is not null and src <> dst").distinct()


def part_edges(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> DataFrame:
    """(src, dst), distinct, no loops: parts that follow each other in an order; acyclic ones go from the smaller to the larger key."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).filter("b is not null and a <> b")
    ends = (F.col("a"), F.col("b")) if cyclic else (F.least("a", "b"), F.greatest("a", "b"))
    return pairs.select(ends[0].alias("src"), ends[1].alias("dst")).distinct()


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part_edges`` of the whole table: few nodes, many edges."""
    return part_edges(spark, sf_dir)


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part_edges`` of all lines from each part to the one that follows it: nearly all parts lie on cycles."""
    return part_edges(spark, sf_dir, cyclic=True)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, full_name)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws(".", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("full_name"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


STEPS = "v_steps as (select concat(cast(user_id as varchar), '/', cast(cast(date_trunc('week', ts) as date) as varchar)) as theorem, row_number() over (partition by user_id, date_trunc('week', ts) order by ts, event_id) - 1 as idx, event_type as head from events)"
PREMISES = "v_prem as (select distinct l_orderkey as theorem, concat(p_brand, '.', p_type) as premise from lineitem join part on l_partkey = p_partkey)"
EDGES = "v_edges as materialized (select distinct src, dst from (select lag(l_orderkey) over (partition by l_partkey, l_quantity order by l_orderkey, l_linenumber) as src, l_orderkey as dst from lineitem) p where src is not null and src <> dst)"
CYCLIC = "v_cyc as materialized (select distinct a as src, b as dst from (select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as b from lineitem) p where b is not null and a <> b)"
CORPUS = "v_corpus as (select p_partkey as seq, concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')) as full_name from part)"
LINES = "v_lines as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents)"

#: Heads of the tactics that are made from the parts.
HEADS = ["rw", "simp only", "exact", "apply", "intro", "cases", "· exact", "rfl"]


def tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, tactic): a tactic that cites the part's full name, its type and a hypothesis."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_size") % 8 + 1).cast("int"))
    full = F.concat_ws(".", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("_")))
    text = F.concat(head, F.lit(" ["), F.replace(full, F.lit("#"), F.lit("")), F.lit(", *] at h"), F.col("p_size").cast("string"), F.lit(" using "), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), text.alias("tactic"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, before, after): proof states that declare variables, a hypothesis and an instance made from the part."""
    size = F.col("p_size").cast("string")
    before = F.concat(F.lit("x y : "), F.col("p_type"), F.lit("\nhk"), size, F.lit(" : "), F.col("p_brand"), F.lit(" = 1\ninst✝ : Mul "), F.col("p_brand"), F.lit("\n⊢ "), F.col("p_name"), F.lit("\n  more"))
    after = F.when(F.col("p_size") % 5 == 0, "no goals").otherwise(F.concat(F.lit("x z : "), F.col("p_type"), F.lit("\n⊢ "), F.col("p_name"), F.lit("\n\ncase b\n⊢ q")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), before.alias("before"), after.alias("after"))


TACTICS = "v_tac as (select p_partkey as seq, concat(['rw', 'simp only', 'exact', 'apply', 'intro', 'cases', '· exact', 'rfl'][p_size % 8 + 1], ' [', replace(concat(p_brand, '.', replace(p_type, ' ', '_'), '.', replace(p_name, ' ', '_')), '#', ''), ', *] at h', p_size, ' using ', p_name) as tactic from part)"
STATES = "v_st as (select p_partkey as seq, p_size, p_type, p_brand, p_name, concat('x y : ', p_type, chr(10), 'hk', p_size, ' : ', p_brand, ' = 1', chr(10), 'inst✝ : Mul ', p_brand, chr(10), '⊢ ', p_name, chr(10), '  more') as before, case when p_size % 5 = 0 then 'no goals' else concat('x z : ', p_type, chr(10), '⊢ ', p_name, chr(10), chr(10), 'case b', chr(10), '⊢ q') end as after from part)"


#: How the statements that are made from the parts begin.
OPENINGS = ["theorem ", "lemma ", "private def ", "@[simp] protected theorem ", "@[simp, norm_cast] @[to_additive] noncomputable instance ", "abbrev  "]
#: What follows a name in them.
BINDERS = [" (x : Nat) : x = x", "{a b : Nat} : a = b", "[Mul G] : True", " : 1 = 1", ":= by simp"]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, statement): declarations of the part's full name, of a suffix of it, of a name that has its words the other way round, or of none."""
    size, last, pick = F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("_")), lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    turned = F.concat_ws("_", F.reverse(F.split("p_name", " ")))
    name = F.when(size % 5 == 0, F.concat_ws(".", "p_brand", "p_type", last)).when(size % 5 == 1, last).when(size % 5 == 2, F.concat_ws(".", "p_type", last)).when(size % 5 == 3, turned).otherwise(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("Missing."), last)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(pick(OPENINGS, F.col("p_partkey")), name, pick(BINDERS, F.col("p_partkey") + size)).alias("statement"))


STATEMENTS = "v_stmt as (select p_partkey as seq, concat({}[p_partkey % 6 + 1], case p_size % 5 when 0 then concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')) when 1 then replace(p_name, ' ', '_') when 2 then concat(p_type, '.', replace(p_name, ' ', '_')) when 3 then array_to_string(list_reverse(string_split(p_name, ' ')), '_') else case when p_partkey % 3 = 0 then '' else concat('Missing.', replace(p_name, ' ', '_')) end end, {}[(p_partkey + p_size) % 5 + 1]) as statement from part)".format(OPENINGS, BINDERS)
#: The name of a declaration, read from its text.
SHORT_NAME = r"regexp_extract(statement, '(?:theorem|lemma|def|instance|abbrev)\s+([^\s(\[:{]*)', 1)"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(theorem, idx, tactic, before, after, premises): twenty parts in the order of their keys are a proof; a step starts from the state that the one before left, or from its own if that left none."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.array("p_brand").alias("premises"))
    rows = states(spark, sf_dir).join(tactics(spark, sf_dir), "seq").join(parts, "seq").withColumn("theorem", F.floor(F.col("seq") / 20)).withColumn("idx", F.col("seq") % 20)
    last = F.lag("after").over(Window.partitionBy("theorem").orderBy("idx"))
    return rows.select("theorem", "idx", F.concat("tactic", F.lit(" x")).alias("tactic"), F.coalesce(F.when(last != "no goals", last), "before").alias("before"), "after", "premises")


TRACES = "v_tr as materialized (select *, coalesce(lag(done) over w, true) as fresh, lag(idx) over w as last, lag(p_type) over w as last_type from (select p_partkey // 20 as theorem, p_partkey % 20 as idx, p_type, p_brand, p_name, p_size % 5 = 0 as done from part) window w as (partition by theorem order by idx))"
