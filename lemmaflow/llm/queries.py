"""The registered query of each operator, with production parameters over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import new_path
from . import binary_records, conversations, decontaminate, importance, jaccard, license_scan, line_dedup, minmax, packing, quality, sql, token_counts, url_filter, warc
from .ship import ship_package

#: Rules of the URL filter query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: 50 to a directory, 20 directories to one above, below language and source. The first of each of these is its licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    top, mid = F.concat_ws("/", "source", "lang"), F.concat(F.lit("d"), F.expr("cast(doc_id div 1000 as string)"))
    low, name = F.concat(F.lit("e"), F.expr("cast(doc_id div 50 as string)")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.when(F.expr("doc_id % 1000 = 0"), F.concat_ws("/", top, F.lit("LICENSE"))).when(F.expr("doc_id % 200 = 0"), F.concat_ws("/", top, mid, F.lit("LICENSE")))
    path = path.when(F.expr("doc_id % 25 = 0"), F.concat_ws("/", top, mid, low, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, mid, low, name))
    return license_scan.scan(docs.withColumn("path", path))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    manifest = binary_records.write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return binary_records.read(spark, path, manifest)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.add_counts(docs, tokenizer_path("piece_bpe_32k.model"), byte_fallback=True).select("doc_id", "n_tokens")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", F.octet_length("block").cast("long").alias("block_bytes"), F.map_keys("headers").alias("header_names"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    report, _ = conversations.repair(conversations.damage(chats), chats)
    return report


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.components(table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard_join, op3_license_scan, op4_best_fit_packing, op5_warc_derivatives, op6_url_filter, op7_token_counts, op8_line_dedup, op9_quality_rules, op10_binary_records, op11_conversation_repair, op12_importance_resampling, op13_minmax_near_dedup)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op2_ngram_jaccard_join": sql.jaccard_components(4, 85),
    "op13_minmax_near_dedup": sql.jaccard_components(2, 80, kept=True),
    "op11_conversation_repair": sql.CONVERSATIONS,
    "op12_importance_resampling": sql.IMPORTANCE,
    "op6_url_filter": f"""
with r(rh, rp, verdict) as (values {_RULES_SQL}),
u as (select row_number() over () as k, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select p.k, r.rh || r.rp as rule, r.verdict, row_number() over (partition by p.k order by length(r.rh) desc, length(r.rp) desc) as n
      from p join r on (p.host = r.rh or ends_with(p.host, '.' || r.rh)) and starts_with(p.path, r.rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m on p.k = m.k and m.n = 1""",
    "op8_line_dedup": """
with d as (select row_number() over () as k, doc_id, source, text, string_split(text, chr(10)) as lines from documents),
l as (select k, source, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
c as (select source, line, count(distinct k) as pages from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all),
b as (select source, line from c join (select source, count(*) as host_pages from d group by all) t using (source) where pages >= 5 and pages > 0.1 * host_pages),
x as (select k, count(b.line) as n_dropped, string_agg(case when b.line is null then l.line end, chr(10) order by pos) as kept
      from l left join b on l.source = b.source and l.line = b.line group by k)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(n_dropped, 0) as n_dropped,
       md5(case when text is null then null when coalesce(n_dropped, 0) = 0 then text else coalesce(kept, '') end) as text_md5
from d left join x using (k)""",
}
