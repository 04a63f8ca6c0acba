"""From raw documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm import decontaminate, jaccard, line_dedup, packing, quality
from lemmaflow.llm.queries import table, tokenizer_path
from lemmaflow.llm.ship import ship_package
from lemmaflow.plans.durable import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, so null, empty and short texts too. Rows are judged one by one: repeated ones alike, those with a null id like others.
    An empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source (a null one is a source too) go; n_chars follows the text. No row goes: null texts stay null, a text of boilerplate alone becomes empty.
    Repeated rows are pages of their own."""
    taken = {c.lower() for c in docs.columns}
    counts = tuple(next(f"{c}{k}" for k in range(len(taken) + 1) if f"{c}{k}" not in taken) for c in ("n_lines", "n_dropped"))
    out = line_dedup.drop_boilerplate(docs, counts=counts)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, with all rows of that id. Null and empty texts and rows with a null id are copies of nothing and stay."""
    ship_package(spark)
    return jaccard.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, all rows of that id. Null and empty texts and rows with a null id stay; without items, all do."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows that are left, in sequences of 4096 tokens. A null or empty text is one end id; rows that repeat an id are packed each."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", packed_sequences),
]

#: Hashed scores and packings aren't SQL. tests/llm/test_pipeline.py holds line deduplication, near duplicates and packing against plain versions; the other stages are tested by planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
