"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token shards.

Each stage takes all documents that its predecessor kept, as reread Parquet.
All but the last return the columns of ``documents``.

``run`` gives each stage a scope of its own for its intermediate tables and
broadcasts; what earlier runs returned is left alone.

Cases: null and empty texts fail the quality rules; of rows that repeat a
``doc_id`` near-dedup keeps one; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, mixing, near_dedup, quality_rules, scratch, token_shards
from loomgraph.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No stage but the first has rows that SQL can express; see tests/llm for the brute-force versions.
ORACLE_SQL = None

def _with(docs: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``kept``."""
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and their language's perplexity band."""
    return quality_rules.passing(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    with scratch.scope(spark):
        kept = scratch.stage(near_dedup.near_duplicates(docs).filter("kept").select("doc_id"), "kept", outer=True)
    named = _with(docs, kept, docs.columns)
    if kept.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty():
        one = named
    else:
        one = named.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang"))).filter("_row = 1").drop("_row")
    return one.unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row in the token shards."""
    return token_shards.token_shards(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, with every stage applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch.new_path(spark, name)
        with scratch.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            scratch.drop(spark, before)
        before = path
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
