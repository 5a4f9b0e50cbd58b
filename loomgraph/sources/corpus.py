"""Reading text corpora and upload folders, writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# What an upload may be.
SUFFIXES = ("md", "markdown", "txt", "text", "rst")
MOST_BYTES = 2_000_000


def load_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """(seq, op, doc_id, uri, content): one ``add`` for each .txt and .md file below the folder, in path order."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(directory)
    named = rows.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content")).filter(F.lower("uri").rlike(r"\.(txt|md)$"))
    return named.select(F.xxhash64("uri").alias("seq"), F.lit("add").alias("op"), text.slug(F.col("uri")).alias("doc_id"), "uri", "content")


def intake(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(accepted changes, rejected files with a reason) of an upload folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    body = F.try_validate_utf8(F.col("content").cast("string"))
    reason = (
        F.when(~kind.isin(*SUFFIXES), "unsupported suffix")
        .when(F.col("length") > MOST_BYTES, "too large")
        .when(body.isNull(), "not UTF-8")
        .when(text.strip(body) == "", "empty")
    )
    judged = files.select(F.col("path").alias("uri"), body.alias("content"), reason.alias("reason"))
    good = judged.filter("reason is null").select(F.xxhash64("uri").alias("seq"), F.lit("add").alias("op"), text.slug(F.col("uri")).alias("doc_id"), "uri", "content")
    return good, judged.filter("reason is not null").select("uri", "reason")


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, and as JSON."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
        df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.json")
