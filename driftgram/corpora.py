"""Text corpora with dates, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import with_tokens
from .operators.counting import in_pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, doc_id, text), as they lie: a date of 2024 from the document's id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int"))
    return table(spark, sf_dir, "documents").select(day.alias("bucket"), "doc_id", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, text) of :func:`dated_documents`, in pieces."""
    return in_pieces(dated_documents(spark, sf_dir), "bucket", "doc_id").select("bucket", "text")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, text): names of the parts shipped on each day. Each part's name is short; lines are many."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("bucket"))
    return lines.join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name AS text"), "l_partkey").select("bucket", "text")


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, tokens) of :func:`part_names`, each part tokenized once, before the join."""
    parts = with_tokens(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name AS text")).select("l_partkey", "tokens")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("bucket"))
    return lines.join(parts, "l_partkey").select("bucket", "tokens")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_pieces(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text")))
