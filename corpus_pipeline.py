"""A corpus pipeline: quality classifier, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns they were given. The last returns one row for each row it was given, with
its shard and slot as they lie in the files it wrote.

Edge cases, for every stage: a null text counts as empty. Such texts are scored by the classifier
like any other, are near-duplicates of each other (one stays), contain no benchmark item, have no
words to mix (their source's rate decides how many stay) and take one byte of a shard. Texts of any
length are read whole. Null ids are kept and told apart by their texts; a null source is one source.
Rows that repeat an id and text are one row after the second stage; ties (equal sizes, equal
fingerprints) are settled by ids and keyed hashes. Extra columns, whatever their names, are carried
to the last stage, which returns its own columns only. An empty table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftgram.llm import common, decontamination, mixing, quality_classifier, resharding, simhash_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, common.table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    return simhash_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it: not at all, once or twice."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's new shard and its slot there."""
    return resharding.digest(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is trained and the fingerprints are XXH64 sums, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written as Parquet and read again, and removed once the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = common.new_path(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.removed(spark, before)
        before = path
    return docs
