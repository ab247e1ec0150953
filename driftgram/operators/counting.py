"""Counts of n-grams in buckets, their denominators and corpus totals.

Input is one row a text with ``bucket`` (date) and ``tokens`` (array<string>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ngrams


#: Bytes of a source that one task takes: what it makes of them, n-grams most of all, then fits its memory unspilled.
PIECE_BYTES = 4 << 20


#: Up to this size an input is dealt out to all cores; larger ones have splits of their own.
SPREAD_BYTES = 256 << 20


def source_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small ``df`` over all cores where its source has fewer splits, as one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if source_bytes(df) <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def pieces(df: DataFrame) -> int:
    """As many as there are cores at least. Where Spark can't tell a source's size, as many as it has splits, or as shuffles have."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, source_bytes(df)
    if size >= 1 << 60:
        return max(cores, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, -(-size // PIECE_BYTES))


def in_pieces(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out in pieces of bounded size, and to all cores, where its source has fewer splits. That shuffles all of it
    each time it is read, so it is for what holds more than its input in memory. Pieces are ranges of ``by``, in order, so that
    what is counted by it is summed before it is sent on; its last column should tell rows apart."""
    n = pieces(df)
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by) if by else df.repartition(n)


def ngram_counts(texts: DataFrame, max_n: int = 3) -> DataFrame:
    """(bucket, n, ngram, count): occurrences, summed before and after the shuffle."""
    return ngrams.of_orders(texts, max_n, "bucket").groupBy("bucket", "n", "ngram").agg(F.count("*").alias("count"))


def order_counts(texts: DataFrame, n: int) -> DataFrame:
    """(bucket, ngram, count) of one order."""
    return ngrams.of_order(texts, n, "bucket").groupBy("bucket", "ngram").agg(F.count("*").alias("count"))


def token_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, token, occurrences) of texts with ``key`` and ``tokens``, where a key has few rows. Tokens are dealt out by key before
    they are exploded, in pieces of bounded size, which Spark doesn't put together as it does with shuffled sums."""
    dealt = texts.select(key, "tokens").repartition(pieces(texts), key)
    return ngrams.exploded(dealt, "tokens", "token", key).groupBy(key, "token").agg(F.count("*").alias("occurrences"))


def bucket_totals(texts: DataFrame, max_n: int = 3) -> DataFrame:
    """(bucket, n, total_count) from token numbers alone: the texts aren't exploded."""
    sums = texts.groupBy("bucket").agg(*(F.sum(ngrams.window_count(F.col("tokens"), n)).alias(f"t{n}") for n in range(1, max_n + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(n).cast("byte").alias("n"), F.col(f"t{n}").alias("t")) for n in range(1, max_n + 1))))
    return sums.select("bucket", each.alias("x")).select("bucket", "x.n", F.col("x.t").alias("total_count")).where("total_count > 0")


def totals_of_counts(counts: DataFrame) -> DataFrame:
    """The same denominators from counts of which none has been pruned."""
    return counts.groupBy("bucket", "n").agg(F.sum("count").alias("total_count"))


def global_counts(counts: DataFrame) -> DataFrame:
    """(n, ngram, count) over all buckets."""
    return counts.groupBy("n", "ngram").agg(F.sum("count").alias("count"))


def asked_counts(texts: DataFrame, asked: DataFrame, max_n: int = 3) -> DataFrame:
    """(n, ngram, count) over all texts of the n-grams that are asked for (n, ngram): others are dropped before they are counted."""
    return ngrams.of_orders(texts, max_n).join(asked.select("n", "ngram").distinct(), ["n", "ngram"], "left_semi").groupBy("n", "ngram").agg(F.count("*").alias("count"))


def merged(*counts: DataFrame) -> DataFrame:
    """The sum of several count tables with the same columns."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    keys = [c for c in out.columns if c not in ("count", "total_count")]
    return out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in out.columns if c not in keys))


def rows_by_order(table: DataFrame) -> DataFrame:
    return table.groupBy("n").agg(F.count("*").alias("rows"))
