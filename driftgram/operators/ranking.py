"""Rankings, look-ups and latest-row selection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pruning import Pruning

#: The shares of orders 1 to 5 in a pool of popular phrases, of 137 in all.
STRATA = (60, 30, 20, 15, 12)


def strata_sizes(limit: int) -> dict[int, int]:
    """How many phrases of each order a pool of ``limit`` holds (ties to even)."""
    return {n: round(limit * share / sum(STRATA)) for n, share in enumerate(STRATA, 1)}


def popular_phrases(counts: DataFrame, limit: int, today: dt.date, days: int) -> DataFrame:
    """(recent_count, n, ngram): each order's most frequent n-grams of the last days, equal counts by n-gram."""
    sizes = strata_sizes(limit)
    recent = counts.where(F.col("bucket") >= F.lit(today - dt.timedelta(days=days))).where(F.col("n").isin(list(sizes)))
    summed = recent.groupBy("n", "ngram").agg(F.sum("count").alias("recent_count"))
    most = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))
    # within one scan: each task keeps an order's first rows before the shuffle, for the rank is bounded by a constant
    best = ranked(summed, ["n"], [F.desc("recent_count"), F.col("ngram")]).where((F.col("rn") <= max(sizes.values())) & (F.col("rn") <= most[F.col("n").cast("int")]))
    return best.select("recent_count", "n", "ngram").orderBy("n", F.desc("recent_count"), "ngram")


def ranked(table: DataFrame, within: Sequence[str], by: Sequence[Column], column: str = "rn") -> DataFrame:
    return table.withColumn(column, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))


def latest(table: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """One row a key, the one of greatest ``version``; equal versions are settled by the other columns."""
    others = [c for c in table.columns if c not in key]
    best = F.max(F.struct(version, *(c for c in others if c != version))).alias("b")
    return table.groupBy(*key).agg(best).select(*key, *(F.col(f"b.{c}").alias(c) for c in others))


def vocabulary_check(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pos, n, ngram, found) for asked (pos, n, ngram), in order of ``pos``."""
    known = vocabulary.select("n", "ngram").distinct().withColumn("found", F.lit(True))
    return asked.join(known, ["n", "ngram"], "left").select("pos", "n", "ngram", F.coalesce("found", F.lit(False)).alias("found")).orderBy("pos")


def new_admissions(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.select("n", "ngram").join(before.select("n", "ngram"), ["n", "ngram"], "left_anti")


def all_admitted(now: DataFrame, before: DataFrame) -> DataFrame:
    """Vocabularies only grow."""
    return now.select("n", "ngram").union(before.select("n", "ngram")).distinct()


def admissions(totals: DataFrame, pruning: Pruning) -> tuple[DataFrame, DataFrame]:
    """:func:`new_admissions` and :func:`all_admitted` from (n, ngram, count, early): totals now and of an earlier time, side
    by side in a row. What didn't occur earlier wasn't admitted, whatever the threshold."""
    n = F.col("n")
    now, before = pruning.admits(F.col("count"), n), (F.col("early") > 0) & pruning.admits(F.col("early"), n)
    return totals.where(now & ~before).select("n", "ngram"), totals.where(now | before).select("n", "ngram")


def with_global_counts(vocabulary: DataFrame, global_counts: DataFrame) -> DataFrame:
    found = global_counts.select("n", "ngram", F.col("count").alias("g"))
    return vocabulary.select("n", "ngram").join(found, ["n", "ngram"], "left").select("n", "ngram", F.coalesce("g", F.lit(0)).alias("global_count"))


def ranges(values: DataFrame, column: str, pieces: int) -> DataFrame:
    """(piece, value, count): distinct values that aren't null, dealt by ranges. To be stored before use, for the bounds are drawn anew each time."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return counted.repartitionByRange(pieces, "value").select(F.spark_partition_id().alias("piece"), "value", "count")


def discrete_percentiles(pieces: DataFrame, shares: dict[str, str]) -> DataFrame:
    """One row with the least value that each share of all rows doesn't exceed, from stored :func:`ranges`; shares are decimals.

    A row a piece says in which piece each is, and only a piece's own values are put in order, so no task gets all of them.
    """
    sizes = pieces.groupBy("piece").agg(F.sum("count").alias("size"), F.min("value").alias("least"))
    sums = sizes.select("piece", (F.sum("size").over(Window.orderBy("least")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    so_far = Window.partitionBy("piece").orderBy("value")
    ranked = pieces.join(sums, "piece").withColumn("upto", F.col("before") + F.sum("count").over(so_far))
    out = []
    for name, share in shares.items():
        whole, _, rest = share.partition(".")
        parts, number = 10 ** len(rest), int(whole + rest)
        place = F.greatest(F.lit(1), F.expr(f"(`all` * {number} + {parts - 1}) div {parts}"))
        out.append(F.min(F.when(F.col("upto") >= place, F.col("value"))).alias(name))
    return ranked.agg(*out)
