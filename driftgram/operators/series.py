"""Series over counts and totals: join, re-bucketing, gap filling, smoothing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, formatting

MAX_ORDER = 5


def _selected(counts: DataFrame, n: int, ngrams: Iterable[str], start: dt.date, end: dt.date) -> DataFrame:
    ngrams = list(ngrams)
    if not 1 <= n <= MAX_ORDER:
        raise ValueError(f"order {n} is not in 1 to {MAX_ORDER}")
    if not ngrams:
        raise ValueError("no n-grams given")
    rows = counts.where((F.col("n") == n) & F.col("ngram").isin(ngrams) & F.col("bucket").between(F.lit(start), F.lit(end)))
    if "ym" in counts.columns:  # a range of buckets doesn't prune the partition column by itself
        rows = rows.where(F.col("ym").between(start.year * 100 + start.month, end.year * 100 + end.month))
    # a key appears once, however often a run was repeated
    return rows.groupBy("bucket", "ngram").agg(F.sum("count").alias("count"))


def _totals(totals: DataFrame, n: int, start: dt.date, end: dt.date) -> DataFrame:
    return totals.where((F.col("n") == n) & F.col("bucket").between(F.lit(start), F.lit(end))).groupBy("bucket").agg(F.sum("total_count").alias("total_count"))


def stored_series(counts: DataFrame, totals: DataFrame, n: int, ngrams: Iterable[str], start: dt.date, end: dt.date, ordered: bool = True) -> DataFrame:
    """(bucket, ngram, count, total_count) of the stored buckets, by bucket if ``ordered``."""
    out = _selected(counts, n, ngrams, start, end).join(_totals(totals, n, start, end), "bucket").select("bucket", "ngram", "count", "total_count")
    return out.orderBy("bucket", "ngram") if ordered else out


def rebucketed_series(
    counts: DataFrame, totals: DataFrame, n: int, ngrams: Iterable[str], start: dt.date, end: dt.date, granularity: str, denominator: str = "matched", ordered: bool = True
) -> DataFrame:
    """(bucket, ngram, sum_count, sum_total) of coarser buckets, by bucket if ``ordered``.

    With ``denominator="matched"`` a coarse bucket's total covers the stored buckets in which the
    n-gram itself occurs; with ``"full"`` it covers all of them.
    """
    bucket = dates.query_bucket(F.col("bucket"), granularity)
    picked, of_order = _selected(counts, n, ngrams, start, end), _totals(totals, n, start, end)
    if denominator == "matched":
        joined = picked.join(of_order, "bucket")
        out = joined.groupBy(bucket.alias("bucket"), "ngram").agg(F.sum("count").alias("sum_count"), F.sum("total_count").alias("sum_total"))
    elif denominator == "full":
        tops = picked.groupBy(bucket.alias("bucket"), "ngram").agg(F.sum("count").alias("sum_count"))
        out = tops.join(of_order.groupBy(bucket.alias("bucket")).agg(F.sum("total_count").alias("sum_total")), "bucket")
    else:
        raise ValueError("denominator is 'matched' or 'full'")
    out = out.select("bucket", "ngram", "sum_count", "sum_total")
    return out.orderBy("bucket", "ngram") if ordered else out


def points(series: DataFrame) -> DataFrame:
    """(ngram, t, v, count, total) of what occurs, from either kind of series."""
    columns = ["sum_count", "sum_total"] if "sum_count" in series.columns else ["count", "total_count"]
    count, total = (F.col(c).alias(a) for c, a in zip(columns, ("count", "total"), strict=True))
    rows = series.select("ngram", F.col("bucket").alias("t"), count, total).where("total > 0 AND count > 0")
    return rows.select("ngram", "t", (F.col("count").cast("double") / F.col("total")).alias("v"), "count", "total")


def zero_filled(points: DataFrame, start: dt.date, end: dt.date, granularity: str) -> DataFrame:
    """Each n-gram's points with zeros between, from the aligned start to its last point or ``end``."""
    last = points.groupBy("ngram").agg(F.max("t").alias("last"))
    days = dates.calendar(F.lit(start), F.least(F.col("last"), F.lit(end)), granularity)
    dense = last.select("ngram", F.explode(days).alias("t"))
    filled = dense.join(points, ["ngram", "t"], "left")
    return filled.select("ngram", "t", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def smoothed(points: DataFrame, width: int) -> DataFrame:
    """Centred moving average of ``v``; an even width looks one row further back than ahead."""
    if width <= 1:
        return points
    around = Window.partitionBy("ngram").orderBy("t").rowsBetween(-(width // 2), -(-width // 2) - 1)
    return points.withColumn("v", F.avg("v").over(around))


def chart(points: DataFrame, log: bool = False) -> DataFrame:
    """(ngram, t, v or null, count, total, v_text, count_text): what a chart draws and its tooltip says."""
    v = formatting.log_scale(F.col("v")) if log else F.col("v")
    return points.select("ngram", "t", v.alias("v"), "count", "total", formatting.format_frequency(v).alias("v_text"), formatting.format_count(F.col("count")).alias("count_text"))
