"""Requests as a relation: a table of them is checked, answered and written as JSON in one plan.

What :class:`~driftgram.plans.phrases.PhraseQueries` does for one phrase in a few small jobs, this does for any
number: the phrases are normalised as a column, their n-grams and ranges are joined to the stored tables, of
which only the months and hash partitions that some request needs are read, and each request gets its
status, corpus total and points. Feedback is checked as a column, too.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import TOKENIZER_VERSION, with_tokens
from ..operators import series
from ..sources.store import Store, bucket
from .phrases import MAX_AGENT_BYTES, MAX_PHRASE_BYTES, MAX_PHRASES, MAX_SMOOTHING

POINT = "struct<t:date,v:double,count:bigint,total:bigint>"


def checked(asked: DataFrame, today: dt.date | None = None) -> DataFrame:
    """``asked`` (phrase, start, end, granularity: strings or null) with ``first``, ``last``, ``grain``, or else ``error``:
    the code of the first fault in the documented order."""
    today = today or dt.datetime.now(dt.UTC).date()
    given = lambda name: F.nullif(F.col(name), F.lit(""))
    start, end = (F.when(given(name).isNull(), F.lit(default)).otherwise(dates.parsed_date(F.col(name))) for name, default in (("start", dates.DEFAULT_START), ("end", today)))
    (first, _), (_, last) = dates.month_bounds(start), dates.month_bounds(end)
    grain = dates.parsed_granularity(F.coalesce(given("granularity"), F.lit("month")))
    error = (
        F.when(given("phrase").isNull(), "MISSING_PHRASE").when(start.isNull() | end.isNull(), "INVALID_DATE_FORMAT")
        .when(first > last, "INVALID_DATE_RANGE").when(grain.isNull(), "INVALID_GRANULARITY")
    )
    return asked.withColumns({"first": first.cast("date"), "last": last, "grain": grain}).withColumn("error", error)


def _wanted(keys: DataFrame, table: str, state: dict) -> tuple[list[int], int | None, int | None]:
    """The hash partitions and the months that some key needs: at most as many numbers as there are partitions."""
    h = bucket(F.col("n"), F.col("ngram"), state["buckets"][table])
    month = lambda day: F.year(day) * 100 + F.month(day)
    row = keys.agg(F.collect_set(h).alias("h"), F.min(month("first")).alias("a"), F.max(month("last")).alias("b")).first()
    return sorted(row["h"]), row["a"], row["b"]


def answers(store: Store, asked: DataFrame, denominator: str = "matched", today: dt.date | None = None, state: dict | None = None) -> DataFrame:
    """``asked`` with normalized, n, first, last, grain, error, status, global_count and points (by time), a row a request.

    A request with an error has a null status; one of no or more than five tokens is ``invalid``.
    """
    state = state or store.state()
    rows = with_tokens(checked(asked, today), "phrase").withColumn("normalized", F.array_join("tokens", " ")).withColumn("n", F.when(F.col("error").isNull(), F.size("tokens"))).drop("tokens")
    valid = F.col("n").between(1, series.MAX_ORDER)
    keys = rows.where(valid).select(F.col("n").cast("byte").alias("n"), F.col("normalized").alias("ngram"), "first", "last", "grain").distinct()
    h, a, b = _wanted(keys, "ngram_counts", state)
    counts = store.read("ngram_counts", state).where(F.col("h").isin(h) & F.col("ym").between(F.lit(a), F.lit(b)))
    hit = keys.join(counts.select("n", "ngram", "bucket", "count"), ["n", "ngram"]).where("bucket BETWEEN first AND last")
    key = ["n", "ngram", "first", "last", "grain"]
    daily = hit.groupBy(*key, "bucket").agg(F.sum("count").alias("count"))
    totals = store.read("bucket_totals", state).groupBy("n", "bucket").agg(F.sum("total_count").alias("total"))
    coarse = lambda c: dates.bucket_by(F.col(c), F.col("grain"))
    if denominator == "matched":
        each = daily.join(totals, ["n", "bucket"]).withColumn("t", coarse("bucket")).groupBy(*key, "t").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    elif denominator == "full":
        spans = keys.select("n", "first", "last", "grain").distinct().join(totals, "n").where("bucket BETWEEN first AND last")
        wide = spans.withColumn("t", coarse("bucket")).groupBy("n", "first", "last", "grain", "t").agg(F.sum("total").alias("total"))
        each = daily.withColumn("t", coarse("bucket")).groupBy(*key, "t").agg(F.sum("count").alias("count")).join(wide, ["n", "first", "last", "grain", "t"])
    else:
        raise ValueError("denominator is 'matched' or 'full'")
    point = F.struct("t", (F.col("count").cast("double") / F.col("total")).alias("v"), "count", "total")
    points = each.where("count > 0 AND total > 0").groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("points"))  # at most a point a bucket
    h, *_ = _wanted(keys, "global_counts", state)
    known = [store.read(t, state).where(F.col("h").isin(h)) for t in ("global_counts", "ngram_vocabulary")]
    shown = F.when(F.col("count") >= state["export_floor"], F.col("count"))
    overall = known[0].select("n", "ngram", shown.alias("global_count"))
    admitted = known[1].select("n", "ngram", F.lit(True).alias("admitted"))
    told = keys.join(points, key, "left").join(overall, ["n", "ngram"], "left").join(admitted, ["n", "ngram"], "left")
    told = told.select(*(F.col(c).alias(f"key_{c}") for c in key), "points", "global_count", "admitted")
    same = [F.col("n") == F.col("key_n"), F.col("normalized") == F.col("key_ngram"), *(F.col(c) == F.col(f"key_{c}") for c in ("first", "last", "grain"))]
    out = rows.join(told, same, "left").drop(*(f"key_{c}" for c in key))
    status = F.when(F.col("error").isNotNull(), None).when(~valid, "invalid").when((F.col("n") == 1) | (F.size("points") > 0) | F.col("admitted"), "indexed").otherwise("not_indexed")
    filled = {"status": status, "global_count": F.coalesce("global_count", F.lit(0)), "points": F.coalesce("points", F.array().cast(f"array<{POINT}>"))}
    return out.withColumns(filled).drop("admitted")


def bodies(answered: DataFrame) -> DataFrame:
    """Answers with ``http`` (200 or 400) and ``body``, the JSON that is sent."""
    point = lambda p: F.struct(p["t"].cast("string").alias("t"), p["v"].alias("v"), p["count"].alias("count"), p["total"].alias("total"))
    meta = F.struct(F.lit(TOKENIZER_VERSION).alias("tokenizer_version"), F.col("first").cast("string").alias("start"), F.col("last").cast("string").alias("end"), F.col("grain").alias("granularity"))
    good = F.struct("phrase", "normalized", "status", F.transform("points", point).alias("points"), "global_count", meta.alias("meta"))
    bad = F.struct(F.struct(F.col("error").alias("code")).alias("error"))
    failed = F.col("error").isNotNull()
    return answered.withColumn("http", F.when(failed, 400).otherwise(200)).withColumn("body", F.when(failed, F.to_json(bad)).otherwise(F.to_json(good)))


def checked_feedback(rows: DataFrame) -> DataFrame:
    """``rows`` (phrases: array<string>, granularity, start_date, smoothing, user_agent) as they are kept, with ``error``: null,
    or the code of the first fault."""
    kept = F.filter(F.transform("phrases", lambda p: F.trim(p)), lambda p: F.coalesce(p, F.lit("")) != "")
    grain, day = dates.parsed_granularity(F.col("granularity")), dates.parsed_date(F.col("start_date"))
    smoothing = F.col("smoothing")
    error = (
        F.when(F.size("phrases") < 2, "INVALID_PHRASES").when(F.size("phrases") > MAX_PHRASES, "TOO_MANY_PHRASES")
        .when(F.exists("phrases", lambda p: F.octet_length(p) > MAX_PHRASE_BYTES), "PHRASE_TOO_LONG").when(grain.isNull(), "INVALID_GRANULARITY")
        .when(day.isNull(), "INVALID_DATE_FORMAT").when(~F.coalesce(smoothing.between(0, MAX_SMOOTHING), F.lit(False)), "INVALID_SMOOTHING")
    )
    judged = rows.withColumn("phrases", F.coalesce(kept, F.array().cast("array<string>"))).withColumn("error", error)
    return judged.withColumns({"granularity": grain, "start_date": day, "user_agent": _cut(F.coalesce("user_agent", F.lit("")), MAX_AGENT_BYTES)})


def _cut(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` bytes."""
    ends = lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most
    fits = F.filter(F.sequence(F.lit(0), F.least(F.char_length(text), F.lit(most))), ends)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.array_max(fits)))
