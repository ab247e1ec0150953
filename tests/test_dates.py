import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftgram.functions import dates

D = dt.date


@pytest.mark.parametrize(("ms", "days"), [(1_705_318_200_000, (D(2024, 1, 15), D(2024, 1, 1), D(2024, 1, 1))), (0, (D(1970, 1, 1),) * 3), (1_160_352_000_000, (D(2006, 10, 9), D(2006, 10, 1), D(2006, 1, 1)))])
def test_stored_buckets(spark, ms, days):
    ts = F.timestamp_millis(F.lit(ms))
    assert tuple(spark.range(1).select(*(dates.stored_bucket(ts, g).alias(g) for g in dates.STORED)).first()) == days


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_buckets_are_utc_in_any_session_zone(spark, zone):
    moments = [(0, D(1970, 1, 1)), (1_705_284_000_000, D(2024, 1, 15)), (1_705_363_199_999, D(2024, 1, 15)), (1_710_054_000_123, D(2024, 3, 10)), (1_699_164_000_000, D(2023, 11, 5)), (-1, D(1969, 12, 31))]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(ms,) for ms, _ in moments], "ms long").select("ms", F.timestamp_millis("ms").alias("ts"))
        plain = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000.0)"
        rows = rows.withColumn("ntz", F.expr(plain))
        got = rows.select(
            "ms", dates.stored_bucket(F.col("ts")).alias("a"), dates.bucket_of_millis(dates.utc_millis(F.col("ntz"), True)).alias("b"), dates.utc_millis(F.col("ntz"), True).alias("m"), dates.ms_to_date(F.col("ms")).alias("c")
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r["a"], r["b"], r["c"], r["m"]) for r in got] == [(day, day, day, ms) for ms, day in moments]
    assert spark.range(1).select(dates.bucket_of_millis(F.lit(2**62))).first()[0] is None


def test_weeks_begin_on_sunday(spark):
    days = [D(2024, 3, 1), D(2024, 3, 3), D(2023, 12, 31), D(2024, 1, 6)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(dates.query_bucket(F.col("d"), "week").alias("w")).collect()
    assert [r["w"] for r in rows] == [D(2024, 2, 25), D(2024, 3, 3), D(2023, 12, 31), D(2023, 12, 31)]
    assert [dates.align(d, "week") for d in days] == [r["w"] for r in rows]


def test_months(spark):
    assert [r[0] for r in dates.month_range(spark, "2023-11", "2024-02").collect()] == [D(2023, 11, 1), D(2023, 12, 1), D(2024, 1, 1), D(2024, 2, 1)]
    assert dates.month_range(spark, "2024-02", "2024-01").count() == 0
    for bad in ("2024", "2024-13", "2024-00", "abc-01", ""):
        with pytest.raises(ValueError):
            dates.parse_month(bad)
    assert dates.month_end(D(2024, 2, 5)) == D(2024, 2, 29) and dates.month_end(D(2023, 12, 31)) == D(2023, 12, 31)


def test_parsing():
    assert dates.parse_date("2024-02-29") == D(2024, 2, 29)
    assert [dates.parse_date(x) for x in ("2023-02-29", "2024/01/01", "2024-1-1", "", "x")] == [None] * 5
    assert [dates.parse_granularity(x) for x in ("day", "weekly", "Month", "YEAR", "invalid")] == ["day", "week", "month", "year", None]
