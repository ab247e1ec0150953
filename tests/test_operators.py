import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftgram.operators import counting, pruning, ranking, series
from driftgram.operators.pruning import Pruning, Threshold
from driftgram.sources.config import BuildConfig
from driftgram.streaming import incremental

D = dt.date


def texts(spark, *rows):
    return spark.createDataFrame([(D.fromisoformat(b), t.split()) for b, t in rows], "bucket date, tokens array<string>")


def as_dict(df, value="count"):
    return {tuple(str(r[c]) if c == "bucket" else r[c] for c in df.columns if c != value): r[value] for r in df.collect()}


def test_counts_are_occurrences_and_totals_are_windows(spark):
    t = texts(spark, ("2024-01-01", "a a a"), ("2024-01-01", "b"), ("2024-01-02", "a b"))
    assert as_dict(counting.ngram_counts(t, 2)) == {("2024-01-01", 1, "a"): 3, ("2024-01-01", 2, "a a"): 2, ("2024-01-01", 1, "b"): 1, ("2024-01-02", 1, "a"): 1, ("2024-01-02", 1, "b"): 1, ("2024-01-02", 2, "a b"): 1}
    assert as_dict(counting.bucket_totals(t, 3), "total_count") == {("2024-01-01", 1): 4, ("2024-01-01", 2): 2, ("2024-01-01", 3): 1, ("2024-01-02", 1): 2, ("2024-01-02", 2): 1}


def test_totals_equal_sums_and_merge_equals_whole(spark):
    rows = [("2024-01-0%d" % (i % 5 + 1), " ".join("abcde"[(i * j) % 5] for j in range(i % 7))) for i in range(60)]
    t = texts(spark, *rows)
    counts = counting.ngram_counts(t, 3)
    sums = {(str(r["bucket"]), r["n"]): r["s"] for r in counts.groupBy("bucket", "n").agg(F.sum("count").alias("s")).collect()}
    assert sums == as_dict(counting.bucket_totals(t, 3), "total_count")
    halves = [counting.ngram_counts(texts(spark, *rows[k::2]), 3) for k in (0, 1)]
    assert as_dict(counting.merged(*halves)) == as_dict(counts)


def test_thresholds():
    p = Pruning()
    assert p.export_floor == 5 and Pruning({1: Threshold()}).export_floor == 2
    assert p.with_threshold(7, min_bucket=4).thresholds[7] == Threshold(0, 4, 1)
    q = p.with_environment({"PRUNE_MIN_2GRAM_GLOBAL": "500", "PRUNE_MIN_6GRAM_BUCKET": "9", "PRUNE_MIN_3GRAM_FLUSH": "x"})
    assert q.thresholds[2] == Threshold(500, 3, 2) and q.thresholds[6] == Threshold(0, 9, 1) and q.thresholds[3] == p.thresholds[3]


def test_pruning(spark):
    overall = spark.createDataFrame([(1, "a", 1), (2, "a b", 20), (2, "b c", 19), (6, "x", 10**9)], "n tinyint, ngram string, count long")
    vocabulary = pruning.vocabulary(overall, Pruning())
    assert {(r["n"], r["ngram"]) for r in vocabulary.collect()} == {(1, "a"), (2, "a b")}
    counts = spark.createDataFrame([(D(2024, 1, 1), 1, "new", 1), (D(2024, 1, 1), 2, "a b", 2), (D(2024, 1, 2), 2, "a b", 5), (D(2024, 1, 2), 2, "b c", 5), (D(2024, 1, 2), 6, "x", 99)], "bucket date, n tinyint, ngram string, count long")
    assert as_dict(pruning.filtered_counts(counts, vocabulary, Pruning())) == {("2024-01-01", 1, "new"): 1, ("2024-01-02", 2, "a b"): 5}
    assert {r["ngram"] for r in pruning.exported_vocabulary(overall, vocabulary, Pruning()).collect()} == {"a b"}


@pytest.fixture
def stored(spark):
    counts = spark.createDataFrame([(D(2024, 1, 1), 1, "a", 2), (D(2024, 1, 20), 1, "a", 1), (D(2024, 3, 5), 1, "a", 3), (D(2024, 1, 1), 1, "b", 1)], "bucket date, n tinyint, ngram string, count long")
    totals = spark.createDataFrame([(D(2024, 1, 1), 1, 10), (D(2024, 1, 20), 1, 5), (D(2024, 1, 25), 1, 100), (D(2024, 3, 5), 1, 6)], "bucket date, n tinyint, total_count long")
    return counts, totals


def test_series(spark, stored):
    day = series.stored_series(*stored, 1, ["a"], D(2024, 1, 2), D(2024, 12, 31)).collect()
    assert [tuple(r) for r in day] == [(D(2024, 1, 20), "a", 1, 5), (D(2024, 3, 5), "a", 3, 6)]
    month = lambda **k: [tuple(r) for r in series.rebucketed_series(*stored, 1, ["a", "b"], D(2024, 1, 1), D(2024, 12, 31), "month", **k).collect()]
    assert month() == [(D(2024, 1, 1), "a", 3, 15), (D(2024, 1, 1), "b", 1, 10), (D(2024, 3, 1), "a", 3, 6)]
    assert month(denominator="full") == [(D(2024, 1, 1), "a", 3, 115), (D(2024, 1, 1), "b", 1, 115), (D(2024, 3, 1), "a", 3, 6)]
    for n, grams in ((0, ["a"]), (6, ["a"]), (1, [])):
        with pytest.raises(ValueError):
            series.stored_series(*stored, n, grams, D(2024, 1, 1), D(2024, 1, 2))


def test_repeated_runs_do_not_multiply(stored):
    counts, totals = stored
    twice = series.stored_series(counts.union(counts), totals.union(totals), 1, ["b"], D(2024, 1, 1), D(2024, 1, 1)).collect()
    assert [tuple(r) for r in twice] == [(D(2024, 1, 1), "b", 2, 20)]


def test_zero_filling(spark, stored):
    points = series.points(series.rebucketed_series(*stored, 1, ["a"], D(2023, 12, 1), D(2024, 12, 31), "month"))
    dense = series.zero_filled(points, D(2023, 12, 9), D(2024, 12, 31), "month").orderBy("t").collect()
    assert [(r["t"].month, r["v"], r["count"]) for r in dense] == [(12, 0.0, 0), (1, 0.2, 3), (2, 0.0, 0), (3, 0.5, 3)]
    assert series.zero_filled(points.where("count < 0"), D(2024, 1, 1), D(2024, 12, 31), "month").count() == 0


@pytest.mark.parametrize("width", range(8))
def test_smoothing_matches_slices(spark, width):
    values = [float((i * 7) % 5) for i in range(11)]
    rows = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(days=i), v, 1, 2) for i, v in enumerate(values)], "ngram string, t date, v double, count long, total long")
    got = [r["v"] for r in series.smoothed(rows, width).orderBy("t").collect()]
    slices = [values[max(0, i - width // 2) : min(11, i + -(-width // 2))] if width > 1 else [v] for i, v in enumerate(values)]
    assert got == pytest.approx([sum(s) / len(s) for s in slices])


def test_popular_phrases(spark):
    assert ranking.strata_sizes(137) == {1: 60, 2: 30, 3: 20, 4: 15, 5: 12}
    counts = spark.createDataFrame([(D(2024, 1, 5), 1, g, c) for g, c in zip("abcd", (1, 3, 3, 9), strict=True)] + [(D(2023, 1, 1), 1, "old", 99), (D(2024, 1, 5), 2, "a b", 4)], "bucket date, n tinyint, ngram string, count long")
    got = [tuple(r) for r in ranking.popular_phrases(counts, 7, D(2024, 1, 6), 30).collect()]
    assert got == [(9, 1, "d"), (3, 1, "b"), (3, 1, "c"), (4, 2, "a b")]


def test_lookups(spark):
    vocabulary = spark.createDataFrame([(2, "a b"), (1, "a")], "n tinyint, ngram string")
    asked = spark.createDataFrame([(0, 2, "zz"), (1, 1, "a"), (2, 2, "a b"), (3, 2, "zz")], "pos int, n tinyint, ngram string")
    assert [r["found"] for r in ranking.vocabulary_check(asked, vocabulary).collect()] == [False, True, True, False]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, None)], "key string, v int, x string")
    assert {(r["key"], r["x"]) for r in ranking.latest(rows, ["key"], "v").collect()} == {("k", "new"), ("m", None)}


def test_replay_admits_in_order(spark):
    rows = [(1, D(2024, 1, 1), ["a", "b"]), (2, D(2024, 2, 1), ["a", "b"]), (3, D(2024, 3, 1), ["a", "b"])]
    t = spark.createDataFrame(rows, "batch int, bucket date, tokens array<string>")
    config = BuildConfig(max_n=2, pruning=Pruning({1: Threshold(0, 1), 2: Threshold(2, 1)}))
    got = {(r["batch"], r["ngram"]) for r in incremental.replay(t, config).collect()}
    assert got == {(b, g) for b in (1, 2, 3) for g in "ab"} | {(2, "a b"), (3, "a b")}


def test_admissions_from_totals_side_by_side(spark):
    rows = [(1, "old", 2, 1), (1, "new", 1, 0), (2, "a b", 20, 20), (2, "b c", 20, 19), (2, "c d", 19, 19), (6, "x", 99, 99)]
    new, union = ranking.admissions(spark.createDataFrame(rows, "n tinyint, ngram string, count long, early long"), Pruning())
    assert {r["ngram"] for r in new.collect()} == {"new", "b c"} and {r["ngram"] for r in union.collect()} == {"old", "new", "a b", "b c"}


def test_percentiles_over_ranges(spark):
    """As percentile_disc has them; the values lie in several pieces, of which each is put in order by itself."""
    for n in (1, 2, 7, 100, 1000):
        values = spark.createDataFrame([(float((i * 7919) % n // 3),) for i in range(n)] + [(None,)], "x double")
        values.createOrReplaceTempView("percentile_values")
        pieces = ranking.ranges(values, "x", 5).localCheckpoint()
        got = ranking.discrete_percentiles(pieces, {"a": "0.50", "b": "0.999", "c": "0.01"})
        assert tuple(got.first()) == tuple(spark.sql("SELECT " + ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)" for p in (0.5, 0.999, 0.01)) + " FROM percentile_values").first())
        assert n < 100 or pieces.select("piece").distinct().count() == 5
