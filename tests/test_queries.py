"""Every registered query of the phrase engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from driftgram import queries


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    expected = sql.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert [str(got[c].dtype) for c in columns] == [str(expected[c].dtype) for c in columns]
    rows = [sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False)) for df in (got, expected)]
    assert rows[0] == rows[1]
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["rows_by_order", "exported_vocabulary", "new_admissions", "admitted_union", "vocabulary_global_counts", "vocabulary_check", "status_classification"])
def test_totals_are_made_once(spark, sf_dir, name):
    """One scan of the texts and no join of totals with themselves; phrases that are asked for pick n-grams before these are counted."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    asked = name in ("vocabulary_global_counts", "vocabulary_check", "status_classification")
    assert plan.count("parquet") == 1
    assert "Join LeftSemi" in plan if asked else "Join" not in plan


def test_inputs_are_dealt_in_bounded_pieces(spark, sf_dir, monkeypatch):
    from driftgram import corpora
    from driftgram.operators import counting

    monkeypatch.setattr(counting, "PIECE_BYTES", 1 << 14)
    docs = corpora.documents(spark, sf_dir)
    assert docs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and docs.count() == corpora.table(spark, sf_dir, "documents").count()
