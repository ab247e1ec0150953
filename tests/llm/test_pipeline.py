"""The pipeline on the smallest tables, and every registered query's SQL."""

import glob
import os

import duckdb
import edge
import pytest

import corpus_pipeline
from driftgram import corpora
from driftgram.llm import common, decontamination, mixing, quality_classifier, registry, simhash_dedup
from driftgram.operators import counting


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append((docs, spark.read.parquet(f"{tmp_path}/{k}")))
        docs = seen[-1][1]
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [[sorted(r["doc_id"] for r in d.collect()) for d in pair] for pair in seen]
    rejected = {r["doc_id"] for r in quality_classifier.score(seen[0][0], labels).where("score < 0.3").collect()}
    assert ids[0][1] == [i for i in ids[0][0] if i not in rejected] and rejected
    assert ids[1][1] == sorted({r["component_id"] for r in simhash_dedup.near_duplicates(seen[1][0]).collect()})
    leaks = {r["doc_id"] for r in decontamination.search(seen[2][0], items).collect()}
    assert ids[2][1] == [i for i in ids[2][0] if i not in leaks]
    assert ids[3][1] == sorted(r["doc_id"] for r in mixing.copies(seen[3][0]).collect() for _ in range(r["copies"]))
    assert ids[4][1] == ids[4][0]
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, seen[4][1].collect()))
    left = glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/pipeline-*")
    assert len(left) == 1 and "sharding" in left[0]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, sf_dir, stage):
    rows = {}
    for docs in (edge.documents(spark), edge.clashing(spark), edge.empty(spark)):
        out = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir).cache()
        assert stage == 4 or out.columns == docs.columns
        rows[len(docs.columns), docs.isEmpty()] = edge.sorted_rows(out, "doc_id", *(["text", "source"] if stage < 4 else ["shard", "slot"]))
        out.unpersist()
    plain, clashing, empty = rows.values()
    assert plain == clashing and not empty and len(plain) <= 2 * len(edge.rows())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, expected = registry.QUERIES[name](spark, sf_dir).toPandas(), connection.sql(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and [str(got[c].dtype) for c in columns] == [str(expected[c].dtype) for c in columns]
    rows = [sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False)) for df in (got, expected)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_return_all_rows(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = registry.QUERIES[name](spark, sf_dir)
    assert "doc_id" in out.columns and (out.count() == n or name.startswith("op3_"))


def test_large_tables_are_not_dealt_anew(spark, tmp_path, monkeypatch):
    """A table with splits of its own is read as it lies, however large: a shuffle would copy every text each time it is read."""
    rows = [(i, edge.prose(i, 200), "en", "web", 1) for i in range(400)]
    spark.createDataFrame(rows, edge.SCHEMA).repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(counting, "PIECE_BYTES", 1 << 10)
    docs = common.table(spark, str(tmp_path), "documents")
    assert docs.rdd.getNumPartitions() >= 4 and "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    assert docs.count() == len(rows)
    assert corpora.documents(spark, str(tmp_path)).rdd.getNumPartitions() > 16  # n-grams are many times their texts
