"""N-grams counted by windows, against plain counting in Python."""

import datetime as dt
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgram import engine_queries, queries  # noqa: F401
from driftgram.operators import counting, windows
from driftgram.operators.pruning import Pruning, Threshold

_DAYS = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]


def _texts(n: int, seed: int) -> list[tuple]:
    pick = random.Random(seed)
    return [(pick.choice(_DAYS), [pick.choice(("a", "b", "ab", "c++", "don't")) for _ in range(pick.choice((0, 1, 2, 3, 9, 40)))]) for _ in range(n)]


def _plain(texts: list[tuple], max_n: int) -> Counter:
    return Counter((day, n, " ".join(t[i : i + n])) for day, t in texts for n in range(1, max_n + 1) for i in range(len(t) - n + 1))


@pytest.mark.parametrize(("max_n", "gathered"), [(1, 1 << 19), (2, 7), (3, 100), (5, 1 << 19)])
def test_a_partition_counts_all(monkeypatch, max_n, gathered):
    """Rows gathered in small portions, and texts of several slices, come to the same counts."""
    monkeypatch.setattr(windows, "_GATHERED", gathered)
    monkeypatch.setattr(windows, "_TEXTS", 16)
    monkeypatch.setattr(windows, "_ROWS", 50)
    texts = _texts(200, max_n)
    batches = [pa.record_batch([pa.array([d for d, _ in part], pa.date32()), pa.array([t for _, t in part], pa.list_(pa.string()))], names=["bucket", "tokens"]) for part in (texts[:90], texts[90:])]
    out = windows._count(max_n, ("bucket",), None)(windows._cut(max_n, ("bucket",))(batches))
    rows = [tuple(r.values()) for batch in out for r in batch.to_pylist()]
    got = {(day, n, g): c for day, n, g, c in rows}
    assert len(got) == len(rows) and got == _plain(texts, max_n)
    assert list(windows._count(max_n, (), None)(iter([]))) == []


def test_pruned_counts_are_those_of_the_join(spark):
    texts = _texts(300, 7)
    df = spark.createDataFrame(texts, "bucket date, tokens array<string>").repartition(5)
    thresholds = Pruning({1: Threshold(0, 2), 2: Threshold(60, 30), 3: Threshold(12, 5)})
    counts = _plain(texts, 4)
    overall = Counter()
    for (_, n, g), c in counts.items():
        overall[n, g] += c
    expected = {(d, n, g, c) for (d, n, g), c in counts.items() if n <= 3 and c >= {1: 2, 2: 30, 3: 5}[n] and (n == 1 or overall[n, g] >= {2: 60, 3: 12}[n])}
    assert len(expected) < len(counts) and {n for _, n, _, _ in expected} == {1, 2, 3}
    got = windows.window_counts(df, 4, "bucket", partitions=6, pruning=thresholds).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize(("name", "times"), [("counts_filtered", 4), ("ngram_orders_1_5", 8)])
def test_windows_are_shuffled_once(spark, sf_dir, name, times):
    """Besides the texts dealt out, one exchange, of a number of partitions that grows with the input and isn't put together again; no join."""
    texts = queries._documents(spark, sf_dir)
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert f", {times * counting.pieces(texts)}), REPARTITION_BY_NUM" in plan


def test_partitions_grow_with_the_input(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(counting, "PIECE_BYTES", 1 << 12)
    few = spark.range(5).select(F.col("id"), F.lit("a").alias("text"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert counting.pieces(docs) > spark.sparkContext.defaultParallelism == counting.pieces(few)


@pytest.mark.parametrize("name", ["tok_pages_tags_entities", "tok_nfkc", "tok_entities", "tok_quotes"])
def test_page_tokens_are_summed_in_pieces(spark, sf_dir, monkeypatch, name):
    """Tokens are dealt out by page, in pieces whose number grows with the input; sums are not shuffled, so Spark puts none together."""
    monkeypatch.setattr(counting, "PIECE_BYTES", 1 << 13)
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.split("hashpartitioning(")[1].split("\n")[0].count("REPARTITION_BY_NUM") == 1
    assert int(plan.split("hashpartitioning(")[1].split("), ")[0].split(", ")[1].rstrip(")")) > spark.sparkContext.defaultParallelism


def test_page_tokens_of_equal_keys_meet(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (None, ["a"]), (None, ["a"]), (2, []), (3, None)], "page_id long, tokens array<string>")
    assert {tuple(r) for r in counting.token_counts(rows.repartition(4), "page_id").collect()} == {(1, "a", 3), (1, "b", 1), (None, "a", 2)}


def _tokens(spark, sf_dir) -> list[pa.RecordBatch]:
    texts = queries._documents(spark, sf_dir).select("tokens").toArrow()
    return texts.set_column(0, "tokens", texts.column("tokens").cast(pa.list_(pa.string()))).to_batches()


def test_blocks_are_a_fraction_of_the_windows_text(spark, sf_dir):
    """What is shuffled is less than twice the tokens' own text, though each token is in five windows."""
    batches = _tokens(spark, sf_dir)
    text = sum(len(t) + 1 for batch in batches for tokens in batch.column("tokens").to_pylist() for t in tokens)
    assert sum(batch.nbytes for batch in windows._cut(5, ())(iter(batches))) < 2 * text


def test_texts_that_are_counted_by_windows_are_not_dealt_by_range(spark, sf_dir):
    plan = queries.QUERIES["ngram_orders_1_5"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan


def test_ngrams_lie_behind_those_they_continue(spark, sf_dir):
    """In order of their tokens, all orders together, so that a file's compression has what an n-gram begins with just before it."""
    out = [r["ngram"].split(" ") for batch in windows._count(5, (), None)(windows._cut(5, ())(iter(_tokens(spark, sf_dir)))) for r in batch.to_pylist()]
    assert out == sorted(out) and {len(g) for g in out} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("max_n", [1, 2, 5])
@pytest.mark.parametrize("keep", [(), ("bucket",)])
def test_blocks_of_some_tokens_and_partitions_at_a_time(monkeypatch, max_n, keep):
    """Windows that begin alike go to one key, whichever task, texts and partitions they are made with; counts stay those of all."""
    monkeypatch.setattr(windows, "_TEXTS", 7)
    monkeypatch.setattr(windows, "_TOKENS", 60)
    monkeypatch.setattr(windows, "_WINDOWS", 20)
    texts = [(day, ["é", *t] if i % 5 == 0 else t) for i, (day, t) in enumerate(_texts(120, 3))] + [(None, None)]
    batches = [pa.record_batch([pa.array([d for d, _ in part], pa.date32()), pa.array([t for _, t in part], pa.list_(pa.string()))], names=["bucket", "tokens"]) for part in (texts[:50], texts[50:])]
    by_key = {}
    for batch in (b for part in batches for b in windows._cut(max_n, keep, 100 + 10 * windows.np.arange(9))(iter([part]))):
        for i in range(batch.num_rows):
            by_key.setdefault(batch.column("key")[i].as_py(), []).append(batch.slice(i, 1))
    assert len(by_key) > 2 and set(by_key) <= set(range(100, 190, 10))
    rows = [tuple(r.values()) for blocks in by_key.values() for batch in windows._count(max_n, keep, None)(iter(blocks)) for r in batch.to_pylist()]
    expected = _plain([(day if keep else None, t or []) for day, t in texts], max_n)
    assert len(rows) == len(expected) and {r[:-1] if keep else (None, *r[:-1]): r[-1] for r in rows} == expected


def test_partitions_have_keys_of_their_own(spark):
    keys = windows._keys(spark, 50)
    dealt = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(50, "key").select(F.spark_partition_id()).distinct().count()
    assert len(set(keys)) == len(keys) == dealt >= 48
