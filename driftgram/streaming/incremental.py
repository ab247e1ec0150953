"""Incremental processing: a fold over batches, from files or from a stream.

Each batch takes comments later than the watermark, adds its counts to the corpus totals, admits
n-grams by the new totals, and stores counts of what is admitted now or was before. Admission
thus depends on order: what was counted before an n-gram's admission isn't stored for it.
Totals are kept whole (no export floor), so slowly growing n-grams are admitted in time.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dates, ngrams
from ..functions.text import with_tokens
from ..operators import counting, pruning, ranking
from ..sources import items
from ..sources.commits import CommitLog, Files
from ..sources.config import BuildConfig
from ..sources.store import BatchConflict, CommitConflict, Store, bucket


def process_batch(store: Store, rows: DataFrame, batch_id: str, config: BuildConfig, command: str = "process", log: dict | None = None, since: int | None = None) -> bool:
    """Adds (bucket, text, ts_ms) as one batch. Repeating a batch changes nothing, for its rows aren't later
    than the watermark; new rows under an id that is in the log are an error.

    With ``since`` rows later than that count, whatever the watermark: for sources that give each row to one
    batch and repeat a batch whole and under its id, as a stream of files does. One that is in the log is then done.

    Of the corpus totals and the vocabulary only the hash partitions that the batch's n-grams fall into are read,
    and the batch adds its own counts to them. If another writer commits meanwhile, what depends on its
    state is made anew; the batch's counts are not.
    """
    store.check_version()
    began, state = time.monotonic(), store.state()
    if since is not None and store.has_batch(batch_id, state):
        return False
    held = [items.later(rows, state["watermark"] if since is None else since).persist()]
    try:
        first, newest, number = held[0].agg(F.min("ts_ms"), F.max("ts_ms"), F.count("*")).first()
        if not number:
            return False
        if store.has_batch(batch_id, state):
            raise BatchConflict(f"batch {batch_id!r} is in the log, and {number} new rows came under its id")
        texts = with_tokens(held[0]).select("bucket", "tokens").persist()
        counts = counting.ngram_counts(texts, config.max_n).persist()
        own = counting.global_counts(counts).persist()
        held += [texts, counts, own]
        while True:
            made, entry, shared = _admitted(store, state, counts, own, config)
            held.append(shared)
            entry |= {"command": command, "first_ingested_ts": first, "last_ingested_ts": newest, "comments_processed": number}
            entry |= {"duration_ms": int((time.monotonic() - began) * 1000), **(log or {})}
            made["bucket_totals"] = counting.bucket_totals(texts, config.max_n)
            try:
                done = store.append(made, batch_id, entry, base=state["seq"])
                break
            except CommitConflict:
                state = store.state()
        while store.merge():
            pass
        return done
    finally:
        for frame in held:
            frame.unpersist()


def _admitted(store: Store, state: dict, counts: DataFrame, own: DataFrame, config: BuildConfig) -> tuple[dict[str, DataFrame], dict, DataFrame]:
    """The batch's rows of the tables that depend on what was counted before, the log's figures of them, and the frame they share."""
    tables = ("global_counts", "ngram_vocabulary")
    # only n-grams of this batch can change their total or be newly admitted: at most so many numbers as there are partitions
    places = own.select(*(bucket(F.col("n"), F.col("ngram"), state["buckets"][t]).alias(t) for t in tables)).distinct()
    touched = places.agg(*(F.collect_set(t).alias(t) for t in tables)).first()
    known = {t: F.col("h").isin(sorted(touched[t])) for t in tables}
    earlier = store.read("global_counts", state).where(known["global_counts"]).select("n", "ngram", F.col("count").alias("earlier"))
    overall = own.join(earlier, ["n", "ngram"], "left").select("n", "ngram", (F.col("count") + F.coalesce("earlier", F.lit(0))).alias("count")).persist()
    before = store.read("ngram_vocabulary", state).where(known["ngram_vocabulary"])
    admitted = pruning.vocabulary(overall, config.pruning)
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    made = {
        "ngram_counts": pruning.filtered_counts(counts, ranking.all_admitted(admitted, before), config.pruning),
        "global_counts": own,
        "ngram_vocabulary": admitted.withColumn("admitted_at", F.lit(now)),
    }
    tallied = {"vocabulary_inserted": [ranking.new_admissions(admitted, before)], "state_rows": [store.rows(t, state).where(known[t]) for t in tables]}
    each = [frame.select(F.lit(name).alias("name")) for name, frames in tallied.items() for frame in frames]
    found = {r["name"]: r["count"] for r in reduce(DataFrame.union, each).groupBy("name").count().collect()}
    return made, {name: found.get(name, 0) for name in tallied}, overall


def process_months(spark: SparkSession, source: str, store: Store, config: BuildConfig) -> list[str]:
    """Adds each existing month in order as a batch; returns the months that had new comments."""
    end = config.end or f"{dt.datetime.now(dt.UTC):%Y-%m}"
    done = []
    for path in items.existing_months(spark, source, config.start, end):
        month = path.rsplit("/", 1)[-1].removesuffix(".parquet")
        rows = items.comments(items.read_items(spark, [path]), 0, config.bucket_granularity)
        if process_batch(store, rows, f"{month}-{store.watermark()}", config, log={"start_month": month, "end_month": month}):
            done.append(month)
    return done


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream, which its checkpoint folder keeps: another folder is another stream."""
    return _noted(spark, f"{checkpoint.rstrip('/')}/driftgram-stream", uuid.uuid4().hex)


def stream_since(spark: SparkSession, checkpoint: str, store: Store) -> int:
    """The store's watermark when the stream was new: what lies before it came by another way."""
    return int(_noted(spark, f"{checkpoint.rstrip('/')}/driftgram-since", str(store.watermark())))


def _noted(spark: SparkSession, name: str, text: str) -> str:
    """The text of a small file, which is written where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        stream = fs.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stream(spark: SparkSession, source: str, schema: str, store: Store, config: BuildConfig, checkpoint: str, files_per_trigger: int = 16, available_now: bool = True) -> StreamingQuery:
    """Follows a folder of item files; each micro-batch is one idempotent batch of the fold.

    A month may lie in several files that come in different micro-batches, so rows are held against the watermark
    that was there before the stream, not against that of its own batches.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    rows = items.comments(raw.select(*items.USED), 0, config.bucket_granularity)
    own, since = stream_id(spark, checkpoint), stream_since(spark, checkpoint, store)
    writer = rows.writeStream.foreachBatch(lambda batch, number: process_batch(store, batch, f"stream-{own}-{number}", config, "stream", since=since) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(rows: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streaming token totals in daily tumbling windows, with a watermark: (day, comments, tokens).

    ``rows`` has ``ts`` (timestamp) and ``text``; later rows than the watermark are dropped.
    """
    counted = with_tokens(rows.withWatermark("ts", lateness))
    days = counted.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("comments"), F.sum(F.size("tokens")).alias("tokens"))
    return days.select(dates.stored_bucket(F.col("window.start")).alias("day"), "comments", "tokens")


def closed_windows(rows: DataFrame, path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Writes each day of :func:`windowed_counts` to files below ``path``, once, when the watermark has passed it.

    The state store holds the days that are still open; what comes for a closed one is in :class:`LateRows`.
    """
    writer = windowed_counts(rows, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


class LateRows:
    """A side output of rows that came when :func:`closed_windows` had closed their day, counted by day.

    It follows the same files, as many a trigger, and so has the same watermark: the newest time of the
    triggers before the last one, less the lateness. Each trigger's counts and times are one commit, put if
    absent, so a trigger that is repeated changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, lateness_ms: int):
        self.spark, self.files, self.lateness_ms = spark, Files(spark, root), lateness_ms
        self.commits = CommitLog(self.files)

    def take(self, batch: DataFrame, number: int) -> None:
        before = self.commits.latest() or {"seq": 0, "newest": [], "folders": []}
        if number < before["seq"]:
            return
        day = dates.stored_bucket(F.col("ts"))
        late_at = max(before["newest"][:-1], default=None)  # the last trigger's times close days only at the end of this one
        folder, ms = uuid.uuid4().hex, dates.utc_millis(F.col("ts"))
        held = batch.select("ts").persist()
        try:
            if late_at is not None:
                late = held.where(dates.bucket_end_ms(day) <= late_at - self.lateness_ms).groupBy(day.alias("day")).agg(F.count("*").alias("late"))
                late.write.parquet(self.files.name("late", folder))
            newest = held.agg(F.max(ms)).first()[0]
        finally:
            held.unpersist()
        times = before["newest"][-2:] + ([newest] if newest is not None else before["newest"][-1:])
        times = [max(times[: k + 1]) for k in range(len(times))]
        self.commits.put({"seq": number + 1, "newest": times, "folders": before["folders"] + ([folder] if late_at is not None else [])})

    def follow(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(lambda batch, number: self.take(batch, number)).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def by_day(self) -> DataFrame:
        """(day, late)"""
        folders = (self.commits.latest() or {"folders": []})["folders"]
        if not folders:
            return self.spark.createDataFrame([], "day date, late long")
        rows = self.spark.read.schema("day date, late long").parquet(*(self.files.name("late", f) for f in folders))
        return rows.groupBy("day").agg(F.sum("late").alias("late"))


def replay(texts: DataFrame, config: BuildConfig) -> DataFrame:
    """The counts that a run over all batches would store, from (batch, bucket, tokens) in one plan.

    An n-gram is admitted with the first batch in which its running total reaches the threshold;
    running totals are a window over (order, n-gram), whose partitions have a row a batch.
    """
    keys = ["batch", "bucket", "n", "ngram"]
    counts = ngrams.of_orders(texts, config.max_n, "batch", "bucket").groupBy(*keys).agg(F.count("*").alias("count"))
    so_far = Window.partitionBy("n", "ngram").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.where("n >= 2").groupBy("n", "ngram", "batch").agg(F.sum("count").alias("c")).withColumn("total", F.sum("c").over(so_far))
    admitted = totals.where(config.pruning.admits(F.col("total"), F.col("n"))).groupBy("n", "ngram").agg(F.min("batch").alias("since"))
    full = counts.where(config.pruning.fills_bucket(F.col("count"), F.col("n")))
    longer = full.where("n >= 2").join(admitted, ["n", "ngram"]).where("batch >= since").select(*keys, "count")
    return full.where("n = 1").unionByName(longer)
