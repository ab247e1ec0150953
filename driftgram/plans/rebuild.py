"""A full rebuild: comments to the four published tables.

Each source file is read once: it is tokenized and counted, its unpruned counts are written to the
store's partial folder, and a note of what was seen beside them is put there last, under a name made of the
file's path, length and time of change. A build that was broken off goes on with the files that have
no such note, and counts a file again if it isn't the one that was counted.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKENIZER_VERSION, with_tokens
from ..operators import counting, pruning
from ..sources import items
from ..sources.commits import Files
from ..sources.config import BuildConfig
from ..sources.store import Store

_PARTIAL = "bucket date, n tinyint, ngram string, count bigint"


def tables(comments: DataFrame, config: BuildConfig, admitted_at: dt.datetime | None = None) -> dict[str, DataFrame]:
    """The tables from (bucket, text). Denominators are never pruned."""
    return tables_of_counts(counting.ngram_counts(with_tokens(comments).select("bucket", "tokens"), config.max_n), config, admitted_at)


def tables_of_counts(
    parts: DataFrame, config: BuildConfig, admitted_at: dt.datetime | None = None, stored: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows
) -> dict[str, DataFrame]:
    """The tables from unpruned (bucket, n, ngram, count), of which a key may have several rows.

    Corpus totals are kept whole, for runs that continue from them; the export floor holds when
    they are shown. ``stored`` may write what several tables are made of and read it again.
    """
    overall = stored("overall", counting.global_counts(parts))
    admitted = pruning.vocabulary(overall, config.pruning)
    at = admitted_at or dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
    return {
        "ngram_counts": pruning.filtered_counts(counting.merged(parts), admitted, config.pruning),
        "bucket_totals": counting.totals_of_counts(parts),
        "global_counts": overall,
        "ngram_vocabulary": pruning.exported_vocabulary(overall, admitted, config.pruning).withColumn("admitted_at", F.lit(at)),
    }


def _identity(files: Files, path: str) -> str:
    """A name for a source file as it is now; the files of a folder count together."""
    at, fs = files.at(path)
    status = [fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else sorted(fs.listStatus(at), key=lambda f: f.getPath().getName())
    each = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in status]
    return f"{path.rsplit('/', 1)[-1].removesuffix('.parquet')}-{sha256(repr((path, each)).encode()).hexdigest()[:24]}"


class Partials:
    """A build's counted source files: a folder of counts a file, and the note that makes it count."""

    def __init__(self, store: Store, build: str):
        self.files, self.folder = store.files, f"partial/{build}"

    def notes(self) -> dict[str, dict]:
        names = [n.removesuffix(".json") for n in self.files.below(self.folder) if n.endswith(".json")]
        return {n: json.loads(self.files.read(self.folder, f"{n}.json")) for n in names}

    def counted(self, part: str, comments: DataFrame, max_n: int) -> None:
        """Counts a file's comments, observing their number and newest time in the same pass, and notes it.

        Of two builds that count the same file at once the first note holds, and each names its own folder.
        """
        seen = Observation()
        rows = comments.observe(seen, F.max("ts_ms").alias("newest"), F.count(F.lit(1)).alias("comments")).select("bucket", "text")
        folder = f"{part}-{uuid.uuid4().hex}"
        counting.ngram_counts(with_tokens(rows).select("bucket", "tokens"), max_n).write.option("compression", "zstd").parquet(self.path(folder))
        figures = seen.get
        self.files.create(json.dumps({"folder": folder, "newest": figures.get("newest"), "comments": figures.get("comments") or 0}), self.folder, f"{part}.json")

    def path(self, folder: str) -> str:
        return self.files.name(self.folder, folder)

    def drop(self) -> None:
        self.files.remove(self.folder)


def rebuild(spark: SparkSession, source: str, store: Store, config: BuildConfig, files_at_once: int = 4) -> str:
    """Reads the months, builds all tables and publishes them; returns the new version.

    ``files_at_once`` files are counted at the same time, so that small months don't leave the cluster idle.
    """
    began, base = time.monotonic(), store.state()["seq"]
    end = config.end or f"{dt.datetime.now(dt.UTC):%Y-%m}"
    paths = items.existing_months(spark, source, config.start, end)
    if not paths:
        raise FileNotFoundError(f"no month from {config.start} to {end} below {source}")
    whole = Files(spark, source)
    parts = {_identity(whole, path.removeprefix(f"{source.rstrip('/')}/")): path for path in paths}
    build = sha256(f"{TOKENIZER_VERSION}|{source}|{config.max_n}|{config.bucket_granularity}".encode()).hexdigest()[:16]
    partials = Partials(store, build)
    done = partials.notes()
    left = items.not_done(spark.createDataFrame([(p,) for p in parts], "path string"), spark.createDataFrame([(p,) for p in done], "path string"))

    def count(part: str) -> None:
        partials.counted(part, items.comments(items.read_items(spark, [parts[part]]), 0, config.bucket_granularity), config.max_n)

    with ThreadPoolExecutor(files_at_once) as pool:
        list(pool.map(count, sorted(r["path"] for r in left.collect())))
    notes = partials.notes()
    counts = spark.read.schema(_PARTIAL).parquet(*(partials.path(notes[p]["folder"]) for p in parts))

    def stored(table: str, rows: DataFrame) -> DataFrame:
        path = partials.path(f"{table}-{uuid.uuid4().hex}")
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    newest = max((notes[p]["newest"] or 0 for p in parts), default=0)
    log = {"command": "rebuild", "last_ingested_ts": newest, "comments_processed": sum(notes[p]["comments"] for p in parts), "start_month": config.start, "end_month": end}
    version = store.publish(tables_of_counts(counts, config, stored=stored), log | {"duration_ms": int((time.monotonic() - began) * 1000)}, config.pruning.export_floor, base)
    partials.drop()
    return version
