"""Shared pieces of the training-data operators.

Words are maximal runs of anything but the six ASCII white-space characters. ``bytes.split()``
cuts UTF-8 text at exactly those characters, so Python and SQL agree on words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counting import spread

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small ``documents`` is spread over the cores where it has fewer splits than those."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves a session of one machine; on a cluster it would be another one on each executor."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="driftgram-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a copy in :func:`shared_folder`. Spark removes it with the frame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Like :func:`checkpointed`, but as a compressed table; its path is for :func:`removed`."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group but for ``size``, its number of rows; null keys meet.

    ``groups`` has a row a key and is read more than once. Groups of a thousandth of all rows, of which
    there are 1,000 at most, are broadcast; the others meet their rows in a shuffle, no larger than that.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * 1000 >= total
    out = []
    for part, others in ((groups.where(large), None), (groups.where(~large), groups.where(large))):
        mine = rows if others is None else _of_groups(rows, F.broadcast(others.select(key)), key, "left_anti")
        out.append(_of_groups(mine, part.drop(size) if others is not None else F.broadcast(part.drop(size)), key, "inner"))
    return out[0].unionByName(out[1])


def _of_groups(rows: DataFrame, groups: DataFrame, key: str, how: str) -> DataFrame:
    groups = groups.withColumnRenamed(key, "group_key")
    return rows.join(groups, F.col(key).eqNullSafe(F.col("group_key")), how).drop("group_key")


def fold_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart: equal rows share a key and, with it, every result."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("key_id"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("key_text")]


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an array<int>, in time that grows a little faster than its
    length: within chunks of 256, then over the chunks."""
    empty = F.array().cast("array<int>")

    def part(at: Column) -> Column:  # slice() would walk the whole array each time
        return F.transform(F.sequence(at, F.least(at + 255, F.size(numbers) - 1)), lambda i: F.get(numbers, i))

    def within(chunk: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), empty.alias("out"))
        step = lambda a, x: let(a["sum"] + x, lambda now: F.struct(now.alias("sum"), F.array_append(a["out"], now).alias("out")))
        return F.aggregate(chunk, zero, step)

    def joined(chunks: Column) -> Column:
        before = within(F.transform(chunks, lambda c: c["sum"]))["out"]
        return let(before, lambda b: F.flatten(F.transform(chunks, lambda c, i: F.transform(c["out"], lambda x: x + F.when(i == 0, 0).otherwise(F.get(b, i - 1))))))

    starts = F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(256))
    return F.when(F.size(numbers) == 0, empty).otherwise(let(F.transform(starts, lambda at: within(part(at))), joined))


def located(text: Column, pattern: str | Column) -> Column:
    """struct<found: array<struct<start,end,text>>, gaps: array<string>>: leftmost non-overlapping
    matches, in code points, and what lies before each and after the last (null without a match).

    ``split`` yields the gaps, so running sums of lengths give the positions.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(p: Column) -> Column:
        lengths = F.transform(p["matches"], lambda m, i: F.char_length(m) + F.char_length(F.get(p["gaps"], i)))
        put = lambda ends: F.transform(p["matches"], lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("text")))
        return F.struct(let(let(lengths, running_sums), put).alias("found"), p["gaps"].alias("gaps"))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.rlike(text, pattern), let(both, placed))


def spans(text: Column, pattern: str | Column) -> Column:
    """The matches of :func:`located`; an empty array without one."""
    return F.coalesce(located(text, pattern)["found"], F.array().cast("array<struct<start:int,end:int,text:string>>"))


def count_kind(spans_column: str, kind: str) -> Column:
    return F.size(F.filter(spans_column, lambda s: s["kind"] == kind))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that Python never holds many texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()
