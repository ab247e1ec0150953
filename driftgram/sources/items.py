"""The item source: monthly Parquet files of comments and other items."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates

COMMENT = 2
USED = ("type", "deleted", "dead", "text", "time")
_ALLOWED = {
    "type": (T.ByteType, T.ShortType, T.IntegerType),
    "deleted": (T.ByteType, T.ShortType, T.IntegerType),
    "dead": (T.ByteType, T.ShortType, T.IntegerType),
    "text": (T.StringType,),
    "time": (T.TimestampType, T.TimestampNTZType),
}


def month_path(root: str, month: dt.date) -> str:
    return f"{root.rstrip('/')}/{month:%Y}/{month:%Y-%m}.parquet"


def month_paths(months: DataFrame, root: str) -> DataFrame:
    """(month, path) of (month date), by the files' naming."""
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.date_format("month", "yyyy/yyyy-MM"), F.lit(".parquet"))
    return months.select("month", path.alias("path"))


def existing_months(spark: SparkSession, root: str, start: str, end: str) -> list[str]:
    """Paths of the months from ``start`` to ``end`` that exist; missing months are left out."""
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for r in month_paths(dates.month_range(spark, start, end), root).orderBy("month").collect():
        at = path_class(r["path"])
        if at.getFileSystem(conf).exists(at):
            out.append(r["path"])
    return out


def check_schema(items: DataFrame) -> None:
    """Raises ValueError where a needed column is missing or of another type."""
    fields = {f.name: f.dataType for f in items.schema.fields}
    for name, kinds in _ALLOWED.items():
        if name not in fields:
            raise ValueError(f"column {name!r} is missing")
        if not isinstance(fields[name], kinds):
            raise ValueError(f"column {name!r} has type {fields[name].simpleString()}")


def read_items(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    items = spark.read.parquet(*paths).select(*USED)
    check_schema(items)
    return items


def comments(items: DataFrame, after_ms: int = 0, granularity: str = "daily") -> DataFrame:
    """(bucket, text, ts_ms) of live comments with text, later than the watermark (in milliseconds).

    A null flag drops the row, as it makes the condition null. Rows whose time has no date are dropped.
    """
    ms = dates.utc_millis(F.col("time"), dict(items.dtypes)["time"] == "timestamp_ntz")
    rows = live(items).select(dates.bucket_of_millis(ms, granularity).alias("bucket"), "text", ms.alias("ts_ms"))
    return later(rows, after_ms).where(F.col("bucket").isNotNull())


def live(items: DataFrame) -> DataFrame:
    return items.where(f"type = {COMMENT} AND deleted = 0 AND dead = 0 AND text IS NOT NULL AND text <> '' AND time IS NOT NULL")


def later(rows: DataFrame, after_ms: int) -> DataFrame:
    """Rows (ts_ms) strictly later than the watermark."""
    return rows.where(F.col("ts_ms") > after_ms)


def not_done(paths: DataFrame, done: DataFrame) -> DataFrame:
    """Source files (path) that no earlier run has finished."""
    return paths.join(done, "path", "left_anti")
