"""Registered queries of the engine's other operators: tokenizer steps on pages, requests as a relation, and
everything that goes through the store, files and streams.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpora
from .functions import dates
from .functions.text import with_tokens
from .operators import counting, ranking
from .plans import phrases, rebuild, requests
from .plans.phrases import PhraseQueries
from .queries import (
    _COUNTS, _EVERYTHING, _GLOBALS, _PARTS, _TOTALS, END, START, _built, _shared_folder, _sql_grams, _sql_tokens, _store, _text, _with, query,
)
from .sources import config, items
from .sources.store import Store, write_tsv
from .streaming import incremental

# ---------------------------------------------------------------- tokenizer, step by step, on pages

#: The pages' own entities; each stands for something that ends a token.
_BARE_HTML = "regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&(amp|copy|middot|quot);', ' ', 'g')"


def _page_tokens(name: str, written, sql_text: str) -> None:
    """Tokens of pages whose text is written in another way; the SQL has what it must come to."""
    sql = f"SELECT page_id, token, count(*)::BIGINT AS occurrences FROM (SELECT page_id, unnest({_sql_tokens(sql_text)}) AS token FROM pages) GROUP BY ALL"

    @query(name, sql)
    def counted(spark, sf_dir):
        return counting.token_counts(with_tokens(corpora.pages(spark, sf_dir).withColumn("text", written(F.col("text"), F.col("url")))), "page_id")


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_HTML = _BARE_HTML.format("html")
# letters as decimal, hexadecimal and named entities are the letters again
_page_tokens("tok_entities", lambda t, u: _replaced(t, ("th", "&#116;h"), ("ou", "&#x6F;u"), ("an", "a&#X06e;"), ("é", "&eacute;"), ("ü", "&uuml;")), _HTML)
# full-width letters and a ligature are plain ones under NFKC
_page_tokens("tok_nfkc", lambda t, u: F.translate(t, "ehE", "\uff45\uff48\uff25"), _HTML)
# zero-width characters vanish within words
_page_tokens("tok_zero_width", lambda t, u: _replaced(t, ("e", "e\u200b"), ("n", "\u200dn"), ("s", "s\ufeff"), ("h", "\u200ch")), _HTML)
# curly single quotes are apostrophes
_page_tokens("tok_quotes", lambda t, u: _replaced(t, ("en", "e\u2019n"), ("er", "\u2018er"), ("in", "\u201cin\u201d")), _BARE_HTML.format("replace(replace(replace(html, 'en', 'e' || chr(39) || 'n'), 'er', chr(39) || 'er'), 'in', chr(34) || 'in' || chr(34))"))
# a name with a path needs no scheme to be a URL: its domain is left
_page_tokens("tok_bare_urls", lambda t, u: F.concat(F.lit("see "), F.regexp_replace(u, "^https?://", ""), F.lit(" now")), "'see ' || regexp_extract(url, '://([^/]+)', 1) || ' now'")
# an upper-case scheme makes no URL: all of it is text
_page_tokens("tok_schemes", lambda t, u: F.concat(F.lit("HTTPS://"), F.regexp_extract(u, "://([^/]+)", 1), F.lit(" at http://localhost:80/a")), "'https ' || regexp_extract(url, '://([^/]+)', 1) || ' at http localhost 80 a'")


# ---------------------------------------------------------------- moments


@query("valid_buckets", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS bucket FROM events WHERE event_id % 7 <> 0")
def valid_buckets(spark, sf_dir):
    """Rows whose moment no date has are dropped: every seventh event is put beyond the calendar."""
    events = corpora.table(spark, sf_dir, "events")
    ms = dates.utc_millis(F.col("ts"), dict(events.dtypes)["ts"] == "timestamp_ntz")
    moved = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(2**62)).otherwise(-F.lit(2**62))).otherwise(ms)
    return events.select("event_id", dates.bucket_of_millis(moved).alias("b")).where("b IS NOT NULL").select("event_id", _text("b").alias("bucket"))


# ---------------------------------------------------------------- item files and streams

_ITEM = "type tinyint, deleted tinyint, dead tinyint, text string, time timestamp"


def _year(spark: SparkSession, sf_dir: str, root: str, names: DataFrame, year: int) -> None:
    rows = names.where(F.year("bucket") == year).select(
        F.lit(items.COMMENT).cast("byte").alias("type"), F.lit(0).cast("byte").alias("deleted"), (F.dayofmonth("bucket") == 1).cast("byte").alias("dead"), "text", F.col("bucket").cast("timestamp").alias("time")
    )
    rows.write.mode("overwrite").parquet(items.month_path(root, dates.parse_month(f"{year}-01")))


def _years(names: DataFrame) -> list[int]:
    return sorted(r[0] for r in names.select(F.year("bucket")).distinct().collect())


def _source(spark: SparkSession, sf_dir: str) -> str:
    """A folder of item files made of part names, a file a year, named as its January's."""
    root = f"{_shared_folder(spark)}/items-{uuid.uuid4().hex}"
    names = corpora.part_names(spark, sf_dir)
    for year in _years(names):
        _year(spark, sf_dir, root, names, year)
    return root


_LIVE = f"docs AS (SELECT bucket, t FROM ({_PARTS.split('docs AS (')[1][:-1]}) WHERE day(bucket) <> 1)"
_ROWS = "SELECT strftime(c.bucket, '%Y-%m-%d') AS bucket, c.n, ngram, count, total_count FROM counts c JOIN totals t ON c.bucket = t.bucket AND c.n = t.n"
_LIVE_COUNTS = _with(_LIVE, _sql_grams([1, 2]), _COUNTS, _TOTALS) + _ROWS
_ALL_COUNTS = _with(_PARTS, _sql_grams([1, 2]), _COUNTS, _TOTALS) + _ROWS
_FILES = config.BuildConfig(start="1990-11", end="2009-12", max_n=2, pruning=_EVERYTHING.pruning)


def _stored(store: Store) -> DataFrame:
    counts, totals = store.read("ngram_counts"), store.read("bucket_totals")
    counts = counts.groupBy("bucket", "n", "ngram").agg(F.sum("count").alias("count"))
    totals = totals.groupBy("bucket", "n").agg(F.sum("total_count").alias("total_count"))
    return counts.join(totals, ["bucket", "n"]).select(_text("bucket").alias("bucket"), "n", "ngram", "count", "total_count")


@query("existing_months", "SELECT DISTINCT strftime(l_shipdate, '%Y/%Y-01.parquet') AS path FROM lineitem JOIN part ON l_partkey = p_partkey")
def existing_months(spark, sf_dir):
    """Months without a file are left out."""
    root = _source(spark, sf_dir)
    return spark.createDataFrame([(p.removeprefix(root + "/"),) for p in items.existing_months(spark, root, _FILES.start, _FILES.end)], "path string")


@query("rebuilt_from_files", _LIVE_COUNTS)
def rebuilt_from_files(spark, sf_dir):
    store = _store(spark)
    rebuild.rebuild(spark, _source(spark, sf_dir), store, _FILES)
    return _stored(store)


class _BreaksOff(Store):
    def publish(self, *args, **more):
        raise InterruptedError("broken off before publication")


@query("rebuilt_after_a_break", _LIVE_COUNTS)
def rebuilt_after_a_break(spark, sf_dir):
    """A build breaks off when all files are counted; one file is then another, and the build goes on."""
    store, source = _store(spark), _source(spark, sf_dir)
    names = corpora.part_names(spark, sf_dir)
    changed = _years(names)[1]
    _year(spark, sf_dir, source, names.where(F.dayofmonth("bucket") < 9), changed)
    with contextlib.suppress(InterruptedError):
        rebuild.rebuild(spark, source, _BreaksOff(spark, store.root), _FILES)
    _year(spark, sf_dir, source, names, changed)
    rebuild.rebuild(spark, source, store, _FILES)
    return _stored(store)


@query("incremental_from_files", _LIVE_COUNTS)
def incremental_from_files(spark, sf_dir):
    """A batch a file, run twice; the second run finds nothing new. Read after compaction."""
    store, source = _store(spark), _source(spark, sf_dir)
    for _ in range(2):
        incremental.process_months(spark, source, store, _FILES)
    store.compact()
    return _stored(store)


@query("incremental_ten_batches", _ALL_COUNTS)
def incremental_ten_batches(spark, sf_dir):
    """Ten batches in order are what one would be; like-sized folders are merged between them."""
    store = _store(spark)
    rows = corpora.part_names(spark, sf_dir).withColumn("ts_ms", dates.bucket_end_ms(F.col("bucket")))
    first, last = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first() if rows.head(1) else (0, 0)
    step = (last - first) // 10 + 1
    for k in range(10):
        incremental.process_batch(store, rows.where(F.floor((F.col("ts_ms") - first) / step) == k), f"part {k}", _EVERYTHING)
    return _stored(store)


@query("streamed_from_files", _LIVE_COUNTS)
def streamed_from_files(spark, sf_dir):
    """The same files followed as a stream, two at a time, oldest first; then once more with nothing new."""
    store, source = _store(spark), _source(spark, sf_dir)
    for _ in range(2):
        incremental.stream(spark, f"{source}/*/*", _ITEM, store, _FILES, f"{_shared_folder(spark)}/stream-{store.root[-32:]}", files_per_trigger=2).awaitTermination()
    return _stored(store)


@query(
    "windowed_counts",
    _with(_LIVE) + "SELECT strftime(bucket, '%Y-%m-%d') AS day, count(*)::BIGINT AS comments, sum(len(t))::BIGINT AS tokens FROM docs GROUP BY bucket",
)
def windowed_counts(spark, sf_dir):
    """Daily tumbling windows over a stream; each update replaces its days."""
    source, name = _source(spark, sf_dir), f"windows_{uuid.uuid4().hex}"
    rows = items.live(spark.readStream.schema(_ITEM).parquet(f"{source}/*/*")).select(F.col("time").alias("ts"), "text")
    incremental.windowed_counts(rows, "9000 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(_text("day").alias("day"), "comments", "tokens")


_LATENESS_HOURS = 12


@query(
    "event_windows",
    f"""WITH n AS (SELECT count(*) AS n FROM events),
e AS (SELECT ts, least(5, ((row_number() OVER (ORDER BY event_id) - 1) * 6) // n + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END) AS f FROM events, n),
b AS (SELECT f, max(ts) AS newest FROM e GROUP BY f),
w AS (SELECT b.f, max(x.newest) - INTERVAL {_LATENESS_HOURS} HOUR AS mark FROM b LEFT JOIN b x ON x.f <= b.f - 2 GROUP BY b.f),
t AS (SELECT date_trunc('day', ts)::DATE AS day, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN w USING (f)),
d AS (SELECT day, count(*) FILTER (NOT late)::BIGINT AS comments, count(*) FILTER (late)::BIGINT AS late FROM t GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, comments, late FROM d, (SELECT max(newest) - INTERVAL {_LATENESS_HOURS} HOUR AS closed FROM b) WHERE day + INTERVAL 1 DAY <= closed""",
)
def event_windows(spark, sf_dir):
    """Days that a watermark has closed, as a stream writes them once and for good, with the rows that came too late for
    them: a tenth of the events arrives two files after the others of its time."""
    root = f"{_shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events = corpora.table(spark, sf_dir, "events")
    number = events.count()
    place = F.row_number().over(ranking.Window.orderBy("event_id")) - 1  # one file's rows, numbered to be dealt to six
    dealt = events.withColumn("f", F.least(F.lit(5), F.floor(place * 6 / number) + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)).cast("int"))
    dealt = dealt.select(F.timestamp_millis(dates.utc_millis(F.col("ts"), dict(events.dtypes)["ts"] == "timestamp_ntz")).alias("ts"), F.col("event_type").alias("text"), "f")
    for f in range(6):
        dealt.where(F.col("f") == f).drop("f").coalesce(1).write.parquet(f"{root}/in/{f}")
    stream = lambda: spark.readStream.schema("ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    incremental.closed_windows(stream(), f"{root}/days", f"{root}/c1", f"{_LATENESS_HOURS} hours").awaitTermination()
    late = incremental.LateRows(spark, f"{root}/late", _LATENESS_HOURS * 3_600_000)
    late.follow(stream(), f"{root}/c2").awaitTermination()
    days = spark.read.schema("day date, comments long, tokens long").parquet(f"{root}/days")
    counted = days.join(late.by_day(), "day", "left")
    return counted.select(_text("day").alias("day"), "comments", F.coalesce("late", F.lit(0)).alias("late"))


# ---------------------------------------------------------------- the published store

_STORED_SQL = (_PARTS, _sql_grams([1, 2]), _COUNTS, _TOTALS, _GLOBALS)


@query("stored_vocabulary", _with(*_STORED_SQL) + "SELECT n, ngram, count AS global_count FROM globals WHERE count >= 2")
def stored_vocabulary(spark, sf_dir):
    return _built(spark, sf_dir).read("ngram_vocabulary").select("n", "ngram", "global_count")


@query("stored_globals", _with(*_STORED_SQL) + "SELECT n, ngram, count FROM globals")
def stored_globals(spark, sf_dir):
    return _built(spark, sf_dir).read("global_counts").select("n", "ngram", "count")


@query("stored_layout", _with(*_STORED_SQL) + "SELECT year(bucket)::INTEGER * 100 + month(bucket)::INTEGER AS ym, n, ngram, 1::BIGINT AS files FROM counts GROUP BY ALL")
def stored_layout(spark, sf_dir):
    """Counts lie by month, and within a month each n-gram in one file."""
    rows = _built(spark, sf_dir).read("ngram_counts").select("ym", "n", "ngram", F.input_file_name().alias("file"))
    return rows.groupBy("ym", "n", "ngram").agg(F.count_distinct("file").alias("files"))


@query(
    "exported_lines",
    _with(_PARTS, _sql_grams([1, 2]), _COUNTS, "s AS (SELECT n, ngram, sum(count)::BIGINT AS c FROM counts GROUP BY ALL)", "r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, ngram) AS rn FROM s)")
    + "SELECT concat_ws(chr(9), c, n, ngram) AS line FROM r WHERE (n = 1 AND rn <= 60) OR (n = 2 AND rn <= 30)",
)
def exported_lines(spark, sf_dir):
    """Popular phrases as tab-separated lines, written and read again."""
    path = f"{_shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    counts = _built(spark, sf_dir).read("ngram_counts")
    write_tsv(ranking.popular_phrases(counts, 137, END, 20_000), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("totals_of_counts", _with(_PARTS, _sql_grams([1, 2]), _TOTALS) + "SELECT strftime(bucket, '%Y-%m-%d') AS bucket, n, total_count FROM totals")
def totals_of_counts(spark, sf_dir):
    """Denominators from unpruned counts."""
    counts = counting.ngram_counts(corpora.part_tokens(spark, sf_dir), 2)
    return counting.totals_of_counts(counts).select(_text("bucket").alias("bucket"), "n", "total_count")



# ---------------------------------------------------------------- requests as a relation

_GRAINS = ("day", "weekly", "Month", "YEAR")
_NAMES = "upper(p_name) || '!'"
_BUCKET = "CASE g WHEN 0 THEN c.bucket WHEN 1 THEN c.bucket - dayofweek(c.bucket)::INTEGER WHEN 2 THEN date_trunc('month', c.bucket)::DATE ELSE date_trunc('year', c.bucket)::DATE END"
_ANSWERS = (
    *_STORED_SQL,
    f"asked AS (SELECT DISTINCT {_NAMES} AS phrase, array_to_string({_sql_tokens('p_name')}, ' ') AS normalized, length({_NAMES}) % 4 AS g FROM part)",
    f"""pts AS (SELECT phrase, {_BUCKET} AS t, sum(c.count)::BIGINT AS count, sum(total_count)::BIGINT AS total
  FROM asked JOIN counts c ON c.ngram = normalized AND c.n = 2 JOIN totals d ON d.bucket = c.bucket AND d.n = 2 WHERE c.bucket BETWEEN date '1995-01-01' AND date '2001-12-31' GROUP BY ALL)""",
)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name as a request."""
    names = corpora.table(spark, sf_dir, "part").select(F.concat(F.upper("p_name"), F.lit("!")).alias("phrase")).distinct()
    grain = F.get(F.array(*map(F.lit, _GRAINS)), (F.char_length("phrase") % 4).cast("int"))
    return names.select("phrase", F.lit("1995-01-15").alias("start"), F.lit("2001-12-31").alias("end"), grain.alias("granularity"))


@query(
    "phrase_responses",
    _with(*_ANSWERS)
    + """SELECT a.phrase, a.normalized, CASE WHEN t IS NOT NULL OR g.count >= 2 THEN 'indexed' ELSE 'not_indexed' END AS status, strftime(t, '%Y-%m-%d') AS t, p.count, p.total,
  round(p.count::DOUBLE / p.total, 12) AS v, coalesce(CASE WHEN g.count >= 2 THEN g.count END, 0)::BIGINT AS global_count
FROM asked a LEFT JOIN pts p ON a.phrase = p.phrase LEFT JOIN globals g ON g.n = 2 AND g.ngram = a.normalized""",
)
def phrase_responses(spark, sf_dir):
    """All parts' names answered in one plan, a row a point."""
    rows = requests.answers(_built(spark, sf_dir), _asked(spark, sf_dir)).select("phrase", "normalized", "status", "global_count", F.explode_outer("points").alias("p"))
    return rows.select("phrase", "normalized", "status", _text("p.t").alias("t"), "p.count", "p.total", F.round("p.v", 12).alias("v"), "global_count")


@query(
    "json_responses",
    _with(*_ANSWERS)
    + """SELECT a.phrase, 200 AS http, a.normalized, 'indexed' AS status, count(t)::BIGINT AS points, sum(p.count)::BIGINT AS occurrences, any_value(g.count)::BIGINT AS global_count,
  CASE a.g WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month' ELSE 'year' END AS granularity, '1995-01-01' AS start
FROM asked a JOIN pts p ON a.phrase = p.phrase JOIN globals g ON g.n = 2 AND g.ngram = a.normalized GROUP BY a.phrase, a.normalized, a.g""",
)
def json_responses(spark, sf_dir):
    """The bodies that are sent, read back."""
    kind = f"phrase string, normalized string, status string, points array<{requests.POINT}>, global_count long, meta struct<tokenizer_version:string,start:string,end:string,granularity:string>"
    rows = requests.bodies(requests.answers(_built(spark, sf_dir), _asked(spark, sf_dir))).select("http", F.from_json("body", kind).alias("b"))
    occurrences = F.aggregate("b.points", F.lit(0).cast("long"), lambda a, p: a + p["count"])
    return rows.select("b.phrase", "http", "b.normalized", "b.status", F.size("b.points").cast("long").alias("points"), occurrences.alias("occurrences"), "b.global_count", "b.meta.granularity", "b.meta.start")


@query(
    "stored_lookups",
    _with(*_STORED_SQL, f"asked AS (SELECT DISTINCT array_to_string({_sql_tokens('p_name')}, ' ') AS ngram FROM part UNION SELECT p_brand FROM part)")
    + """SELECT a.ngram, coalesce(CASE WHEN g.count >= 2 THEN g.count END, 0)::BIGINT AS global_count, coalesce(g.count >= 2, false) AS found
FROM asked a LEFT JOIN globals g ON g.n = 2 AND a.ngram = g.ngram""",
)
def stored_lookups(spark, sf_dir):
    """Corpus totals and membership of every part's name, and of brands, that no text has."""
    part = corpora.table(spark, sf_dir, "part")
    names = with_tokens(part.select("p_name").distinct(), "p_name").select(F.array_join("tokens", " ").alias("ngram")).union(part.select("p_brand")).distinct()
    store = _built(spark, sf_dir)
    state = store.state()
    shown = store.read("global_counts", state).where(F.col("count") >= state["export_floor"])
    asked = names.select(F.lit(2).cast("byte").alias("n"), "ngram", F.monotonically_increasing_id().alias("pos"))
    found = ranking.vocabulary_check(asked, store.read("ngram_vocabulary", state))
    return found.join(ranking.with_global_counts(asked, shown), ["n", "ngram"]).select("ngram", "global_count", "found")


_PARSED = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({0} AS DATE) END"


@query(
    "checked_requests",
    f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS phrase,
  CASE o_orderkey % 5 WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN '2023-02-29' ELSE '1996-02-29' END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '1997-01-31' ELSE '2020-1-1' END AS e, CASE o_orderstatus WHEN 'F' THEN 'weekly' WHEN 'O' THEN 'YEAR' WHEN 'P' THEN 'hour' END AS g FROM orders),
p AS (SELECT *, CASE WHEN s IS NULL THEN date '2011-01-01' ELSE {_PARSED.format('s')} END AS a, {_PARSED.format('e')} AS b FROM r),
c AS (SELECT *, CASE WHEN phrase IS NULL OR phrase = '' THEN 'MISSING_PHRASE' WHEN a IS NULL OR b IS NULL THEN 'INVALID_DATE_FORMAT'
  WHEN date_trunc('month', a) > last_day(b) THEN 'INVALID_DATE_RANGE' WHEN g = 'hour' THEN 'INVALID_GRANULARITY' END AS error FROM p)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN strftime(date_trunc('month', a), '%Y-%m-%d') END AS first, CASE WHEN error IS NULL THEN strftime(last_day(b), '%Y-%m-%d') END AS last,
  CASE WHEN error IS NULL THEN CASE g WHEN 'weekly' THEN 'week' WHEN 'YEAR' THEN 'year' ELSE 'month' END END AS grain FROM c""",
)
def checked_requests(spark, sf_dir):
    """Requests of all sorts made of orders: the first fault in the documented order, or the range and granularity."""
    key, day = F.col("o_orderkey"), _text("o_orderdate")
    start = F.when(key % 5 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(key % 5 == 2, None).when(key % 5 == 3, F.when(key % 2 == 0, "2023-02-29").otherwise("1996-02-29")).otherwise(day)
    asked = corpora.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 7 == 0, "").when(key % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("phrase"), start.alias("start"),
        F.when(key % 3 == 0, day).when(key % 3 == 1, "1997-01-31").otherwise("2020-1-1").alias("end"),
        F.when(F.col("o_orderstatus") == "F", "weekly").when(F.col("o_orderstatus") == "O", "YEAR").when(F.col("o_orderstatus") == "P", "hour").alias("granularity"),
    )
    good = F.col("error").isNull()
    return requests.checked(asked).select("o_orderkey", "error", F.when(good, _text("first")).alias("first"), F.when(good, _text("last")).alias("last"), F.when(good, F.col("grain")).alias("grain"))


@query(
    "stored_feedback",
    """WITH c AS (SELECT o_custkey AS k, list_sort(list(o_orderpriority)) || CASE WHEN o_custkey % 17 = 0 THEN [repeat('é', 41)] ELSE [' '] END AS asked, min(o_orderdate) AS d FROM orders GROUP BY o_custkey),
f AS (SELECT k, d, list_filter(asked, lambda x: trim(x) <> '') AS p, CASE k % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month' WHEN 3 THEN 'year' END AS g, k % 27 AS s FROM c),
e AS (SELECT *, CASE WHEN len(p) < 2 THEN 'INVALID_PHRASES' WHEN len(p) > 10 THEN 'TOO_MANY_PHRASES' WHEN k % 17 = 0 THEN 'PHRASE_TOO_LONG' WHEN g IS NULL THEN 'INVALID_GRANULARITY'
  WHEN k % 13 = 0 THEN 'INVALID_DATE_FORMAT' WHEN s > 24 THEN 'INVALID_SMOOTHING' ELSE 'ok' END AS code FROM f)
SELECT code, CASE WHEN code = 'ok' THEN array_to_string(p, '|') END AS phrases, CASE WHEN code = 'ok' THEN g END AS granularity, CASE WHEN code = 'ok' THEN strftime(d, '%Y-%m-%d') END AS start_date,
  CASE WHEN code = 'ok' THEN s ELSE -1 END::INTEGER AS smoothing, CASE WHEN code = 'ok' THEN least(k % 300, 128) * 2 ELSE -1 END::INTEGER AS agent_bytes FROM e""",
)
def stored_feedback(spark, sf_dir):
    """Feedback made of customers' orders: what passes is stored and read again, the rest has its code."""
    key = F.col("o_custkey")
    more = F.when(key % 17 == 0, F.array(F.lit("é" * 41))).otherwise(F.array(F.lit(" ")))
    given = corpora.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("asked"), F.min("o_orderdate").alias("d")).select(
        F.concat("asked", more).alias("phrases"), F.get(F.array(*map(F.lit, ("Daily", "week", "MONTH", "year", "hour"))), (key % 5).cast("int")).alias("granularity"),
        F.when(key % 13 == 0, F.date_format("d", "dd.MM.yyyy")).otherwise(_text("d")).alias("start_date"), (key % 27).cast("int").alias("smoothing"), F.repeat(F.lit("ä"), (key % 300).cast("int")).alias("user_agent"),
    )
    judged = requests.checked_feedback(given)
    store = _store(spark)
    store.add_feedbacks(judged.where("error IS NULL").select("*", F.lit("1").alias("tokenizer_version"), F.current_timestamp().alias("created_at")))
    kept = store.feedback().select(F.lit("ok").alias("code"), F.array_join("phrases", "|").alias("phrases"), "granularity", _text("start_date").alias("start_date"), F.col("smoothing").cast("int").alias("smoothing"), F.octet_length("user_agent").alias("agent_bytes"))
    none = F.lit(None).cast("string")
    return kept.union(judged.where("error IS NOT NULL").select("error", none, none, none, F.lit(-1), F.lit(-1)))


@query(
    "compared_at_most_ten",
    _with(_PARTS, _sql_grams([2]), "asked AS (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 10)") + f"SELECT ngram, count(*)::BIGINT AS count FROM grams JOIN asked ON ngram = p_name WHERE bucket BETWEEN date '{START}' AND date '{END}' GROUP BY ngram",
)
def compared_at_most_ten(spark, sf_dir):
    """Of twelve phrases that are asked for the first ten are compared."""
    asked = [r[0] for r in corpora.table(spark, sf_dir, "part").select("p_name").distinct().orderBy("p_name").limit(12).collect()]
    return PhraseQueries(_built(spark, sf_dir)).compare(asked, START, END, "year").groupBy("ngram").agg(F.sum("count").alias("count")).where("count > 0")


@query(
    "latest_log_row",
    """SELECT 2::BIGINT AS run_seq, 'b' AS batch_id, 'process' AS command, count(*) FILTER (WHERE year(l_shipdate) >= 1998)::BIGINT AS comments_processed,
  ((max(l_shipdate::DATE) - date '1970-01-01' + 1)::BIGINT * 86400000)::BIGINT AS watermark, strftime(max(l_shipdate::DATE) + 1, '%Y-%m-%d') AS last_day
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def latest_log_row(spark, sf_dir):
    """The newest of two batches' log rows, the watermark, and what a client is told of freshness."""
    store = _store(spark)
    rows = corpora.part_names(spark, sf_dir).withColumn("ts_ms", dates.bucket_end_ms(F.col("bucket")))
    for name, part in (("a", "year(bucket) < 1998"), ("b", "year(bucket) >= 1998")):
        incremental.process_batch(store, rows.where(part), name, _EVERYTHING)
    mark, fresh = store.watermark(), PhraseQueries(store).freshness()
    last = store.log().orderBy(F.desc("run_seq")).limit(1)
    return last.select("run_seq", "batch_id", "command", "comments_processed", F.lit(mark).cast("long").alias("watermark"), F.lit(fresh["last_ingested_date"]).alias("last_day"))


@query("stored_versions", _with(_PARTS.replace("WHERE", "WHERE"), _sql_grams([1]), _COUNTS) + "SELECT strftime(bucket, '%Y-%m-%d') AS bucket, ngram, count FROM counts WHERE day(bucket) % 2 = 1")
def stored_versions(spark, sf_dir):
    """Rows of another tokenizer version lie in the store and are never read."""
    store = _store(spark)
    counts = counting.ngram_counts(corpora.part_tokens(spark, sf_dir), 1)
    version = F.when(F.dayofmonth("bucket") % 2 == 1, "1").otherwise("0")
    store.append({"ngram_counts": counts.withColumn("tokenizer_version", version)}, "both", {})
    return store.read("ngram_counts").select(_text("bucket").alias("bucket"), "ngram", "count")


@query("reset_and_refilled", _with(_PARTS, _sql_grams([1, 2]), _COUNTS, _TOTALS) + _ROWS.replace("total_count FROM", "total_count, 1::BIGINT AS feedback FROM") + " WHERE day(c.bucket) % 2 = 0")
def reset_and_refilled(spark, sf_dir):
    """A reset takes tables and log, so that older comments can be added again; feedback stays."""
    store = _store(spark)
    rows = corpora.part_names(spark, sf_dir).withColumn("ts_ms", dates.bucket_end_ms(F.col("bucket")))
    incremental.process_batch(store, rows, "a", _EVERYTHING)
    PhraseQueries(store).feedback(["a", "b"], "day", "2024-01-01", 1)
    store.reset()
    incremental.process_batch(store, rows.where(F.dayofmonth("bucket") % 2 == 0), "a", _EVERYTHING)
    return _stored(store).withColumn("feedback", F.lit(store.feedback().count()).cast("long"))
