"""Written-out cases of the tokenizer, of requests, of configuration and of the store: rows against rows."""

import datetime as dt
import json
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from driftgram.functions import dates, ngrams
from driftgram.functions.text import with_tokens
from driftgram.operators import pruning, series
from driftgram.plans import phrases
from driftgram.plans.phrases import PhraseQueries
from driftgram.queries import END, START, _built, _store, _text
from driftgram.sources import config, items
from driftgram.sources.store import VersionMismatch

CASES = {}
_TOML = '[process]\nstart = "2020-01"\nmax_n = 5\nbucket_granularity = "monthly"\nmax_entries = 7\n[process.prune.2]\nmin_global = 9\n[process.prune.6]\nmin_bucket = 4\n'


def query(name, sql):
    def add(f):
        CASES[name] = (f, sql)
        return f

    return add


def _literal(columns: str, rows: list[tuple]) -> str:
    """SQL of written-out rows; ``columns`` are "name TYPE, ..."."""

    def shown(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + str(v).replace("'", "''") + "'"

    names = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'{n}::{kind} AS {n}' for n, kind in names)} FROM (VALUES {values}) AS v({', '.join(n for n, _ in names)})"


#: Texts and their tokens, joined by a bar.
TOKEN_CASES = {
    "tok_entities": [
        ("salt &amp; pepper", "salt|pepper"), ("&lt;div&gt; 3 &lt; 5", "div|3|5"), ("caf&eacute; au lait", "caf|au|lait"), ("x&nbsp;y&mdash;z", "x|y|z"), ("&copy x &copy; y", "copy|x|y"),
        ("http:&#x2F;&#x2F;a.b.com&#x2F;c d", "a.b.com|d"), ("&amp;lt;b", "lt|b"), ("it&#39;s &quot;so&quot;", "it's|so"), ("&unknown; &#0;", "unknown|#0"), ("&#65;&#x42;", "ab"),
    ],
    "tok_bare_urls": [
        ("try gitlab.com/some/repo now", "try|gitlab.com|now"), ("foo.community/x", "foo.community"), ("see example.org today", "see|example.org|today"), ("a.b.io/x?y=1#z end", "a.b.io|end"),
        ("v1.2/3", "v1.2|3"), ("x.de/path", "x.de|path"), ("(news.co/item)", "news.co"), ("a-b.dev/c", "a|b.dev"),
    ],
    "tok_schemes": [
        ("https://example.org/a/b?c=1 now", "example.org|now"), ("HTTPS://a.com/x", "https|a.com"), ("http://localhost:80 up", "http|localhost|80|up"), ("http://10.0.0.1/x", "http|10.0.0.1|x"),
        ("https://foo.com-bar.x/y z", "foo.com|bar.x|z"), ("http://a.b.c.net", "a.b.c.net"),
    ],
    "tok_nfkc": [
        ("ﬁne ﬂow", "fine|flow"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full|width"), ("x² + y³", "x2|y3"), ("hi…there", "hi...there"), ("№ 5 ½", "no|5|1|2"), ("Ⅳ", "iv"), ("℃", "c"),
    ],
    "tok_zero_width": [("zero​width", "zerowidth"), ("a‌b‍c", "abc"), ("﻿start", "start"), ("a b", "a|b"), ("a‑b", "a|b")],
    "tok_quotes": [("it’s ‘fine’", "it's|fine"), ("“quoted” text", "quoted|text"), ("rock ’n’ roll", "rock|n|roll"), ("'tis", "tis"), ("foo.'", "foo.")],
    "tok_case": [("GPT-4 İstanbul STRASSE", "gpt-4|i|stanbul|strasse"), ("ÇOUELLE", "ouelle"), ("日本 Go 語", "go"), ("Привет C++", "c++")],
    "tok_hyphens": [
        ("out-of-the-box", "out|of|the|box"), ("gpt-4 x86-64 1-2", "gpt-4|x86-64|1-2"), ("gpt-4o gpt-3.5", "gpt|4o|gpt|3.5"), ("2020-01-01 -5", "2020|01|01|5"), ("--a--b--", "a|b"), ("covid-19-era", "covid|19|era"),
    ],
    "tok_runs": [("C++ C# .NET node.js", "c++|c#|net|node.js"), ("...so...", "so"), ("a_b@c", "a|b|c"), ("+foo +", "+foo"), ("#tag ##", "#tag"), ("  ", ""), ("e.g. U.S.A.", "e.g|u.s.a")],
}


def _tokens(name: str, cases: list[tuple[str, str]]):
    @query(name, _literal("text VARCHAR, tokens VARCHAR", cases))
    def tokenized(spark, sf_dir):
        return with_tokens(spark.createDataFrame([(t,) for t, _ in cases], "text string")).select("text", F.array_join("tokens", "|").alias("tokens"))


for _name, _cases in TOKEN_CASES.items():
    _tokens(_name, _cases)


@query("ngram_windows", _literal("words VARCHAR, n INTEGER, grams VARCHAR", [("a b c", 1, "a|b|c"), ("a b c", 2, "a b|b c"), ("a b c", 3, "a b c"), ("a b c", 4, ""), ("", 1, ""), ("", 2, ""), ("a b c", 0, "")]))
def ngram_windows(spark, sf_dir):
    asked = [("a b c", 1), ("a b c", 2), ("a b c", 3), ("a b c", 4), ("", 1), ("", 2), ("a b c", 0)]
    rows = spark.createDataFrame(asked, "words string, n int")
    tokens = F.filter(F.split("words", " "), lambda x: x != "")
    grams = F.coalesce(*(F.when(F.col("n") == n, ngrams.ngrams(tokens, n)) for n in range(5)))
    return rows.select("words", "n", F.array_join(grams, "|").alias("grams"))


@query(
    "bucket_moments",
    _literal(
        "ms BIGINT, daily VARCHAR, monthly VARCHAR, yearly VARCHAR",
        [
            (1705318200000, "2024-01-15", "2024-01-01", "2024-01-01"), (0, "1970-01-01", "1970-01-01", "1970-01-01"), (1160352000000, "2006-10-09", "2006-10-01", "2006-01-01"),
            (1704067199999, "2023-12-31", "2023-12-01", "2023-01-01"), (-1, "1969-12-31", "1969-12-01", "1969-01-01"), (1710043199000, "2024-03-10", "2024-03-01", "2024-01-01"),
        ],
    ),
)
def bucket_moments(spark, sf_dir):
    rows = spark.createDataFrame([(1705318200000,), (0,), (1160352000000,), (1704067199999,), (-1,), (1710043199000,)], "ms long")
    return rows.select("ms", *(_text(dates.bucket_of_millis(F.col("ms"), g)).alias(g) for g in dates.STORED))


@query("valid_buckets", _literal("ms BIGINT, bucket VARCHAR", [(0, "1970-01-01"), (253402300799999, "9999-12-31")]))
def valid_buckets(spark, sf_dir):
    """Moments that no date has are dropped."""
    rows = spark.createDataFrame([(0,), (253402300799999,), (2**62,), (-(2**62),)], "ms long").select("ms", dates.bucket_of_millis(F.col("ms")).alias("b"))
    return rows.where("b IS NOT NULL").select("ms", _text("b").alias("bucket"))


_DATES = [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024/01/01", None), ("2024-1-1", None), ("", None), ("2024-12-31 ", None), ("1999-12-31", "1999-12-31"), ("20240101", None)]


@query("parsed_dates", _literal("asked VARCHAR, day VARCHAR", _DATES))
def parsed_dates(spark, sf_dir):
    found = [(t, d.isoformat() if (d := dates.parse_date(t)) else None) for t, _ in _DATES]
    return spark.createDataFrame(found, "asked string, day string")


_GRAINS = [("day", "day"), ("daily", "day"), ("weekly", "week"), ("Month", "month"), ("MONTHLY", "month"), ("YEAR", "year"), ("yearly", "year"), ("hour", None), ("", None)]


@query("parsed_granularities", _literal("asked VARCHAR, granularity VARCHAR", _GRAINS))
def parsed_granularities(spark, sf_dir):
    return spark.createDataFrame([(t, dates.parse_granularity(t)) for t, _ in _GRAINS], "asked string, granularity string")


@query("request_defaults", _literal("name VARCHAR, value VARCHAR", [("start", "2011-01-01"), ("since 2006", "2006-01-01"), ("since 2011", "2011-01-01"), ("granularity", "month"), ("first", "2011-01-01"), ("last is today or later", "true")]))
def request_defaults(spark, sf_dir):
    first, last, grain = phrases.request_range("x", None, None, None)
    rows = [("start", dates.DEFAULT_START.isoformat()), *((f"since {k}", d.isoformat()) for k, d in dates.SINCE.items()), ("granularity", grain), ("first", first.isoformat())]
    rows.append(("last is today or later", str(last >= dt.datetime.now(dt.UTC).date()).lower()))
    return spark.createDataFrame(rows, "name string, value string")


_REQUESTS = [
    (None, None, None, None, "MISSING_PHRASE"), ("", "x", "x", "x", "MISSING_PHRASE"), ("a", "2024/01/01", "x", "x", "INVALID_DATE_FORMAT"), ("a", None, "2024-02-30", "x", "INVALID_DATE_FORMAT"),
    ("a", "2024-05-01", "2024-04-30", "x", "INVALID_DATE_RANGE"), ("a", "2024-04-30", "2024-04-01", "hour", "INVALID_GRANULARITY"), ("a", "2024-04-30", "2024-04-01", "Week", "2024-04-01 2024-04-30 week"),
    ("a", "2023-02-10", "2024-02-10", None, "2023-02-01 2024-02-29 month"),
]


@query("checked_requests", _literal("phrase VARCHAR, first VARCHAR, last VARCHAR, grain VARCHAR, outcome VARCHAR", _REQUESTS))
def checked_requests(spark, sf_dir):
    """Requests are checked in the documented order, and their dates widened to whole months."""

    def outcome(*asked) -> str:
        try:
            return " ".join(map(str, phrases.request_range(*asked)))
        except phrases.RequestError as e:
            return e.code

    return spark.createDataFrame([(*r[:4], outcome(*r[:4])) for r in _REQUESTS], "phrase string, first string, last string, grain string, outcome string")


_FEEDBACK = [
    ("a,b", "month", "2024-01-01", 3, "ok"), ("a, ", "month", "2024-01-01", 3, "INVALID_PHRASES"), ("a,b,c,d,e,f,g,h,i,j,k", "month", "2024-01-01", 3, "TOO_MANY_PHRASES"), ("a," + "x" * 81, "month", "2024-01-01", 3, "PHRASE_TOO_LONG"),
    ("a," + "é" * 41, "month", "2024-01-01", 3, "PHRASE_TOO_LONG"), ("a," + "é" * 40, "weekly", "2024-01-01", 24, "ok"), ("a,b", "hour", "2024-01-01", 3, "INVALID_GRANULARITY"), ("a,b", "day", "2024-13-01", 3, "INVALID_DATE_FORMAT"),
    ("a,b", "day", "2024-01-01", 25, "INVALID_SMOOTHING"),
]


@query("checked_feedback", _literal("phrases VARCHAR, granularity VARCHAR, start_day VARCHAR, smoothing INTEGER, outcome VARCHAR", _FEEDBACK))
def checked_feedback(spark, sf_dir):
    def outcome(asked, grain, start, smoothing) -> str:
        try:
            phrases.checked_feedback(asked.split(","), grain, start, smoothing)
            return "ok"
        except phrases.RequestError as e:
            return e.code

    return spark.createDataFrame([(*r[:4], outcome(*r[:4])) for r in _FEEDBACK], "phrases string, granularity string, start_day string, smoothing int, outcome string")


@query("stored_feedback", _literal("phrases VARCHAR, granularity VARCHAR, start_date VARCHAR, smoothing TINYINT, agent_bytes INTEGER", [("red|plate", "month", "2024-01-01", 3, 256), ("a b|c", "week", "2011-01-01", 0, 0)]))
def stored_feedback(spark, sf_dir):
    asked = PhraseQueries(_store(spark))
    asked.feedback([" red ", "plate", ""], "Monthly", "2024-01-01", 3, "é" * 200)
    asked.feedback(["a b", "c"], "week", "2011-01-01", 0)
    rows = asked.store.feedback()
    return rows.select(F.array_join("phrases", "|").alias("phrases"), "granularity", _text("start_date").alias("start_date"), "smoothing", F.octet_length("user_agent").alias("agent_bytes"))


@query("order_validity", _literal("n INTEGER, ngrams INTEGER, valid BOOLEAN", [(0, 1, False), (1, 1, True), (5, 2, True), (6, 1, False), (2, 0, False)]))
def order_validity(spark, sf_dir):
    counts = spark.createDataFrame([], "bucket date, n tinyint, ngram string, count long")
    totals = spark.createDataFrame([], "bucket date, n tinyint, total_count long")

    def valid(n: int, size: int) -> bool:
        try:
            series.stored_series(counts, totals, n, ["x"] * size, START, END)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(n, k, valid(n, k)) for n, k in ((0, 1), (1, 1), (5, 2), (6, 1), (2, 0))], "n int, ngrams int, valid boolean")


_URLS = [
    ("", "rust|python", "2011", "month", 3, "linear", "?q=rust%2Cpython"), ("?q=red%20apples,%20pears,&g=week&s=0&y=log&since=1999", "red apples|pears", "2011", "week", 3, "log", "?q=red%20apples%2Cpears&g=week&y=log"),
    ("?q=a&since=2006&g=year&s=7", "a", "2006", "year", 7, "linear", "?q=a&since=2006&g=year&s=7"),
]


@query("url_states", _literal("url VARCHAR, phrases VARCHAR, since VARCHAR, granularity VARCHAR, smoothing INTEGER, scale VARCHAR, written VARCHAR", _URLS))
def url_states(spark, sf_dir):
    rows = [(url, "|".join(s["phrases"]), s["since"], s["granularity"], s["smoothing"], s["scale"], phrases.state_to_url(s)) for url, *_ in _URLS for s in [phrases.state_from_url(url)]]
    return spark.createDataFrame(rows, "url string, phrases string, since string, granularity string, smoothing int, scale string, written string")


@query(
    "configured_thresholds",
    _literal("n INTEGER, min_global INTEGER, min_bucket INTEGER, min_flush INTEGER", [(1, 0, 1, 1), (2, 9, 4, 2), (3, 10, 5, 2), (4, 8, 2, 2), (5, 7, 2, 2), (6, 0, 4, 1)]),
)
def configured_thresholds(spark, sf_dir):
    """A TOML file over the defaults, the environment over both."""
    handle, path = tempfile.mkstemp(suffix=".toml")  # a file of the driver alone
    with os.fdopen(handle, "w") as f:
        f.write(_TOML)
    got = config.load(path, {"PRUNE_MIN_2GRAM_BUCKET": "4", "PRUNE_MIN_5GRAM_GLOBAL": "7", "PRUNE_MIN_3GRAM_FLUSH": "many"})
    os.unlink(path)
    return spark.createDataFrame([(n, t.min_global, t.min_bucket, t.min_flush) for n, t in sorted(got.pruning.thresholds.items())], "n int, min_global int, min_bucket int, min_flush int")


@query("configured_build", _literal("start_month VARCHAR, end_month VARCHAR, max_n INTEGER, granularity VARCHAR, floor_of_export INTEGER", [("2006-10", None, 3, "daily", 5), ("2021-02", "2021-03", 5, "yearly", 5)]))
def configured_build(spark, sf_dir):
    """Defaults, and arguments over them."""
    made = [config.load(None, {}), config.load(None, {}, start="2021-02", end="2021-03", max_n=5, bucket_granularity="yearly")]
    rows = [(c.start, c.end, c.max_n, c.bucket_granularity, c.pruning.export_floor) for c in made]
    return spark.createDataFrame(rows, "start_month string, end_month string, max_n int, granularity string, floor_of_export int")


@query(
    "suggested_sets",
    _literal("asked VARCHAR, suggested BOOLEAN", [("pytorch |TENSORFLOW", True), ("atom|vscode", True), ("rust", False), ("NFT|GPT", False), ("gpt|nft|agent", True), ("rust|python", False)]),
)
def suggested_sets(spark, sf_dir):
    asked = ["pytorch |TENSORFLOW", "atom|vscode", "rust", "NFT|GPT", "gpt|nft|agent", "rust|python"]
    return spark.createDataFrame([(a, config.is_suggested(a.split("|"))) for a in asked], "asked string, suggested boolean")


@query("launch_defaults", _literal("phrases VARCHAR, since VARCHAR, granularity VARCHAR, smoothing INTEGER, suggestions INTEGER", [("rust|python", "2011", "month", 3, 9)]))
def launch_defaults(spark, sf_dir):
    x = config.LAUNCH
    return spark.createDataFrame([("|".join(x["phrases"]), x["since"], x["granularity"], x["smoothing"], len(config.SUGGESTED))], "phrases string, since string, granularity string, smoothing int, suggestions int")


@query("late_rows", _literal("ts_ms BIGINT, late BOOLEAN", [(999, True), (1000, True), (1001, False)]))
def late_rows(spark, sf_dir):
    """Rows not later than the watermark, to the millisecond, are late."""
    rows = spark.createDataFrame([(999,), (1000,), (1001,)], "ts_ms long")
    return rows.join(items.later(rows, 1000).withColumn("kept", F.lit(True)), "ts_ms", "left").select("ts_ms", F.col("kept").isNull().alias("late"))


@query("unfinished_files", _literal("path VARCHAR", [("b",), ("d",)]))
def unfinished_files(spark, sf_dir):
    return items.not_done(spark.createDataFrame([(p,) for p in "abcd"], "path string"), spark.createDataFrame([("a",), ("c",), ("e",)], "path string"))


_SCHEMAS = [
    ("type int, deleted int, dead int, text string, time timestamp", "ok"), ("type tinyint, deleted smallint, dead int, text string, time timestamp_ntz, id long", "ok"), ("type int, deleted int, dead int, text string", "column 'time' is missing"),
    ("type int, deleted int, dead int, text string, time string", "column 'time' has type string"), ("type string, deleted int, dead int, text string, time timestamp", "column 'type' has type string"),
]


@query("checked_schemas", _literal("columns VARCHAR, outcome VARCHAR", _SCHEMAS))
def checked_schemas(spark, sf_dir):
    def outcome(columns: str) -> str:
        try:
            items.check_schema(spark.createDataFrame([], columns))
            return "ok"
        except ValueError as e:
            return str(e)

    return spark.createDataFrame([(c, outcome(c)) for c, _ in _SCHEMAS], "columns string, outcome string")


_BODIES = [
    ("a b c d e f", "2024-01-10", "2024-02-01", "week", 200,
     '{"phrase": "a b c d e f", "normalized": "a b c d e f", "status": "invalid", "points": [], "global_count": 0, "meta": {"tokenizer_version": "1", "start": "2024-01-01", "end": "2024-02-29", "granularity": "week"}}'),
    ("é!", "2024-01-10", "2024-02-01", None, 200,
     '{"phrase": "é!", "normalized": "", "status": "invalid", "points": [], "global_count": 0, "meta": {"tokenizer_version": "1", "start": "2024-01-01", "end": "2024-02-29", "granularity": "month"}}'),
    ("qqq www", "2024-01-10", "2024-02-01", "day", 200,
     '{"phrase": "qqq www", "normalized": "qqq www", "status": "not_indexed", "points": [], "global_count": 0, "meta": {"tokenizer_version": "1", "start": "2024-01-01", "end": "2024-02-29", "granularity": "day"}}'),
    ("x", "2024-05-01", "2024-04-01", "day", 400, "INVALID_DATE_RANGE"), ("x", "soon", None, None, 400, "INVALID_DATE_FORMAT"), (None, None, None, None, 400, "MISSING_PHRASE"),
]


@query("json_responses", _literal("phrase VARCHAR, first VARCHAR, last VARCHAR, grain VARCHAR, status INTEGER, body VARCHAR", _BODIES))
def json_responses(spark, sf_dir):
    """Bodies as they are sent; of errors the envelope's code."""
    asked, rows = PhraseQueries(_built(spark, sf_dir)), []
    for r in _BODIES:
        status, body = asked.respond(*r[:4])
        rows.append((*r[:4], status, body if status == 200 else json.loads(body)["error"]["code"]))
    return spark.createDataFrame(rows, "phrase string, first string, last string, grain string, status int, body string")


@query("compared_at_most_ten", _literal("asked INTEGER, shown BIGINT", [(12, 10)]))
def compared_at_most_ten(spark, sf_dir):
    """Only the first ten phrases are compared. (All single names occur on most days.)"""
    names = [f"w{i}" for i in range(12)]
    counts = spark.createDataFrame([(dt.date(2000, 1, 1), 1, w, 1) for w in names], "bucket date, n int, ngram string, count long")
    totals = spark.createDataFrame([(dt.date(2000, 1, 1), 1, 12)], "bucket date, n int, total_count long")
    shown = phrases.compared(counts, totals, names, START, END, "day").where("count > 0")
    return shown.agg(F.count_distinct("ngram").alias("shown")).select(F.lit(12).alias("asked"), "shown")


@query("version_guard", _literal("logged VARCHAR, refused BOOLEAN", [("1", False), ("0", True)]))
def version_guard(spark, sf_dir):
    """A log that names another tokenizer version stops a run."""
    rows = []
    empty = {t: spark.createDataFrame([], columns) for t, columns in (("bucket_totals", "n tinyint, bucket date, total_count long"),)}
    for version in ("1", "0"):
        store = _store(spark)
        store.append(empty, "x", {"tokenizer_version": version})
        try:
            store.check_version()
            rows.append((version, False))
        except VersionMismatch:
            rows.append((version, True))
    return spark.createDataFrame(rows, "logged string, refused boolean")


@query("reset_store", _literal("step VARCHAR, totals BIGINT, log_rows BIGINT, watermark BIGINT, feedback_rows BIGINT", [("before", 1, 1, 7, 1), ("after", 0, 0, 0, 1)]))
def reset_store(spark, sf_dir):
    """Tables and log go; feedback stays."""
    store, rows = _store(spark), []
    store.append({"bucket_totals": spark.createDataFrame([(1, dt.date(2024, 1, 1), 5)], "n tinyint, bucket date, total_count long")}, "x", {"last_ingested_ts": 7})
    PhraseQueries(store).feedback(["a", "b"], "day", "2024-01-01", 1)
    for step in ("before", "after"):
        rows.append((step, store.read("bucket_totals").count(), store.log().count(), store.watermark(), store.feedback().count()))
        store.reset()
    return spark.createDataFrame(rows, "step string, totals long, log_rows long, watermark long, feedback_rows long")


@query("health", _literal("status VARCHAR, tokenizer_version VARCHAR", [("ok", "1")]))
def health(spark, sf_dir):
    told = PhraseQueries.health()
    return spark.createDataFrame([(told["status"], told["tokenizer_version"])], "status string, tokenizer_version string")


@query("admission_thresholds", _literal("n INTEGER, count BIGINT, admitted BOOLEAN, fills_bucket BOOLEAN", [(1, 1, True, True), (2, 19, False, True), (2, 20, True, True), (2, 2, False, False), (3, 10, True, True), (3, 4, False, False), (4, 8, True, True), (5, 4, False, True), (5, 5, True, True), (6, 99, False, False)]))
def admission_thresholds(spark, sf_dir):
    """The default thresholds; an order without one is never admitted."""
    rows = spark.createDataFrame([(1, 1), (2, 19), (2, 20), (2, 2), (3, 10), (3, 4), (4, 8), (5, 4), (5, 5), (6, 99)], "n int, count long")
    rules = pruning.Pruning()
    return rows.select("n", "count", rules.admits(F.col("count"), F.col("n")).alias("admitted"), rules.fills_bucket(F.col("count"), F.col("n")).alias("fills_bucket"))


@query("month_range", "SELECT strftime(m, '%Y-%m') AS month, 'data/' || strftime(m, '%Y/%Y-%m') || '.parquet' AS path FROM (SELECT unnest(generate_series(date '2006-10-01', date '2008-02-01', INTERVAL 1 MONTH)) AS m)")
def month_range(spark, sf_dir):
    return items.month_paths(dates.month_range(spark, "2006-10", "2008-02"), "data").select(F.date_format("month", "yyyy-MM").alias("month"), "path")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, sf_dir, name):
    made, sql = CASES[name]
    got, expected = made(spark, sf_dir).toPandas(), duckdb.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    shown = [sorted(tuple(map(str, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)) for df in (got, expected)]
    assert shown[0] == shown[1]
