"""Phrase queries: validation, normalisation, series, status, comparison, feedback."""

from __future__ import annotations

import datetime as dt
import json
import logging
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from urllib.parse import parse_qs, quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import TOKENIZER_VERSION, tokenize_text, with_tokens
from ..operators import ranking, series
from ..sources.config import LAUNCH
from ..sources.store import Store

#: Limits of a comparison and of feedback. (Error codes are fixed too; clients read them.)
MAX_PHRASES, MAX_PHRASE_BYTES, MAX_AGENT_BYTES, MAX_SMOOTHING = 10, 80, 256, 24


class RequestError(ValueError):
    """A request that can't be answered; ``code`` and the message say why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": str(self)}}


def _date(text: str, which: str) -> dt.date:
    day = dates.parse_date(text)
    if day is None:
        raise RequestError("INVALID_DATE_FORMAT", f"the {which} date must be written YYYY-MM-DD, not {text!r}")
    return day


def _granularity(text: str) -> str:
    known = dates.parse_granularity(text)
    if known is None:
        raise RequestError("INVALID_GRANULARITY", f"no series by {text!r}: choose day, week, month or year")
    return known


def request_range(phrase: str | None, start: str | None, end: str | None, granularity: str | None) -> tuple[dt.date, dt.date, str]:
    """The checked request, its dates widened to whole months; errors in the documented order."""
    if not phrase:
        raise RequestError("MISSING_PHRASE", "a phrase is needed")
    first = _date(start, "start") if start else dates.DEFAULT_START
    last = _date(end, "end") if end else dt.datetime.now(dt.UTC).date()
    first, last = dates.month_start(first), dates.month_end(last)
    if first > last:
        raise RequestError("INVALID_DATE_RANGE", "the range ends before it starts")
    return first, last, _granularity(granularity or "month")


class _View:
    """A state of the store and its tables, read when first asked for."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state, self._tables, self._lock = store, state, {}, threading.Lock()

    def table(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._tables:
                rows = self.store.read(name, self.state)
                if name == "bucket_totals":  # a row a day and order: kept in one partition, every series is joined to it
                    # dealt by a shuffle: under coalesce(1) one task would make the sums of all shuffle partitions, each in memory of its own
                    rows = rows.groupBy("n", "bucket").agg(F.sum("total_count").alias("total_count")).repartition(1).persist()
                self._tables[name] = rows
            return self._tables[name]

    def release(self) -> None:
        with self._lock:
            if "bucket_totals" in self._tables:
                self._tables.pop("bucket_totals").unpersist()

    def of(self, name: str, n: int, ngrams: Iterable[str]) -> DataFrame:
        """The files of a table that have these n-grams."""
        return self.store.narrowed(self.table(name), name, n, ngrams, self.state)


class PhraseQueries:
    """Answers phrase queries over a store. Answers are kept for ``ttl`` seconds, up to ``entries`` of them; equal
    requests at the same time are answered once. Each request looks up the store's latest commit: answers from before
    a batch or a publication aren't given again."""

    def __init__(self, store: Store, denominator: str = "matched", entries: int = 500, ttl: float = 3600.0):
        self.store, self.denominator, self.entries, self.ttl = store, denominator, entries, ttl
        self._kept: OrderedDict[tuple, tuple[float, dict]] = OrderedDict()
        self._flying: dict[tuple, Future] = {}
        self._lock = threading.Lock()
        self._view: _View | None = None

    def _now(self) -> _View:
        """The tables of the latest commit."""
        state = self.store.state()
        with self._lock:
            former = self._view
            if former is None or former.state["seq"] != state["seq"]:
                self._view = _View(self.store, state)
                if former:
                    former.release()
            return self._view

    def refresh(self) -> None:
        """Forgets what was kept and read."""
        with self._lock:
            self._kept.clear()
            self._view = None

    def _once(self, key: tuple, answer: Callable[[], dict]) -> dict:
        """The kept answer, that of a request under way, or a new one."""
        with self._lock:
            kept = self._kept.get(key)
            if kept and time.monotonic() - kept[0] <= self.ttl:
                return kept[1]
            flying = self._flying.get(key)
            mine = flying is None
            if mine:
                flying = self._flying[key] = Future()
        if not mine:
            return flying.result()
        try:
            body = answer()
            with self._lock:
                self._kept[key] = (time.monotonic(), body)
                while len(self._kept) > self.entries:
                    self._kept.popitem(last=False)
            flying.set_result(body)
            return body
        except BaseException as e:
            flying.set_exception(e)
            raise
        finally:
            with self._lock:
                self._flying.pop(key, None)

    def series(self, n: int, ngrams: Iterable[str], start: dt.date, end: dt.date, granularity: str, view: _View | None = None, ordered: bool = True) -> DataFrame:
        """(ngram, t, v, count, total), sparse."""
        view, ngrams = view or self._now(), list(ngrams)
        return sparse_series(view.of("ngram_counts", n, ngrams), view.table("bucket_totals"), n, ngrams, start, end, granularity, self.denominator, ordered)

    def _status(self, n: int, ngram: str, any_point: bool, view: _View) -> str:
        if n == 1 or any_point:
            return "indexed"
        return "indexed" if self.in_vocabulary(n, ngram, view) else "not_indexed"

    def in_vocabulary(self, n: int, ngram: str, view: _View | None = None) -> bool:
        return not (view or self._now()).of("ngram_vocabulary", n, [ngram]).where((F.col("n") == n) & (F.col("ngram") == ngram)).isEmpty()

    def global_count(self, n: int, ngram: str, view: _View | None = None) -> int:
        """The corpus total; 0 where there is none or it is below the store's export floor."""
        view = view or self._now()
        row = view.of("global_counts", n, [ngram]).where((F.col("n") == n) & (F.col("ngram") == ngram)).select("count").first()
        return row[0] if row and row[0] >= view.state["export_floor"] else 0

    def phrase(self, phrase: str | None, start: str | None = None, end: str | None = None, granularity: str | None = None) -> dict:
        """One phrase's response, as a dict ready for JSON."""
        first, last, grain = request_range(phrase, start, end, granularity)
        tokens = tokenize_text(phrase)
        n, normal = len(tokens), " ".join(tokens)
        meta = {"tokenizer_version": TOKENIZER_VERSION, "start": first.isoformat(), "end": last.isoformat(), "granularity": grain}
        if not 1 <= n <= series.MAX_ORDER:
            return {"phrase": phrase, "normalized": normal, "status": "invalid", "points": [], "global_count": 0, "meta": meta}
        view = self._now()

        def answer() -> dict:
            with ThreadPoolExecutor(1) as pool:  # two small jobs at the same time
                overall = pool.submit(self.global_count, n, normal, view)
                rows = sorted(self.series(n, [normal], first, last, grain, view, False).collect(), key=lambda r: r["t"])  # a row a bucket
            points = [{"t": r["t"].isoformat(), "v": r["v"], "count": r["count"], "total": r["total"]} for r in rows]
            return {"normalized": normal, "status": self._status(n, normal, bool(points), view), "points": points, "global_count": overall.result(), "meta": meta}

        return {"phrase": phrase, **self._once((view.state["changed"], n, normal, first, last, grain), answer)}

    def respond(self, phrase: str | None, start: str | None = None, end: str | None = None, granularity: str | None = None) -> tuple[int, str]:
        """Status and JSON body: the response, or the error's envelope."""
        try:
            return 200, json.dumps(self.phrase(phrase, start, end, granularity), ensure_ascii=False)
        except RequestError as e:
            return 400, json.dumps(e.envelope(), ensure_ascii=False)
        except Exception:  # what failed behind the request is logged, not shown
            logging.getLogger(__name__).exception("phrase query failed")
            return 500, json.dumps(RequestError("INTERNAL_ERROR", "The query could not be answered").envelope())

    def compare(self, asked: list[str], start: dt.date, end: dt.date, granularity: str, smoothing: int = 0, log: bool = False) -> DataFrame:
        view = self._now()
        return compared(view.table("ngram_counts"), view.table("bucket_totals"), asked, start, end, granularity, self.denominator, smoothing, log)

    def vocabulary_check(self, asked: list[tuple[int, str]]) -> list[bool]:
        if not asked:
            return []
        rows = self.store.spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(asked)], "pos int, n tinyint, ngram string")
        return [r["found"] for r in ranking.vocabulary_check(rows, self._now().table("ngram_vocabulary")).collect()]

    def freshness(self) -> dict:
        row = self.store.latest_log()
        ms = row["last_ingested_ts"] if row else None
        day = dt.datetime.fromtimestamp(ms / 1000, dt.UTC).date().isoformat() if ms else None
        return {"last_ingested_ts": ms, "last_ingested_date": day}

    @staticmethod
    def health() -> dict:
        from .. import __version__

        return {"status": "ok", "version": __version__, "tokenizer_version": TOKENIZER_VERSION}

    def feedback(self, phrases: list[str], granularity: str, start: str, smoothing: int, user_agent: str = "") -> dict:
        self.store.add_feedback(checked_feedback(phrases, granularity, start, smoothing, user_agent))
        return {"ok": True}


def checked_feedback(phrases: list[str], granularity: str, start: str, smoothing: int, user_agent: str = "") -> dict:
    kept = [p.strip() for p in phrases if p.strip()]
    if len(kept) < 2:
        raise RequestError("INVALID_PHRASES", "two phrases or more are needed, blank ones left out")
    if len(kept) > MAX_PHRASES:
        raise RequestError("TOO_MANY_PHRASES", f"there are {len(kept)} phrases; {MAX_PHRASES} is the most")
    if any(len(p.encode()) > MAX_PHRASE_BYTES for p in kept):
        raise RequestError("PHRASE_TOO_LONG", f"a phrase has more than {MAX_PHRASE_BYTES} bytes")
    grain, day = _granularity(granularity), _date(start, "start")
    if not 0 <= smoothing <= MAX_SMOOTHING:
        raise RequestError("INVALID_SMOOTHING", f"smoothing is a number from 0 to {MAX_SMOOTHING}")
    agent = user_agent.encode()[:MAX_AGENT_BYTES].decode(errors="ignore")
    return {"tokenizer_version": TOKENIZER_VERSION, "phrases": kept, "granularity": grain, "start_date": day, "smoothing": smoothing, "user_agent": agent, "created_at": dt.datetime.now(dt.UTC).replace(tzinfo=None)}


def sparse_series(counts: DataFrame, totals: DataFrame, n: int, ngrams: Iterable[str], start: dt.date, end: dt.date, granularity: str, denominator: str = "matched", ordered: bool = True) -> DataFrame:
    if granularity == "day":
        return series.points(series.stored_series(counts, totals, n, ngrams, start, end, ordered))
    return series.points(series.rebucketed_series(counts, totals, n, ngrams, start, end, granularity, denominator, ordered))


def compared(
    counts: DataFrame, totals: DataFrame, asked: list[str], start: dt.date, end: dt.date, granularity: str, denominator: str = "matched", smoothing: int = 0, log: bool = False
) -> DataFrame:
    """The first 10 phrases as one dense chart table: one scan for each order among them."""
    by_order: dict[int, list[str]] = {}
    for tokens in map(tokenize_text, asked[:MAX_PHRASES]):
        if 1 <= len(tokens) <= series.MAX_ORDER:
            by_order.setdefault(len(tokens), []).append(" ".join(tokens))
    if not by_order:
        raise RequestError("MISSING_PHRASE", "no phrase has 1 to 5 words")
    rows = None
    for n, ngrams in sorted(by_order.items()):
        part = sparse_series(counts, totals, n, ngrams, start, end, granularity, denominator)
        rows = part if rows is None else rows.unionByName(part)
    dense = series.zero_filled(rows, start, end, granularity)
    return series.chart(series.smoothed(dense, smoothing), log)


def statuses(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(phrase, normalized, n, status) of many phrases at once, from (phrase): invalid without 1 to 5 tokens; a single
    token is always indexed, a longer phrase if it is in the vocabulary."""
    tokens = with_tokens(asked.select("phrase"), "phrase").select("phrase", F.array_join("tokens", " ").alias("normalized"), F.size("tokens").alias("n"))
    known = vocabulary.select(F.col("n").cast("int").alias("n"), F.col("ngram").alias("normalized")).distinct().withColumn("found", F.lit(True))
    status = F.when(~F.col("n").between(1, series.MAX_ORDER), "invalid").when((F.col("n") == 1) | F.col("found"), "indexed").otherwise("not_indexed")
    return tokens.join(known, ["n", "normalized"], "left").select("phrase", "normalized", "n", status.alias("status"))


def state_from_url(query: str) -> dict:
    """Chart state from a URL's query string; what is missing or unknown takes its default."""
    got = {k: v[0] for k, v in parse_qs(query.lstrip("?")).items()}
    phrases = [p.strip() for p in got["q"].split(",") if p.strip()] if got.get("q") else list(LAUNCH["phrases"])
    digits = got.get("s", "")
    return {
        "phrases": phrases, "since": got["since"] if got.get("since") in dates.SINCE else LAUNCH["since"], "granularity": got.get("g") or LAUNCH["granularity"],
        "smoothing": int(digits) if digits.isdecimal() and int(digits) else LAUNCH["smoothing"], "scale": "log" if got.get("y") == "log" else "linear",
    }


def state_to_url(state: dict) -> str:
    """The query string of a chart state, without what is default."""
    defaults = {"since": LAUNCH["since"], "granularity": LAUNCH["granularity"], "smoothing": LAUNCH["smoothing"], "scale": "linear"}
    parts = [("q", ",".join(state["phrases"]))] if state["phrases"] else []
    parts += [(short, str(state[name])) for short, name in (("since", "since"), ("g", "granularity"), ("s", "smoothing"), ("y", "scale")) if state[name] != defaults[name]]
    return "?" + "&".join(f"{k}={quote(v)}" for k, v in parts) if parts else ""
