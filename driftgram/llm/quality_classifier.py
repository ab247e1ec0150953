"""Quality classifier: a factorization machine (operator 6).

Features are hashed distinct words, hashed bins of structure statistics (length, symbols, case,
punctuation, repetition of words, 3-word windows and lines, vocabulary, size in bytes) and of the
metadata column ``n_chars``: its size, and how it stands to the text's real length (a record whose
text was cut or joined disagrees). Pairs of them, such as a short text with many repeats, get low-rank weights of their own,
and scoring stays linear by the sum-of-squares identity. The model is fitted on at most
``SETTINGS.max_train_rows`` (6,000) labelled rows; all rows are scored.

Edge cases: null and empty texts have only structure features and metadata; a null ``n_chars``, or a
table without that column, is a value of its own; rows repeated or with null ids are
scored like any other; extra columns never matter; with no usable labels every score is the
prior; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, factorization

SETTINGS = factorization.Settings()
THRESHOLD = 0.3
_MASK = (1 << SETTINGS.bits) - 1
_DROP_BUT = {name: bytes(set(range(256)) - set(keep)) for name, keep in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "newline": b"\n",
}.items()}
_SHARES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)


def _bin(share: float) -> int:
    return sum(share > x for x in _SHARES)


def structure(raw: bytes, words: list[bytes], distinct: set[bytes]) -> dict[str, int]:
    """Binned statistics, from counts over the whole text."""
    n, size = max(1, len(words)), max(1, len(raw))
    count = {name: len(raw.translate(None, drop)) for name, drop in _DROP_BUT.items()}
    windows = set(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "words": int(2 * math.log2(len(words) + 1)),
        "bytes": int(2 * math.log2(len(raw) + 1)),
        "length": int(4 * sum(map(len, words)) / n),
        "upper": _bin(count["upper"] / max(1, count["upper"] + count["lower"])),
        "digit": _bin(count["digit"] / size),
        "symbol": _bin(count["symbol"] / n),
        "mark": _bin(count["mark"] / n),
        "stop": _bin(count["stop"] / n),
        "newline": _bin(count["newline"] / n),
        "windows": _bin(1 - len(windows) / max(1, len(words) - 2)) if len(words) > 2 else 99,
        "lines": _bin(1 - len(set(lines)) / max(1, len(lines))),
        "distinct": _bin(len(distinct) / n),
    }


def metadata(text: str, n_chars: int | None) -> dict[str, int]:
    if n_chars is None:
        return {"n_chars": -1, "n_chars_agrees": -1}
    return {"n_chars": int(2 * math.log2(max(0, n_chars) + 1)), "n_chars_agrees": (n_chars > len(text)) - (n_chars < len(text))}


def features(text: str, n_chars: int | None = None) -> np.ndarray:
    raw = text.encode("utf-8", "replace")
    words = raw.lower().split()
    distinct = set(words)
    found = {crc32(w) & _MASK for w in distinct}
    statistics = structure(raw, words, distinct) | metadata(text, n_chars)
    found |= {crc32(f" {name}={value}".encode()) & _MASK for name, value in statistics.items()}
    return np.array(sorted(found), dtype=np.int64)


def _inputs(docs: DataFrame) -> tuple[str, ...]:
    return ("text", "n_chars") if dict(docs.dtypes).get("n_chars") in ("tinyint", "smallint", "int", "bigint") else ("text",)


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    model = factorization.fit(docs, labels, "quality", features, SETTINGS, _inputs(docs))
    return factorization.scored(docs, model, features, keep=keep, inputs=_inputs(docs))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    model = factorization.fit(docs, labels, "quality", features, SETTINGS, _inputs(docs))
    return factorization.scored(docs, model, features, least=THRESHOLD, inputs=_inputs(docs))


def query(spark, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", factorization.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
