"""Toxicity by a factorization machine over hashed terms (operator 2).

Features are a text's distinct words, lower-cased (A-Z) and freed of ASCII punctuation at both
ends, and the words' beginnings of 4, 5 and 6 bytes, which join the inflections and compounds of
a stem that are each too rare to learn from. The pair terms learn combinations, such as an insult with the mention of a group, that no
sum of single weights expresses. The model is fitted on at most ``SETTINGS.max_train_rows``
(6,000) labelled rows; all rows are scored.

Edge cases: null and empty texts have no features and get the prior; rows repeated or with null
ids are scored like any other (a null id's fold is that of empty text); extra columns never
matter; with no usable labels every score is the prior; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, factorization

SETTINGS = factorization.Settings()
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6)
_MASK = (1 << SETTINGS.bits) - 1
_PUNCTUATION = string.punctuation.encode()


def features(text: str) -> np.ndarray:
    distinct = {w.strip(_PUNCTUATION) for w in set(text.encode("utf-8", "replace").lower().split())}
    distinct.discard(b"")
    stems = {b"%d:%b" % (n, w[:n]) for n in BEGINNINGS for w in distinct if len(w) > n}
    return np.array(sorted({crc32(w) & _MASK for w in distinct | stems}), dtype=np.int64)


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    model = factorization.fit(docs, labels, "toxic", features, SETTINGS)
    return factorization.scored(docs, model, features, keep=keep)


def query(spark, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", factorization.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
