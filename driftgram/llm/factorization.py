"""Factorization machine over hashed features: training, and scoring in linear time.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair term is computed by the
sum-of-squares identity, half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2), so a document costs
(features x rank), not features squared.

Training takes a bounded sample (parameters, documented with each operator); everything else, in
particular scoring, covers all rows. Features are hashed into 2**bits places, and every place met
in training has weights. A place's x_i is the same in all documents that have it: it rises from
``floor`` to 1 with the place's chi-squared against the label, so that the many rare words don't
drown the telling ones while none is left out. The model keeps w_i x_i and v_i x_i.

Edge cases: a text without features, or with none met in training, scores the bias; labels that
are null are ignored; without any usable label, or with a single class, the model is a constant;
rows that repeat an id count once in training and are scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

Featurizer = Callable[..., "np.ndarray"]


@dataclass(frozen=True)
class Settings:
    """The sample ends with ``max_train_rows`` rows or ``max_train_features`` features of them all."""

    bits: int = 18
    rank: int = 6
    max_train_rows: int = 6000
    max_train_features: int = 1 << 25
    half_chi2: float = 20.0
    pair_places: int = 2048
    pair_least: int = 20
    floor: float = 0.03
    epochs: int = 6
    min_updates: int = 300
    rate: float = 0.1
    decay: float = 1e-4
    batch: int = 128
    seed: int = 7


@dataclass
class Model:
    """Weights of all 2**bits places; those not met in training are zero."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each document's (distinct) hashed features."""
        raw = np.full(len(docs), self.w0)
        some = np.array([k for k, d in enumerate(docs) if len(d)], dtype=np.int64)
        if len(some):
            flat = np.concatenate([docs[k] for k in some])
            starts = np.concatenate([[0], np.cumsum([len(docs[k]) for k in some])[:-1]])
            raw[some] += np.add.reduceat(self.w[flat], starts) + _pairs(self.v[flat], starts)[0]
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def _pairs(vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's pair term and sum of vectors, from its features' vectors."""
    sums = np.add.reduceat(vectors, starts, axis=0)
    return 0.5 * (sums * sums - np.add.reduceat(vectors * vectors, starts, axis=0)).sum(axis=1), sums


def pair_evidence(docs: list[np.ndarray], labels: np.ndarray, places: np.ndarray, total: np.ndarray, alone: np.ndarray, s: Settings) -> np.ndarray:
    """For each place the chi-squared of its best pair's interaction, less what both tell alone and what the best of so
    many chance pairs would reach.

    An interaction is how far one place's effect on the label's rate differs with the other there and not there: the
    rates of the four ways to have the two, with signs + - - +, squared over the variance of that sum.
    """
    varies, out = np.minimum(total, len(docs) - total), np.zeros(len(places))
    picked = np.lexsort((places, -varies))[: s.pair_places]
    picked = np.sort(picked[varies[picked] >= s.pair_least])
    rate = labels.mean() if len(labels) else 0.0
    if len(picked) < 2 or not 0 < rate < 1:
        return out
    column = np.full(len(places), -1)
    column[picked] = np.arange(len(picked))
    has = np.zeros((len(docs), len(picked)), dtype=np.float32)
    for row, doc in enumerate(docs):
        at = column[np.searchsorted(places, doc)]
        has[row, at[at >= 0]] = 1
    mine = has[labels == 1]
    n, n1 = has.sum(axis=0, dtype=np.float64), mine.sum(axis=0, dtype=np.float64)
    chance = 2 * np.log(len(picked) ** 2)
    for at in range(0, len(picked), 256):  # rows of the table of pairs
        rows = slice(at, at + 256)
        both, both1 = (has[:, rows].T @ has).astype(np.float64), (mine[:, rows].T @ mine).astype(np.float64)
        left, left1, right, right1 = n[rows, None] - both, n1[rows, None] - both1, n[None] - both, n1[None] - both1
        none, none1 = len(docs) - both - left - right, len(mine) - both1 - left1 - right1
        with np.errstate(divide="ignore", invalid="ignore"):  # a way that no row has: nothing can be said
            contrast = both1 / both - left1 / left - right1 / right + none1 / none
            told = np.nan_to_num(contrast**2 / (rate * (1 - rate) * (1 / both + 1 / left + 1 / right + 1 / none)))
        excess = told - alone[picked[rows], None] - alone[None, picked]
        excess[np.arange(len(excess)), np.arange(at, at + len(excess))] = 0
        out[picked[rows]] = np.maximum(0, excess.max(axis=1) - chance)
    return out


def evidence(docs: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The places met, and x of each."""
    flat = np.concatenate([np.empty(0, dtype=np.int64), *docs])
    places, at = np.unique(flat, return_inverse=True)
    total, a = np.bincount(at, minlength=len(places)), np.bincount(at, np.repeat(labels, [len(d) for d in docs]), minlength=len(places))
    n, p = len(docs), labels.sum()
    b, c = total - a, p - a
    d = n - p - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num(n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))
    best = np.maximum(chi2, pair_evidence(docs, labels, places, total, chi2, s))
    return places, np.minimum(1.0, s.floor + (best / (best + s.half_chi2)) ** 2)


def train(docs: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """AdaGrad on the logistic loss, in ``epochs`` or more until ``min_updates``. One class or no rows: a constant model."""
    labels = labels.astype(float)
    positive = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(positive / (1 - positive)))
    model = Model(bias, np.zeros(1 << s.bits, dtype=np.float32), np.zeros((1 << s.bits, s.rank), dtype=np.float32))
    places, scale = evidence(docs, labels, s)
    if not len(places) or len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(s.seed)
    w, v = np.zeros(len(places)), rng.normal(0, 0.01, (len(places), s.rank))
    gw0, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    order, batches = [r for r in rng.permutation(len(docs)) if len(docs[r])], []
    for at in range(0, len(order), s.batch):
        rows = order[at : at + s.batch]
        lengths = np.array([len(docs[r]) for r in rows])
        used, place = np.unique(np.searchsorted(places, np.concatenate([docs[r] for r in rows])), return_inverse=True)
        batches.append((used, place, np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(rows)), lengths), labels[rows]))
    for _ in range(max(s.epochs, -(-s.min_updates // len(batches)))):
        for k in rng.permutation(len(batches)):
            used, place, starts, owner, wanted = batches[k]
            x = scale[used][place]
            vectors = v[used][place] * x[:, None]
            pairs, sums = _pairs(vectors, starts)
            raw = bias + np.add.reduceat(w[used][place] * x, starts) + pairs
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - wanted) / len(wanted)
            gw0 += error.sum() ** 2
            bias -= s.rate * error.sum() / np.sqrt(gw0)
            each = error[owner] * x
            dw = np.bincount(place, each, minlength=len(used)) + s.decay * w[used]
            gw[used] += dw**2
            w[used] -= s.rate * dw / np.sqrt(gw[used])
            pull = each[:, None] * (sums[owner] - vectors)
            dv = np.stack([np.bincount(place, pull[:, f], minlength=len(used)) for f in range(s.rank)], axis=1) + s.decay * v[used]
            gv[used] += dv**2
            v[used] -= s.rate * dv / np.sqrt(gv[used])
    model.w0, model.w[places], model.v[places] = float(bias), w * scale, v * scale[:, None]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5."""
    return common.fold_remainder(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, label: str, featurizer: Featurizer, s: Settings, inputs: tuple[str, ...] = ("text",)) -> Model:
    """Learns from a bounded sample of the labelled rows that aren't held out, least id hashes first.

    ``inputs`` are the columns that the featurizer takes, the text first. An id labelled twice counts
    as 1 if one of its labels is 1.
    """
    order = F.xxhash64("doc_id", F.lit(s.seed))
    picked = labels.where(~held_out(labels["doc_id"]) & labels[label].isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = picked.orderBy(order, "doc_id").limit(s.max_train_rows)
    texts = docs.select("doc_id", *inputs).join(F.broadcast(picked), "doc_id")  # at most max_train_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            places = pa.array([f.astype(np.int32) for f in _featured(batch, featurizer, inputs)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places], ["doc_id", "label", "places"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.select("doc_id", F.col("label").cast("int").alias("label"), *inputs).mapInArrow(run, f"doc_id {kind}, label int, places array<int>")
    one = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("places").alias("places"))  # rows that repeat an id count once
    got, size = [], 0
    for r in one.orderBy(order, "doc_id").toLocalIterator():
        got.append((str(r["doc_id"]), np.array(r["places"], dtype=np.int64), float(r["label"])))
        size += len(r["places"])
        if size >= s.max_train_features:
            break
    got.sort(key=lambda r: r[0])
    return train([r[1] for r in got], np.array([r[2] for r in got], dtype=float), s)


def _featured(batch: pa.RecordBatch, featurizer: Featurizer, inputs: tuple[str, ...]) -> list[np.ndarray]:
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
    return [featurizer(text or "", *rest) for text, *rest in zip(*columns, strict=True)]


def scored(
    docs: DataFrame, model: Model, featurizer: Featurizer, column: str = "score", keep: list[str] | None = None, least: float | None = None, inputs: tuple[str, ...] = ("text",)
) -> DataFrame:
    """``docs`` (its ``keep`` columns, all if None) with ``column``; with ``least``, only rows that score it, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x (rank + 1) numbers of 4 bytes
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != column.lower() or least is not None]
    source = docs.select(*dict.fromkeys([*keep, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            scores = shared.value.score(_featured(batch, featurizer, inputs))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if least is None:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*keep, column])
            else:
                yield pa.RecordBatch.from_arrays(kept, keep).filter(pa.array(scores >= least))

    schema = T.StructType(source.select(*keep).schema.fields)
    return source.mapInArrow(run, schema if least is not None else schema.add(column, T.DoubleType()))
