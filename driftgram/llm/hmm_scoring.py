"""Hidden Markov language model (operator 4).

Tokens are a text's words, lower-cased (A-Z), and one end token. A text's probability is that of
an HMM with :data:`STATES` states. A state emits the end token, any word with at least
:data:`OWN` training occurrences (each has emission probabilities of its own, however many such
words there are), or a bucket of rarer words (crc32 of the word, modulo :data:`BUCKETS`), and a
bucket emits the rare word:

    P(text) = P_hmm(words and buckets) * prod q(rare word | bucket),   q = (c + 0.1) / (C + 0.1 * (V + 1))

with c the word's training count, C and V the tokens and distinct rare words of its bucket, and
one unseen word a bucket, so every factor is a proper distribution. Baum-Welch's expected counts
come from every training text in each of :data:`ITERATIONS` passes and are summed by word or
bucket. The start is fitted by EM to how often tokens follow each other in all training texts.
Those counts are kept by class: the :data:`CLASSES` most frequent words are one each, the others
share as many (their bucket, modulo that), and a word or bucket starts with its share of its class.
The scaled forward recursion gives the exact likelihood of whole texts.

Word counts c cover all training texts. Only the most frequent words, at most :data:`HEAD`, are
broadcast with their emission rows. Texts are encoded once in blocks of bounded size that list the
other words they contain. Counts of those meet the blocks in one shuffle join; their emission rows
come back to the blocks from each pass's sums, whose rows know where they came from. So no task or
driver ever holds the whole vocabulary; a task that sums holds the blocks of one word at a time. Expected counts are summed as integers: the order of rows,
tasks and blocks doesn't matter, and neither does it for the start.

Edge cases: a null or empty text is the end token alone; rows that repeat are learned as often
and scored alike; rows with null ids are scored (their fold is that of empty text); extra columns
are ignored; with no training rows N is 0 and all words are unknown; an empty table gives an
empty result.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STATES = 6
BUCKETS = 1 << 14
END = BUCKETS
OWN = 5  # training occurrences from which a word has emission probabilities of its own
ITERATIONS = 2
CLASSES = 512  # words with a class of their own in the start; the others share as many
START_ITERATIONS = 150
HEAD = 100_000
SMOOTH = 0.1
_FIXED = float(1 << 20)  # expected counts are summed as integers, so their order doesn't matter
_AREA = 300_000  # tokens taken through the recursion together
_FLUSH = 300_000
_BLOCK = 6_000_000  # tokens encoded together
_CHUNK = 2048  # rows of dense counts sent together
_PLACES = 2 * CLASSES + 1  # classes, the end token's last
_PAIRS = 1 << 14  # counts of neighbours sent together


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # (buckets + 1, then other words) x states


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def encoded(words: list[bytes]) -> np.ndarray:
    """The words' buckets and, last, the end token's."""
    out = np.empty(len(words) + 1, dtype=np.int32)
    out[:-1] = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) & (BUCKETS - 1)
    out[-1] = END
    return out


@dataclass
class Group:
    """Some texts, longest first, their codes ordered by time: at time t come those of the first
    ``active[t]`` texts, from place ``first[t]`` on."""

    rows: np.ndarray
    codes: np.ndarray
    active: np.ndarray
    first: np.ndarray

    def texts(self) -> np.ndarray:
        """The text of each code."""
        return np.arange(len(self.codes)) - np.repeat(self.first[:-1], self.active)


def _groups(sequences: list[np.ndarray]) -> Iterator[Group]:
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    at = 0
    while at < len(order):
        rows = order[at : at + max(1, _AREA // len(sequences[order[at]]))]
        lengths = np.array([len(sequences[r]) for r in rows])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        out = Group(rows, np.empty(0), active, np.concatenate([[0], np.cumsum(active)]))
        out.codes = np.zeros(lengths.sum(), dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out.codes = np.concatenate([sequences[r] for r in rows])[starts[out.texts()] + np.repeat(np.arange(lengths[0]), active)]
        yield out
        at += len(rows)


def log_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 P of each code sequence, by the scaled forward recursion."""
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    out = np.zeros(len(sequences))
    for g in _groups(sequences):
        emitted, scale = emit[g.codes], np.empty(len(g.codes), dtype=np.float32)
        alpha = start * emitted[: g.active[0]]
        for t, (n, at) in enumerate(zip(g.active.tolist(), g.first.tolist(), strict=False)):
            if t:
                alpha = alpha[:n] @ move
                alpha *= emitted[at : at + n]
            sums = alpha.sum(axis=1)
            scale[at : at + n] = sums
            alpha /= sums[:, None]
        out[g.rows] = np.bincount(g.texts(), np.log10(scale.astype(float)), minlength=len(g.rows))
    return out


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, places: int = BUCKETS + 1) -> Counts:
        return cls(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((places, STATES)))

    def model(self) -> Hmm:
        start, move, emit = self.start + 0.1, self.move + 0.1, self.emit + 0.01
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expect(model: Hmm, sequences: list[np.ndarray], into: Counts) -> None:
    """Adds the sequences' expected counts (forward-backward)."""
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    back = np.ascontiguousarray(move.T)
    for g in _groups(sequences):
        steps = list(zip(g.active.tolist(), g.first.tolist(), strict=False))
        emitted = emit[g.codes]
        alpha, scale = np.empty((len(g.codes), STATES), dtype=np.float32), np.empty((len(g.codes), 1), dtype=np.float32)
        for t, (n, at) in enumerate(steps):
            now = alpha[at : at + n]
            if t:
                np.matmul(alpha[steps[t - 1][1] :][:n], move, out=now)
                now *= emitted[at : at + n]
            else:
                np.multiply(emitted[:n], start, out=now)
            np.sum(now, axis=1, keepdims=True, out=scale[at : at + n])
            now /= scale[at : at + n]
        emitted /= scale
        beta = np.ones((g.active[0], STATES), dtype=np.float32)
        into_move = np.zeros((STATES, STATES))
        for t in range(len(steps) - 1, -1, -1):
            n, at = steps[t]
            if t:
                seen = emitted[at : at + n]
                seen *= beta[:n]
                into_move += alpha[steps[t - 1][1] :][:n].T @ seen
            alpha[at : at + n] *= beta[:n]  # from here on the share of each state
            if t:
                np.matmul(seen, back, out=beta[:n])
        into.move += into_move * model.move
        into.start += alpha[: g.active[0]].sum(axis=0)
        for s in range(STATES):
            into.emit[:, s] += np.bincount(g.codes, alpha[:, s], minlength=len(into.emit))


@dataclass
class Start:
    """What the start is fitted to, counted in all training texts."""

    words: dict[bytes, int]  # the most frequent words' classes
    pairs: np.ndarray  # classes x classes: how often the second comes next, a first word after an end token


def _class_of_bucket(bucket: np.ndarray) -> np.ndarray:
    return CLASSES + (bucket & (CLASSES - 1))


def _initial(seen: Start) -> tuple[Hmm, dict[bytes, int]]:
    """A model fitted by EM to neighbouring tokens, from random shares of the counts of their classes. It emits
    classes; its rows are divided by the tokens of the class, the end token's isn't."""
    rng = np.random.default_rng(11)
    held = seen.pairs.sum(axis=0)
    share = rng.dirichlet(np.ones(STATES), _PLACES)
    counts = Counts(np.zeros(STATES), np.eye(STATES) * 18 + 0.4, np.empty(0))
    both = counts.move / counts.move.sum()  # P(state, next state)
    for _ in range(START_ITERATIONS if held.any() else 0):
        emit = held[:, None] * share + 0.01
        emit /= emit.sum(axis=0)
        ratio = seen.pairs / (emit @ both @ emit.T)
        after, before = ratio @ emit, ratio.T @ emit
        first = np.outer(emit[-1], after[-1]) * both  # of an end token and a first word
        joint = both * (emit.T @ after)
        places = emit * (after @ both.T + before @ both) + 1e-12
        share = places / places.sum(axis=1, keepdims=True)
        counts.start, counts.move, both = first.sum(axis=0), joint - first, joint / joint.sum()
    counts.emit = held[:, None] * share
    model = counts.model()
    model.emit[:-1] /= held[:-1, None] + SMOOTH
    return model, seen.words


def start_texts(train: DataFrame, counts: DataFrame | None = None) -> Start:
    """Counts of neighbours in every text of ``train``, whose :func:`word_counts` may be given."""
    counts = word_counts(train) if counts is None else counts
    frequent = counts.where(F.col("c") >= OWN).orderBy(F.desc("c"), "word").limit(CLASSES).select("word").collect()
    words = {bytes(r["word"]): k for k, r in enumerate(frequent)}
    shared = train.sparkSession.sparkContext.broadcast(words)
    cells = _PLACES * _PLACES

    def classes(text: str | None) -> np.ndarray:
        words = tokens(text)
        out = np.full(len(words) + 1, _PLACES - 1)
        out[:-1] = np.fromiter(map(shared.value.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        others = np.flatnonzero(out < 0)
        out[others] = _class_of_bucket(_buckets([words[i] for i in others.tolist()]))
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, dtype=np.int64)
        for batch in common.slices(batches):
            places = np.concatenate([np.array([_PLACES - 1]), *map(classes, common.texts(batch))])
            sums += np.bincount(places[:-1] * _PLACES + places[1:], minlength=cells)
        yield from chunked({k: sums[at : at + _PAIRS] for k, at in enumerate(range(0, cells, _PAIRS))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in common.slices(batches, 1):
            k = batch.column(0)[0].as_py()
            part = unpacked(k, batch.column(1)[0].as_py())
            sums[k] = sums[k] + part if k in sums else part
        yield from chunked(sums)

    def unpacked(k: int, packed: bytes) -> np.ndarray:
        return _unpacked(packed, np.int64, min(_PAIRS, cells - k * _PAIRS))

    def chunked(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in parts.items():
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], ["chunk", "n"])

    schema, pairs = "chunk int, n binary", np.zeros(cells, dtype=np.int64)
    for r in train.select("text").mapInArrow(partial, schema).repartition("chunk").mapInArrow(summed, schema).collect():  # a row a chunk
        pairs[r["chunk"] * _PAIRS :][:_PAIRS] = unpacked(r["chunk"], r["n"])
    return Start(words, pairs.reshape(_PLACES, _PLACES))


# ---------------------------------------------------------------- blocks of encoded texts


def _packed(numbers: np.ndarray) -> bytes:
    """Bytes of one rank together, which pack best."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(packed, count * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _blocks(rows: DataFrame, head: dict[bytes, int]) -> tuple[DataFrame, str]:
    """Encoded texts of ``rows`` (doc_id, text, learned, wanted) in blocks of about ``_BLOCK`` tokens.

    ``words`` lists the block's words outside ``head``. Codes are buckets (the end token's only),
    then the head's words in order, then places in ``words``. ``ids`` are those of wanted texts.
    """
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast({w: BUCKETS + 1 + k for k, w in enumerate(head)})
    dense = BUCKETS + 1 + len(head)
    names = ["ids", "lengths", "flags", "codes", "words", "size"]

    def made(ids: list, flags: list, codes: list[np.ndarray], local: dict[bytes, int]) -> pa.RecordBatch:
        ids = pa.concat_arrays(ids)
        words = b"\n".join(local)  # no word holds white space
        packed = (np.array([len(c) for c in codes], dtype=np.int32).tobytes(), np.concatenate(flags).tobytes(), _packed(np.concatenate(codes)), pa.compress(words, codec="zstd", asbytes=True))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in packed), pa.array([len(words)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        ids, flags, codes, local, size = [], [], [], {}, 0
        for batch in common.slices(batches, 64):
            learned, wanted = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint8) for k in (2, 3))
            ids.append(batch.column(0).filter(batch.column(3)))
            flags.append(learned + 2 * wanted)
            for text in common.texts(batch):
                words = tokens(text)
                out = np.empty(len(words) + 1, dtype=np.int32)
                out[:-1] = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                out[-1] = END
                others = np.flatnonzero(out < 0)
                out[others] = [dense + local.setdefault(words[i], len(local)) for i in others.tolist()]
                codes.append(out)
                size += len(out)
            if size >= _BLOCK:
                yield made(ids, flags, codes, local)
                ids, flags, codes, local, size = [], [], [], {}, 0
        if codes:
            yield made(ids, flags, codes, local)

    made_rows = rows.select("doc_id", "text", "learned", "wanted").mapInArrow(encode, f"ids array<{kind}>, lengths binary, flags binary, codes binary, words binary, size long")
    return common.stored(made_rows.withColumn("block", F.monotonically_increasing_id()), "hmm-texts", "uncompressed")  # numbered before the copy, so fixed


def _words(words: pa.Scalar, size: pa.Scalar) -> list[bytes]:
    return pa.decompress(words.as_py(), size.as_py(), codec="zstd", asbytes=True).split(b"\n") if size.as_py() else []


def _buckets(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) & (BUCKETS - 1)).astype(np.int32)


def _by_block(rows: DataFrame, value: str, numbers: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """A row a block, (block, ats, value), from its ``rows`` (block, at, value), as bytes: sorted, so that the JVM never collects them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (ats, values))], ["block", "ats", value])

        block, ats, values = None, [], []
        for batch in batches:
            blocks, at, of_at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), numbers(batch.column(2))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for first, end in pairwise(cuts if len(blocks) else []):
                if block is not None and block != blocks[first]:
                    yield out()
                    ats, values = [], []
                block = int(blocks[first])
                ats.append(at[first:end])
                values.append(of_at[first:end])
        if block is not None:
            yield out()

    return rows.select("block", "at", value).repartition("block").sortWithinPartitions("block").mapInArrow(run, f"block long, ats binary, {value} binary")


def _met(row: dict[str, pa.Array], value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Places and values from :func:`_by_block`; none for null."""
    return tuple(np.frombuffer(x, dtype=t) if x else np.empty(0, dtype=t) for x, t in ((row["ats"][0].as_py(), np.int32), (row[value][0].as_py(), kind)))


def _counted(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``blocks`` with ``counts``, the training counts of its words (0 for unknown ones)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            words = _words(batch.column(1)[0], batch.column(2)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), batch.column(0)[0].as_py(), dtype=np.int64)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words, pa.binary())], ["block", "at", "word"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            row = dict(zip(batch.schema.names, batch.columns, strict=True))
            at, met = _met(row, "c", np.int64)
            c = np.zeros(len(_words(row["words"][0], row["size"][0])), dtype=np.int64)
            c[at] = met
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array([_packed(c)], pa.binary())], [*names, "counts"])

    names = blocks.columns
    listed = blocks.select("block", "words", "size").mapInArrow(rows, "block long, at int, word binary")
    met = _by_block(listed.join(counts.select("word", "c"), "word"), "c", lambda c: c.to_numpy())
    schema = ", ".join(f"{n} {t}" for n, t in blocks.dtypes)
    return common.stored(blocks.join(met, "block", "left").select(*names, "ats", "c").mapInArrow(placed, f"{schema}, counts binary"), "hmm-blocks", "uncompressed")[0]


@dataclass
class Opened:
    """A block, with the model extended by rows for its own words."""

    row: dict[str, pa.Array]
    words: list[bytes]
    counts: np.ndarray
    buckets: np.ndarray
    own: np.ndarray  # places in ``words``
    model: Hmm
    codes: np.ndarray
    lengths: np.ndarray
    flags: np.ndarray
    sequences: list[np.ndarray]  # of the model's places


@dataclass
class Learned:
    """The broadcast part of a model: emission rows of buckets and head, what one occurrence in each bucket begins
    with and, of other words with a class of their own, what they do; and the divisors of the other words' weights."""

    model: Hmm
    one: np.ndarray
    words: dict[bytes, np.ndarray]
    total: np.ndarray | None = None

    def begin(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        out = self.one[_buckets(words)]
        for k, w in enumerate(words):
            if w in self.words:
                out[k] = self.words[w]
        return out * counts[:, None]


def _opened(batches: Iterator[pa.RecordBatch], learned: Learned) -> Iterator[Opened]:
    for batch in common.slices(batches, 1):
        yield _open(batch, learned)  # kept by the caller alone


def _open(batch: pa.RecordBatch, learned: Learned) -> Opened:
    dense = len(learned.model.emit)
    row = dict(zip(batch.schema.names, batch.columns, strict=True))
    lengths = np.frombuffer(row["lengths"][0].as_py(), dtype=np.int32)
    codes = _unpacked(row["codes"][0].as_py(), np.int32, int(lengths.sum()))
    words = _words(row["words"][0], row["size"][0])
    counts, buckets = _unpacked(row["counts"][0].as_py(), np.int64, len(words)), _buckets(words)
    own = np.flatnonzero(counts >= OWN)
    if learned.total is None:
        weights = learned.begin([words[i] for i in own.tolist()], counts[own])
    else:
        at, met = _met(row, "w", np.float32)
        weights = np.zeros((len(words), STATES), dtype=np.float32)
        weights[at] = met.reshape(-1, STATES)
        weights = weights[own] / learned.total
    places = np.concatenate([np.arange(dense, dtype=np.int32), buckets])
    places[dense + own] = dense + np.arange(len(own))
    model = Hmm(learned.model.start, learned.model.move, np.vstack([learned.model.emit, weights]))
    sequences = np.split(places[codes], np.cumsum(lengths)[:-1])
    return Opened(row, words, counts, buckets, own, model, codes, lengths, np.frombuffer(row["flags"][0].as_py(), dtype=np.uint8), sequences)


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of :data:`STATES` numbers each, as rows."""
    if not len(column):
        return np.empty((0, STATES), dtype=kind)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], dtype=kind)[at[0] // size : at[-1] // size].reshape(-1, STATES)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value a row."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


# ---------------------------------------------------------------- Baum-Welch passes


def _free(spark) -> None:
    """Lets Spark's cleaner drop shuffle files of passes that are over; they would stay till the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _with_rows(blocks: DataFrame, met: DataFrame | None) -> DataFrame:
    """``blocks`` with the emission weights of their own words, from (block, at, w)."""
    if met is None:
        return blocks
    return blocks.join(_by_block(met.where("block IS NOT NULL"), "w", lambda w: _fixed(w, np.float32)), "block", "left")


def _expected(blocks: DataFrame, learned: Learned) -> DataFrame:
    """One pass' expected counts (key, block, at, g): a row for each block and own word of it, whose key is the word;
    and from each task those of the broadcast part, in chunks, with keys that no word equals and without block."""
    shared = blocks.sparkSession.sparkContext.broadcast(learned)  # a row a bucket and broadcast word

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names = None, ["key", "block", "at", "g"]
        dense = len(shared.value.model.emit)
        for b in _opened(batches, shared.value):
            counts = Counts.zero(len(b.model.emit))
            expect(b.model, [s for s, f in zip(b.sequences, b.flags.tolist(), strict=True) if f & 1], counts)
            fixed = np.rint(counts.emit[dense:] * _FIXED).astype(np.int64)
            block = np.full(len(b.own), b.row["block"][0].as_py(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b.words[i] for i in b.own.tolist()], pa.binary()), pa.array(block), pa.array(b.own.astype(np.int32)), _binary(fixed)], names)
            each = np.rint(np.vstack([counts.start, counts.move, counts.emit[:dense]]) * _FIXED).astype(np.int64)
            sums = each if sums is None else np.add(sums, each, out=sums)
            del b, counts, fixed, each  # before the next block is opened
        if sums is not None:
            parts = [sums[at : at + _CHUNK] for at in range(0, len(sums), _CHUNK)]
            keys = pa.array([b"\n%d" % k for k in range(len(parts))], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.nulls(len(parts), pa.int64()), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([_packed(x.ravel()) for x in parts], pa.binary())], names)

    return blocks.mapInArrow(partial, "key binary, block long, at int, g binary")


def _summed(rows: DataFrame, dense: int) -> tuple[DataFrame, str]:
    """From :func:`_expected`'s rows: (chunk, block, at, w), the word's weights for each block that has it; a row a chunk of the
    broadcast part (``dense`` rows), with its sums; and a row a task, with neither, that sums its words: ``at`` is their number."""
    size = STATES + 1 + dense

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: pa.Array, block: pa.Array, at: pa.Array, w: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([chunk, block, at, w], ["chunk", "block", "at", "w"])

        def made(sums: np.ndarray, blocks: list[np.ndarray], ats: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            weights = np.repeat((sums / _FIXED + 0.01).astype(np.float32), n, axis=0)
            return out(pa.nulls(len(weights), pa.int32()), pa.array(np.concatenate(blocks)), pa.array(np.concatenate(ats)), _binary(weights))

        word, sums, blocks, ats = None, None, [], []  # of the word that may go on in the next batch
        total, number, chunks = np.zeros(STATES, dtype=np.int64), 0, {}
        for batch in batches:
            of_chunk = batch.column(1).is_null()
            for k, packed in zip(*(batch.column(c).filter(of_chunk).to_pylist() for c in (2, 3)), strict=True):
                part = _unpacked(packed, np.int64, (min(size, (k + 1) * _CHUNK) - k * _CHUNK) * STATES)
                chunks[k] = chunks[k] + part if k in chunks else part
            batch = batch.filter(pa.compute.invert(of_chunk))
            if not batch.num_rows:
                continue
            g = _fixed(batch.column(3), np.int64)
            codes = batch.column(0).dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            each = np.add.reduceat(g, starts, axis=0)
            block, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            n = np.diff(np.concatenate([starts, [len(g)]]))
            total += g.sum(axis=0)
            skip = 0
            if word is not None and word == batch.column(0)[0].as_py():
                sums = sums + each[0]
                blocks.append(block[: n[0]])
                ats.append(at[: n[0]])
                skip = 1
            if len(starts) > skip:
                if word is not None:
                    yield made(sums[None], blocks, ats, np.array([sum(map(len, blocks))]))
                    number += 1
                if len(starts) - 1 > skip:
                    whole, first = slice(skip, len(starts) - 1), starts[skip]
                    yield made(each[whole], [block[first : starts[-1]]], [at[first : starts[-1]]], n[whole])
                    number += len(starts) - 1 - skip
                word, sums, blocks, ats = batch.column(0)[int(starts[-1])].as_py(), each[-1], [block[starts[-1] :]], [at[starts[-1] :]]
        if word is not None:
            yield made(sums[None], blocks, ats, np.array([sum(map(len, blocks))]))
            yield out(pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([number + 1], pa.int32()), _binary(total[None]))
        for k, part in chunks.items():
            yield out(pa.array([k], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part.tobytes()], pa.binary()))

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return common.stored(ordered.mapInArrow(run, "chunk int, block long, at int, w binary"), "hmm-rows")


def _learn(blocks: DataFrame, learned: Learned, iterations: int) -> tuple[Learned, DataFrame | None]:
    """The model after ``iterations`` passes over the learned texts, and the blocks' rows (block, at, w)."""
    spark, met, before = blocks.sparkSession, None, None
    dense = len(learned.model.emit)
    for _ in range(iterations):
        met, path = _summed(_expected(_with_rows(blocks, met), learned), dense)
        if before:
            common.removed(spark, before)
        before = path
        got = sorted((r["chunk"], r["w"]) for r in met.where("chunk IS NOT NULL").collect())  # a row a bucket and broadcast word
        flat = np.concatenate([np.frombuffer(w, dtype=np.int64) for _, w in got]).reshape(-1, STATES) / _FIXED if got else np.zeros((STATES + 1 + dense, STATES))
        counts = Counts(flat[0], flat[1 : STATES + 1], flat[STATES + 1 :])
        ends = [(r["at"], np.frombuffer(r["w"], dtype=np.int64)) for r in met.where("block IS NULL AND chunk IS NULL").collect()]  # a row a task
        others = sum((w / _FIXED + 0.01 * n for n, w in ends), np.zeros(STATES))
        weight = counts.emit.sum(axis=0) + 0.01 * dense
        model = counts.model()
        model.emit = model.emit * (weight / (weight + others))
        learned = Learned(model, learned.one, learned.words, weight + others)
        _free(spark)
    return learned, met


def _begin(start: tuple[Hmm, dict[bytes, int]], head: dict[bytes, int], of_bucket: dict[int, tuple[int, int]]) -> Learned:
    """Emission rows of buckets and head when each takes its share of its class: ``of_bucket`` has the training
    tokens of each bucket, all and rare ones."""
    model, classes = start
    rare = np.full(BUCKETS + 1, SMOOTH)
    for bucket, (_, c_rare) in of_bucket.items():
        rare[bucket] += c_rare
    one = model.emit[_class_of_bucket(np.arange(BUCKETS + 1))]
    one[END] = model.emit[-1] / SMOOTH
    out = Learned(model, one, {w: model.emit[k] for w, k in classes.items()})
    emit = np.vstack([one * rare[:, None], out.begin(list(head), np.array(list(head.values()), dtype=float))])
    return Learned(Hmm(model.start, model.move, emit), one, out.words)


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c) of every word in ``train`` (text)."""

    def made(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in common.slices(batches):
            for text in common.texts(batch):
                counts.update(tokens(text))
                if len(counts) > _FLUSH:
                    yield made(counts)
                    counts = Counter()
        if counts:
            yield made(counts)

    return train.select("text").mapInArrow(partial, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(word, c) of the most frequent words, at most ``most``: all those above a count.

    The count comes from a histogram with eight steps for each power of two (a few hundred rows).
    """
    step = F.floor(F.log2("c") * 8)
    taken, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        taken += r["n"]
        if taken > most:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least).select("word", "c")


@dataclass
class Fitted:
    """A model, the blocks of encoded texts and their rows, and the corpus' figures."""

    learned: Learned
    blocks: DataFrame
    met: DataFrame | None
    head: dict[bytes, int]
    bucket_size: np.ndarray
    ends: int
    n_train: int
    base_size: float


def fit(rows: DataFrame, head_words: int = HEAD, iterations: int = ITERATIONS) -> Fitted:
    """Learns from the rows (doc_id, text, learned, wanted) that are ``learned``."""
    train = rows.where("learned").select("text")
    counts, counts_path = common.stored(word_counts(train).withColumn("bucket", F.crc32("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), "hmm-counts")
    ends = train.count()
    rare = F.col("c") < OWN
    of_bucket = counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum(F.when(rare, F.col("c")).otherwise(0)).alias("c_rare"), F.count_if(rare).alias("v_rare")).collect()  # a row a bucket
    bucket_size = np.full(BUCKETS + 1, SMOOTH)
    for r in of_bucket:
        bucket_size[r["bucket"]] = r["c_rare"] + SMOOTH * (r["v_rare"] + 1)
    n_train = ends + sum(r["c"] for r in of_bucket)
    base_size = n_train + SMOOTH * (sum(r["v"] for r in of_bucket) + (ends > 0) + 1)
    frequent = _most_frequent(counts.where(~rare), head_words).collect()  # at most head_words rows
    head = {bytes(r["word"]): r["c"] for r in sorted(frequent, key=lambda r: (-r["c"], r["word"]))}
    learned = _begin(_initial(start_texts(train, counts)), head, {r["bucket"]: (r["c"], r["c_rare"]) for r in of_bucket})
    texts, texts_path = _blocks(rows, head)
    blocks = _counted(texts, counts)
    for path in (counts_path, texts_path):
        common.removed(rows.sparkSession, path)
    _free(rows.sparkSession)
    learned, met = _learn(blocks, learned, iterations)
    return Fitted(learned, blocks, met, head, bucket_size, ends, n_train, base_size)


def score(docs: DataFrame, train: DataFrame | str, head_words: int = HEAD, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``train`` is a table with texts to learn from, or a condition on ``docs`` that says which of its rows to learn from.
    """
    if isinstance(train, str):
        rows = docs.select("doc_id", "text", F.coalesce(F.expr(train), F.lit(False)).alias("learned"), F.lit(True).alias("wanted"))
    else:
        none = F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")
        rows = docs.select("doc_id", "text", F.lit(False).alias("learned"), F.lit(True).alias("wanted")).union(train.select(none, "text", F.lit(True), F.lit(False)))
    fitted = fit(rows, head_words, iterations)
    ends, n_train = fitted.ends, fitted.n_train
    log_head = np.log10(np.array(list(fitted.head.values()), dtype=float) + SMOOTH)
    shared = docs.sparkSession.sparkContext.broadcast((fitted.learned, log_head, np.log10(fitted.bucket_size)))
    log_base = math.log10(fitted.base_size)
    end_base = math.log10(ends + SMOOTH) - log_base
    kind = dict(docs.dtypes)["doc_id"]

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, log_head, log_bucket = shared.value
        zeros = np.zeros(BUCKETS + 1)
        for b in _opened(batches, learned):
            within = np.log10(b.counts + SMOOTH) - log_bucket[b.buckets]
            within[b.own] = 0.0
            starts = np.concatenate([[0], np.cumsum(b.lengths)[:-1]])
            wanted = np.flatnonzero(b.flags & 2)
            if not len(wanted):
                continue
            total_of = lambda local, head, b=b, starts=starts: np.add.reduceat(np.concatenate([zeros, head, local])[b.codes], starts)
            known = total_of((b.counts > 0).astype(float), np.ones(len(log_head))).astype(np.int64) + (ends > 0)
            base = total_of(np.log10(b.counts + SMOOTH), log_head) - (b.lengths - 1) * log_base + end_base
            scores = log_likelihoods(b.model, [b.sequences[i] for i in wanted]) + total_of(within, np.zeros(len(log_head)))[wanted]
            yield pa.RecordBatch.from_arrays([b.row["ids"].flatten(), pa.array(b.lengths[wanted].astype(np.int64)), pa.array(known[wanted]), pa.array(base[wanted]), pa.array(scores)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
            del b, total_of  # before the next block is opened

    out = _with_rows(fitted.blocks, fitted.met).mapInArrow(forward, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id):
    return common.fold_remainder(doc_id, 10) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 10 <> 0")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
