"""Counts of n-grams of several orders by one shuffle of their longest windows.

A window is a token with up to ``max_n - 1`` tokens behind it. All windows that begin with the same two tokens go to one partition,
so every n-gram of order 2 or more is counted whole there, in all its buckets; tokens by themselves go there as windows of one,
summed before. A task sends those that it has for one partition as one compressed block, sorted and column by column: a fraction of
the windows' text. Within a partition tokens are numbered in order, so that an n-gram's windows lie together; keys are integers,
compared exactly, and strings are made for what is returned only. It is returned as it lies, each n-gram behind the one that it
continues, which a file's compression then has before it. Tokens are not empty and have no space in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pruning import Pruning

#: Texts whose tokens are numbered at once, and rows that are sent back at once.
_TEXTS, _ROWS = 512, 1 << 16
#: Tokens of which a task makes blocks, held as numbers: the more, the better blocks are compressed.
_TOKENS = 1 << 23
#: Windows that are made of them at once.
_WINDOWS = 1 << 20
#: Rows that a partition gathers before equal ones are summed: few partitions have more.
_GATHERED = 1 << 22
_SPACE = pa.scalar(" ", pa.large_string())


@dataclass
class _Windows:
    """Windows as columns of numbers of ``words`` (in order, the first one empty: no token) and of ``kept``; ``c``: how often each is there."""

    words: pa.Array
    kept: list[pa.Array]
    tokens: list[np.ndarray]
    keep: list[np.ndarray]
    c: np.ndarray


def _summed(columns: list[np.ndarray], values: list[int], c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows in order, equal ones as one with the sum of ``c``. ``values``: how many each column may have, from 0 on."""
    keys, room = [], 0
    for column, of in zip(columns, values, strict=True):
        if keys and room * of < 1 << 62:
            keys[-1] = keys[-1] * of + column
            room *= of
        else:
            keys.append(column.astype(np.int64))
            room = of
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    at = order[first]
    return [column[at] for column in columns], np.add.reduceat(c[order], first) if len(first) else c[:0]


def _codes(arrays: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """All distinct values, null too, and for each array its values' numbers."""
    encoded = pa.concat_arrays(arrays).dictionary_encode("encode")
    return encoded.dictionary, np.split(encoded.indices.to_numpy(), np.cumsum([len(a) for a in arrays])[:-1])


def _ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """In order, and each one's place in it."""
    order = pc.array_sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), place


def _joined(parts: list[_Windows]) -> _Windows:
    """Of several with words of their own, summed."""
    words, numbers = _codes([pa.array([""], pa.large_string()), *(p.words for p in parts)])
    words, place = _ordered(words)
    columns, kept = [np.concatenate([place[n][p.tokens[i]] for n, p in zip(numbers[1:], parts, strict=True)]) for i in range(len(parts[0].tokens))], []
    for k in range(len(parts[0].kept)):
        values, numbers = _codes([p.kept[k] for p in parts])
        kept.append(values)
        columns.append(np.concatenate([n[p.keep[k]] for n, p in zip(numbers, parts, strict=True)]))
    of = len(parts[0].tokens)
    columns, c = _summed(columns, [len(words)] * of + [len(v) for v in kept], np.concatenate([p.c for p in parts]))
    return _Windows(words, kept, columns[:of], columns[of:], c)


def _sent(rows: pa.Table, text: str) -> Iterator[pa.RecordBatch]:
    """In batches whose texts have the type that Spark reads."""
    at = rows.column_names.index(text)
    for batch in rows.to_batches(_ROWS):
        yield batch.set_column(at, text, batch.column(at).cast(pa.string()))


# ---------------------------------------------------------------- blocks


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=9)


def _narrow(values: np.ndarray) -> bytes:
    """Integers from 0 on in as few bytes as the largest needs: how many those are, then all first bytes, all second ones and so on."""
    size = max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([size]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _wide(block: memoryview, at: int, of: int) -> tuple[np.ndarray, int]:
    size, out = block[at], np.zeros((of, 8), np.uint8)
    out[:, :size] = np.frombuffer(block, np.uint8, of * size, at + 1).reshape(size, of).T
    return out.view("<i8").ravel(), at + 1 + of * size


def _packed(words: np.ndarray, tokens: list[np.ndarray], keep: list[np.ndarray], c: np.ndarray) -> bytes:
    """How many windows and bytes of text, the text of all first tokens, all second ones and so on, the other numbers."""
    text = " ".join(words[np.concatenate(tokens)].tolist()).encode()
    return b"".join([np.array([len(c), len(text)], "<i8").tobytes(), text, *map(_narrow, (*keep, c))])


def _unpacked(block: memoryview, max_n: int, kept: list[pa.Array]) -> _Windows:
    (rows, size), columns = np.frombuffer(block, "<i8", 2).tolist(), []
    words = pc.split_pattern(pa.array([bytes(block[16 : 16 + size]).decode()], pa.large_string()), " ").flatten().dictionary_encode()
    at = 16 + size
    for _ in range(len(kept) + 1):
        column, at = _wide(block, at, rows)
        columns.append(column)
    return _Windows(words.dictionary, kept, list(words.indices.to_numpy().reshape(max_n, rows)), columns[:-1], columns[-1])


# ---------------------------------------------------------------- both sides of the shuffle


def _partition(first: np.ndarray, second: np.ndarray | int, of: int) -> np.ndarray:
    """By hashes of the first two tokens."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29)) ^ second) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(20)) % np.uint64(of)).astype(np.int32)


def _cut(max_n: int, keep: tuple[str, ...], keys: np.ndarray | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts' tokens into blocks (key, size, block, keep) of their windows, equal ones of some texts summed. ``keys``: one for each partition."""
    keys = np.zeros(1, np.int64) if keys is None else keys

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        key, size, block, *values = zip(*made, strict=True)
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, v)]), pa.int32()), pa.concat_arrays(v)) for v in values]
        return pa.record_batch([pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(block, pa.binary()), *lists], names=["key", "size", "block", *keep])

    def blocks(numbers: dict[str, int], token: np.ndarray, behind: np.ndarray, kept: list[pa.Array], keeping: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """``behind``: how many tokens of its text are behind a token, ``max_n - 1`` at most."""
        words, place = _ordered(pa.array(["", *numbers], pa.large_string()))
        words = np.array(words.to_pylist(), object)
        hashed = np.array([zlib.crc32(t.encode()) for t in words], np.uint64)
        hashed[0] = 1 << 33
        token = place[token]

        def one_of(at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            return _summed([token[at], *(k[at] for k in keeping)], [len(words), *map(len, kept)], np.ones(len(at), np.int64))

        to = np.empty(len(token), np.int32)
        for s in range(0, len(token), _WINDOWS):
            e = min(s + _WINDOWS, len(token))
            second = token[np.minimum(np.arange(s, e) + 1, len(token) - 1)]
            to[s:e] = _partition(hashed[token[s:e]], hashed[np.where(behind[s:e] > 0, second, 0)], len(keys))
        single = [one_of(np.flatnonzero(behind[s : s + _WINDOWS]) + s) for s in range(0, len(token), _WINDOWS)]  # the others are windows of one as they are
        one, many = _summed([np.concatenate(x) for x in zip(*(columns for columns, _ in single), strict=True)], [len(words), *map(len, kept)], np.concatenate([c for _, c in single]))
        del single
        to_one = _partition(hashed[one[0]], hashed[0], len(keys))
        several = np.cumsum(np.bincount(to, minlength=len(keys)))
        codec, out, a = _codec(), [], 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(several, (several[a - 1] if a else 0) + _WINDOWS, "right")))
            at, at_one = np.flatnonzero((to >= a) & (to < b)), np.flatnonzero((to_one >= a) & (to_one < b))
            a = b
            if not len(at) + len(at_one):
                continue
            tokens = [np.concatenate([np.where(behind[at] >= k, token[np.minimum(at + k, len(token) - 1)], 0), one[0][at_one] if k == 0 else np.zeros(len(at_one), np.int32)]) for k in range(max_n)]
            ours = [np.concatenate([k[at], o[at_one]]) for k, o in zip(keeping, one[1:], strict=True)]
            columns = [np.concatenate([to[at], to_one[at_one]]), *tokens, *ours]
            (part, *columns), c = _summed(columns, [len(keys), *[len(words)] * max_n, *map(len, kept)], np.concatenate([np.ones(len(at), np.int64), many[at_one]]))
            start = 0
            for end in [*np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]:
                own = [np.unique(k[start:end], return_inverse=True) for k in columns[max_n:]]
                raw = _packed(words, [t[start:end] for t in columns[:max_n]], [number for _, number in own], c[start:end])
                out.append((keys[part[start]], len(raw), codec.compress(raw, asbytes=True), *(values.take(pa.array(of)) for values, (of, _) in zip(kept, own, strict=True))))
                start = end
            yield batch_of(out)
            out = []

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tokens, behind, kept, texts, waiting = {}, [], [], [], [], 0

        def made() -> Iterator[pa.RecordBatch]:
            encoded = [_codes([k[i] for k in kept]) for i in range(len(keep))]
            keeping = [np.concatenate([n[t] for n, t in zip(number, texts, strict=True)]) for _, number in encoded]
            return blocks(numbers, np.concatenate(tokens), np.concatenate(behind), [values for values, _ in encoded], keeping)

        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                lists = part.column("tokens").cast(pa.list_(pa.large_string()))
                encoded, text = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
                if not len(text):
                    continue
                number = np.array([numbers.setdefault(t, len(numbers) + 1) for t in encoded.dictionary.to_pylist()], np.int32)
                tokens.append(number[encoded.indices.to_numpy()])
                behind.append(np.minimum(np.searchsorted(text, text, "right") - np.arange(1, len(text) + 1), max_n - 1).astype(np.int8))
                if keep:
                    kept.append([part.column(k) for k in keep])
                    texts.append(text.astype(np.int16))
                waiting += len(text)
                if waiting >= _TOKENS:
                    yield from made()
                    numbers, tokens, behind, kept, texts, waiting = {}, [], [], [], [], 0
        if tokens:
            yield from made()

    return rows


def _count(max_n: int, keep: tuple[str, ...], least: dict[int, tuple[int, int]] | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keep, n, ngram, count) of a partition's windows. ``least``: by order, the least sum over all of ``keep`` (orders from 2 on)
    and the least count; what has less, and orders that it lacks, are left out."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, waiting, summed, codec = [], 0, 0, _codec()
        for batch in batches:
            for i in range(batch.num_rows):
                block = codec.decompress(batch.column("block")[i].as_buffer(), batch.column("size")[i].as_py())
                gathered.append(_unpacked(memoryview(block), max_n, [batch.column(k)[i].values for k in keep]))
                waiting += len(gathered[-1].c)
                if waiting >= max(_GATHERED, summed):
                    gathered, waiting = [_joined(gathered)], 0
                    summed = len(gathered[0].c)
        if not gathered:
            return
        w = _joined(gathered)
        del gathered
        alone = w.tokens[1] == 0 if max_n > 1 else np.ones(len(w.c), bool)
        found = []
        for n in range(1, max_n + 1):
            row = np.flatnonzero(alone if n == 1 else w.tokens[n - 1])
            if not len(row) or least is not None and n not in least:
                continue
            new = np.zeros(len(row), bool)
            new[0] = True
            for t in w.tokens[:n]:
                t = t[row]
                new[1:] |= t[1:] != t[:-1]
            gram, c = np.cumsum(new) - 1, w.c[row]
            if least is not None and n > 1:
                chosen = (np.add.reduceat(c, np.flatnonzero(new)) >= least[n][0])[gram]
                row, gram, c = row[chosen], gram[chosen], c[chosen]
                if not len(row):
                    continue
            for number, values in zip(w.keep, w.kept, strict=True):
                gram = gram * len(values) + number[row]
            if keep:
                order = np.argsort(gram, kind="stable")
                gram, row, c = gram[order], row[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            at, count = row[first], np.add.reduceat(c, first)
            if least is not None:
                enough = count >= least[n][1]
                at, count = at[enough], count[enough]
            found.append((at, np.full(len(at), n, np.int8), count))
        if not found:
            return
        at, order_of, count = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(at * (max_n + 1) + order_of)
        for s in range(0, len(order), _ROWS):
            some = order[s : s + _ROWS]
            row, n = at[some], order_of[some]
            tokens = [w.words.take(pa.array(t[row], mask=n <= i)) for i, t in enumerate(w.tokens)]
            ngrams = pc.binary_join_element_wise(*tokens, _SPACE, null_handling="skip")
            columns = [values.take(pa.array(number[row])) for number, values in zip(w.keep, w.kept, strict=True)]
            yield from _sent(pa.table([*columns, pa.array(n), ngrams, pa.array(count[some])], names=[*keep, "n", "ngram", "count"]), "ngram")

    return rows


def _keys(spark: SparkSession, partitions: int) -> np.ndarray:
    """For (nearly) each of the partitions, a key that is dealt to it, so that they are filled evenly. Any keys would give the same counts."""
    ids = spark.range(16 * partitions)
    return np.array([r[0] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(partitions))).agg(F.min("id")).select("min(id)").collect()], np.int64)


def window_counts(texts: DataFrame, max_n: int, *keep: str, partitions: int, pruning: Pruning | None = None) -> DataFrame:
    """(keep, n, ngram, count) of orders 1 to ``max_n``, all occurrences counted. With ``pruning``, those that fill their bucket,
    and of orders from 2 on those that are admitted by their sum over all buckets: :func:`.pruning.filtered_counts` of them."""
    of = dict(texts.select(*keep).dtypes)
    lists, types = "".join(f", {c} array<{t}>" for c, t in of.items()), "".join(f"{c} {t}, " for c, t in of.items())
    least = None if pruning is None else {n: (t.min_global, t.min_bucket) for n, t in pruning.thresholds.items()}
    cut = texts.select(*keep, "tokens").mapInArrow(_cut(max_n, keep, _keys(texts.sparkSession, partitions)), f"key long, size long, block binary{lists}")
    dealt = cut.repartition(partitions, "key")
    return dealt.mapInArrow(_count(max_n, keep, least), f"{types}n byte, ngram string, count long")
