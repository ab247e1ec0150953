"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

A benchmark item is contained in a document if at least ``threshold`` of its distinct five-word
shingles occur there. Items are partitioned by size: a :class:`Partition` holds those with more
than u / 2 and up to u shingles, u a power of two. Each partition has its own banding, chosen from
u: an item's MinHash signature is its shingles of smallest hash, dealt to b bands of r, where b is
one more than the shingles that a contained item of u can lack, and r as large as the smallest
item of the partition allows. One band of a contained item is therefore whole in the document, so
recall is complete and not estimated. A document's signature in a partition is all its shingle
hashes up to the partition's largest one (a MinHash of a fixed rate, not a fixed length, which a
book would drown); a band that it holds wholly makes a candidate. Each candidate pair is verified
by exact shingle containment, on the shingles' words and not their hashes.

The items are taken in blocks of at most :data:`BLOCK_SHINGLES` words, each broadcast to one pass
over the documents; more items make more blocks. An item longer than a block isn't broadcast: only
documents nearly as long can contain it, and those meet it in a join of shingles.

Words are split at ASCII white space, lower-cased (A-Z) and freed of ASCII punctuation at both
ends; words of punctuation alone are dropped.

Edge cases: null and empty texts match nothing, nor do items without a word; an item of fewer
than five words is one shingle of all its words; repeated documents give the same pairs again, repeated items count once; rows
with null ids are searched; extra columns are ignored by :func:`search` and kept by
:func:`without_leaks`; an empty table of either kind gives no pairs.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 200_000
_PUNCTUATION = string.punctuation.encode()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return [w for w in (x.strip(_PUNCTUATION) for x in words) if w]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word."""
    low, high = (np.fromiter(map(crc32, words, repeat(seed)), dtype=np.uint64, count=len(words)) for seed in (0, 0x5BD1E995))
    return _mixed(low | high << np.uint64(32))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words, from the words' hashes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * _STEP + codes[j : j + n]
    return _mixed(out)


def lacking(shingles: int, threshold: float) -> int:
    """How many of its shingles a contained item lacks at most."""
    return shingles - math.ceil(threshold * shingles - 1e-9)


def upper_size(shingles: int) -> int:
    return 1 << (shingles - 1).bit_length()


def banding(upper: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) of the partition of items with upper / 2 < shingles <= upper."""
    bands = lacking(upper, threshold) + 1
    return bands, max(1, (upper // 2 + 1) // bands)


class Partition:
    """The signatures of items of one size class, by band; ``items`` are (number, distinct hashes)."""

    def __init__(self, upper: int, items: list[tuple[int, list[int]]], threshold: float):
        self.bands, self.rows = banding(upper, threshold)
        at: dict[int, list[int]] = defaultdict(list)
        self.item_of, self.rows_of = [], []
        for item, hashes in items:
            signature = sorted(hashes)[: self.bands * self.rows]
            for band in range(min(self.bands, len(signature))):
                part = signature[band :: self.bands]
                for h in part:
                    at[h].append(len(self.item_of))
                self.item_of.append(item)
                self.rows_of.append(len(part))
        self.item_of, self.rows_of = np.array(self.item_of), np.array(self.rows_of)
        self.hashes = np.array(sorted(at), dtype=np.uint64)
        self.held_by = [np.array(at[h]) for h in sorted(at)]

    def candidates(self, have: np.ndarray) -> set[int]:
        """Items with a band that lies wholly in ``have``, a document's distinct hashes."""
        signature = have[have <= self.hashes[-1]]  # so no place is past the end
        place = np.searchsorted(self.hashes, signature)
        met = place[self.hashes[place] == signature]
        if not len(met):
            return set()
        bands, rows = np.unique(np.concatenate([self.held_by[p] for p in met]), return_counts=True)
        return set(self.item_of[bands[rows == self.rows_of[bands]]].tolist())


class Block:
    """Some items in their partitions. Small enough to broadcast."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items: list[tuple[int, int, frozenset[tuple[bytes, ...]]]] = []
        sized: dict[tuple[int, int], list[tuple[int, list[int]]]] = defaultdict(list)
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            size = min(shingle, len(words))
            grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            hashes = {int(window_hashes(word_hashes(list(g)), size)[0]) for g in grams}
            sized[size, upper_size(len(grams))].append((len(self.items), list(hashes)))
            self.items.append((item_id, size, frozenset(grams)))
        self.partitions: dict[int, list[Partition]] = defaultdict(list)
        for (size, upper), members in sorted(sized.items()):
            self.partitions[size].append(Partition(upper, members, threshold))
        self.any = {size: np.unique(np.concatenate([p.hashes for p in parts])) for size, parts in self.partitions.items()}

    def search(self, words: list[bytes], codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, item's shingles, shared shingles) of the items contained in the words."""
        candidates: set[int] = set()
        for size, parts in self.partitions.items():
            have, known = window_hashes(codes, size), self.any[size]
            place = np.minimum(np.searchsorted(known, have), len(known) - 1)
            have = np.unique(have[known[place] == have])  # most documents have none
            if len(have):
                candidates.update(*(p.candidates(have) for p in parts))
        out, grams = [], {}
        for c in sorted(candidates):
            item_id, size, own = self.items[c]
            if size not in grams:
                grams[size] = set(zip(*(words[i:] for i in range(size)), strict=False))
            shared = len(own & grams[size])
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((item_id, len(own), shared))
        return out


def _size(text: str | None) -> int:
    """Words that a text has at most."""
    return len(text or "") // 2 + 1


def blocks(benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> Iterator[Block]:
    """The benchmark's items in blocks, read one partition at a time, but for those longer than a block."""
    part: list[tuple[int, str]] = []
    size = 0
    items = benchmark.select("item_id", "text").distinct().where(~_long(F.col("text")))
    for row in items.orderBy("item_id", "text").toLocalIterator():
        n = _size(row["text"])
        if part and size + n > BLOCK_SHINGLES:
            yield Block(part, shingle, threshold)
            part, size = [], 0
        part.append((row["item_id"], row["text"] or ""))
        size += n
    if part:
        yield Block(part, shingle, threshold)


def _long(text: Column) -> Column:
    """The texts of more than a block's words: by :func:`_size`, which counts code points."""
    return F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 2) + 1 > BLOCK_SHINGLES


def _shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, gram) of each distinct shingle of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            words = normal_words(common.texts(batch)[0])
            size = min(shingle, len(words))
            grams = sorted({b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}) if words else []
            row = pa.array(np.full(len(grams), batch.column(0)[0].as_py(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([row, pa.array(grams, pa.binary())], ["row", "gram"])

    return texts.select("row", "text").mapInArrow(run, "row long, gram binary")


def _long_found(docs: DataFrame, benchmark: DataFrame, shingle: int, threshold: float) -> DataFrame | None:
    """(doc_id, key_id, key_text, item_id, item_shingles, shared) for the items longer than a block; None without any.

    A document that contains such an item has ``threshold`` of its shingles, so shorter ones are left out.
    """
    long = benchmark.select("item_id", "text").distinct().where(_long(F.col("text")))
    if long.isEmpty():
        return None
    items = common.checkpointed(long.withColumn("row", F.monotonically_increasing_id()))
    grams = common.checkpointed(_shingles(items, shingle))
    sizes = items.join(grams.groupBy("row").agg(F.count("*").alias("n")), "row").select(F.col("row").alias("item_row"), "item_id", "n")
    least = sizes.agg(F.coalesce(F.min("n"), F.lit(0))).first()[0] * threshold
    key = ["key_id", "key_text"]
    rows = docs.where(F.char_length("text") >= least).select("doc_id", "text", *common.row_key(docs["doc_id"], docs["text"]))
    rows = common.checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    met = _shingles(rows, shingle).join(grams.withColumnRenamed("row", "item_row"), "gram").groupBy("row", "item_row").agg(F.count("*").alias("shared"))
    found = met.join(sizes, "item_row").where(F.col("shared") >= threshold * F.col("n") - 1e-9).join(rows, "row")
    return found.select("doc_id", *key, F.col("item_id").cast("long").alias("item_id"), F.col("n").cast("int").alias("item_shingles"), F.col("shared").cast("int").alias("shared"))


def _found(batch: pa.RecordBatch, block: Block) -> list[list[tuple[int, int, int]]]:
    each = (normal_words(text) for text in common.texts(batch))
    return [block.search(words, word_hashes(words)) if words else [] for words in each]


def search(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment), a row for each contained item."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, item_shingles int, shared int"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, shingle, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                hits = [(row, *hit) for row, found in enumerate(_found(batch, shared.value)) for hit in found]
                if hits:
                    row, item, size, both = zip(*hits, strict=True)
                    ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row))
                    columns = [ids, pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(both, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "item_shingles", "shared"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    long = _long_found(docs, benchmark, shingle, threshold)
    if long is not None:
        out = out.union(long.drop("key_id", "key_text"))
    return out.selectExpr("*", "CAST(shared AS DOUBLE) / item_shingles AS containment")


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the rows that contain an item, in one narrow pass a block (and a join for items longer than one)."""
    for block in blocks(benchmark, shingle, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                yield batch.filter(pa.array([not found for found in _found(batch, shared.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    long = _long_found(docs, benchmark, shingle, threshold)
    if long is None:
        return docs
    key_id, key_text = common.row_key(docs["doc_id"], docs["text"])
    leaks = long.select("key_id", "key_text").distinct()
    return docs.join(leaks, (key_id == leaks["key_id"]) & (key_text == leaks["key_text"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TRIM = r"regexp_replace(lower_az, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')"
_WORDS = r"list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda lower_az: " + _TRIM + "), lambda x: x <> '')"
SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ig AS (SELECT item_id, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
       FROM (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0)),
iu AS (SELECT item_id, k, len(g) AS n, unnest(g) AS s FROM ig),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT DISTINCT k FROM iu),
du AS (SELECT DISTINCT rid, doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k))
SELECT doc_id, item_id, n::INTEGER AS item_shingles, count(*)::INTEGER AS shared, count(*)::DOUBLE / n AS containment
FROM du JOIN iu USING (k, s) GROUP BY rid, doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""
