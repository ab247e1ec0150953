"""SimHash near-duplicates through deletion-variant signatures (operator 8).

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most
three bits, one of the segments differs in at most one, so leaving out that one bit makes the
segments equal. Each distinct fingerprint is therefore indexed under 2 x 32 keys (segment,
place left out, remaining 31 bits); equal keys are candidates, and each is verified on all 64 bits.

Exact copies collapse to one fingerprint before anything is joined. In a bucket, a breadth-first
search over the fingerprints not yet reached emits a spanning forest, never all pairs. A bucket
of more than :data:`HOT` fingerprints isn't gathered: its rows get 32 finer keys each (the other
segment's halves of 16 bits, one of which differs in at most one bit). A finer bucket fixes 46
bits, so it holds at most 2**18 fingerprints (2 MB) whatever the input.

Edge cases: null and empty texts and texts of only white space have fingerprint zero and are
linked like any other; fewer words than a shingle make one shingle; repeated rows get equal
results; rows with a null id are kept, and a component's id is the least id that isn't null (null
if there is none); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
HOT = 1 << 16
_BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased words' shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key_id, key_text and ``fp`` (the fingerprint as a signed bigint) for every row."""
    keyed = docs.select(docs["doc_id"], *common.row_key(docs["doc_id"], docs["text"]), docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            values = np.fromiter(map(fingerprint, common.texts(batch)), dtype=np.uint64, count=batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values)], ["doc_id", "key_id", "key_text", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return keyed.mapInArrow(run, f"doc_id {kind}, key_id string, key_text long, fp long")


def _forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct ``values``: (node, its root)."""
    left = values
    nodes, roots = [], []
    while len(left):
        root, left = left[0], left[1:]
        frontier = np.array([root], dtype=np.uint64)
        while len(frontier) and len(left):
            step = max(1, _BLOCK // len(left))
            now, frontier = frontier[:step], frontier[step:]
            near = (np.bitwise_count(left[None, :] ^ now[:, None]) <= max_bits).any(axis=0)
            if near.any():
                found, left = left[near], left[~near]
                nodes.append(found)
                roots.append(np.full(len(found), root, dtype=np.uint64))
                frontier = np.concatenate([frontier, found])
    empty = np.empty(0, dtype=np.uint64)
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (empty, empty)


def _any_link(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bits: int, most: int = 32) -> np.ndarray:
    """Of the runs [start, end): which have more than ``most`` members, or a link among them.

    Nearly all small runs are chance meetings; they are dismissed together, place by place.
    """
    size = ends - starts
    out = size > most
    run = np.repeat(np.arange(len(starts)), np.where(out, 0, size))
    values = fps[np.repeat(~out, size)].view(np.uint64)
    for k in range(1, int(size[~out].max(initial=1))):
        near = (run[k:] == run[:-k]) & (np.bitwise_count(values[k:] ^ values[:-k]) <= max_bits)
        out[run[k:][near]] = True
    return out


def _search(buckets: DataFrame, max_bits: int, hot: int) -> DataFrame:
    """From (key, fp): rows (a, b) of links, with key null, and rows (key, a) of too large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: pa.Array, a: np.ndarray, b: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array(a), b], ["key", "a", "b"])

        def links(groups: list[np.ndarray]) -> pa.RecordBatch:
            parts = [_forest(np.unique(g.view(np.uint64)), max_bits) for g in groups]
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*parts, strict=True))
            return made(pa.nulls(len(a), pa.int64()), a, pa.array(b))

        def passed(key: int, fps: np.ndarray) -> pa.RecordBatch:
            return made(pa.array(np.full(len(fps), key)), fps, pa.nulls(len(fps), pa.int64()))

        open_key, kept, over = None, [], False  # the bucket that may go on in the next batch
        for batch in batches:
            keys, fps = (np.array(batch.column(batch.schema.get_field_index(c))) for c in ("key", "fp"))
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            done: list[np.ndarray] = []
            if open_key is not None and open_key != keys[0]:
                done += [] if over else [np.concatenate(kept)]
                open_key, kept, over = None, [], False
            last = len(starts) - 1
            whole = np.flatnonzero((ends - starts > 1) & _any_link(fps, starts, ends, max_bits))
            for i in sorted({0, last, *whole.tolist()}):
                key, part = keys[starts[i]], fps[starts[i] : ends[i]]
                if i == 0 and open_key is not None:
                    kept.append(part)
                elif i == last:
                    open_key, kept, over = key, [part], False
                elif len(part) <= hot:
                    done.append(part)
                    continue
                else:
                    yield passed(key, part)
                    continue
                if over or sum(map(len, kept)) > hot:
                    yield passed(key, np.concatenate(kept))
                    kept, over = [], True
                if i == 0 and last > 0:
                    done += [] if over else [np.concatenate(kept)]
                    open_key, kept, over = None, [], False
            done = [g for g in done if len(g) > 1]
            if done:
                yield links(done)
        if open_key is not None and not over and sum(map(len, kept)) > 1:
            yield links([np.concatenate(kept)])

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect every component of the distinct fingerprints in ``fps`` (fp)."""
    if max_bits > 3:
        raise ValueError("two segments with one place left out cover at most three differing bits")
    one_out = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.shiftleft(i.cast("long"), 32).bitwiseOR(F.when(i < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i % 32)))),
    )
    first = common.checkpointed(_search(fps.select(F.explode(one_out).alias("key"), "fp"), max_bits, hot))
    edges = first.where("b IS NOT NULL").select("a", "b")
    large = first.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    # the segment that the key doesn't hold, in halves of 16 bits, one place left out of each
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    finer = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.shiftleft("key", 21)
        .bitwiseOR(F.shiftleft(i.cast("long"), 16))
        .bitwiseOR(F.when(i < 16, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16)).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i % 16)))),
    )
    second = _search(large.select("fp", F.explode(finer).alias("key")), max_bits, 1 << 18)
    return edges.union(second.where("b IS NOT NULL").select("a", "b"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, key_id, key_text, fp, root (the component's least fingerprint) and component_id for every row."""
    marked = common.checkpointed(fingerprints(docs))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the distinct fingerprints are few bytes, but make 64 keys each
    roots = components(links(marked.select("fp").distinct().repartition(tasks), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return marked.join(of_fp, "fp")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the least id's; rows equal in id and text, once.

    What stays is decided without the texts, which are then shuffled once; equal rows are brought
    together on the way to that shuffle.
    """
    found = near_duplicates(docs, max_bits)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_id", "key_text")).alias("k")
    names = [common.unused(docs, "key_id"), common.unused(docs, "key_text")]
    keep = found.groupBy("root").agg(least).select(F.col("k.key_id").alias(names[0]), F.col("k.key_text").alias(names[1]))
    keyed = docs.withColumns(dict(zip(names, common.row_key(docs["doc_id"], docs["text"]), strict=True)))
    return keyed.dropDuplicates(names).join(keep, names, "left_semi").drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
