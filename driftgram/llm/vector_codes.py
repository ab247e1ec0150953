"""Product-quantized codes of vectors by Hamerly's form of Lloyd's algorithm (operator 11).

A vector's components become integers, floor(scale * x), and it is cut into equal consecutive parts.
Each part position has a codebook of at most 256 entries, which begins as that part of the vectors of
least id; each round assigns every part to its nearest entry and replaces the entries by the floors of
their parts' means.

Between rounds a part keeps its entry and two numbers: an upper bound of the distance to that entry and
a lower bound of the distance to the second nearest. An update moves the bounds by as much as the entries
have moved, rounded outwards. A part whose upper bound is strictly below its lower bound, or below half
the way from its entry to the next one, stays where it is; if not, its distance is computed, and if the
bounds still fail, all entries are scanned in integers. Equal distances never pass a strict bound, so
they are always settled by the scan, in favour of the lower index: the codes are those of plain Lloyd.

A round is one pass: tasks read vectors with their bounds and write them with new ones, and beside them
their sums for each entry. Only those sums, a row a part and entry, come to the driver.

Edge cases: a vector that is null, or holds a null or non-finite component, is dropped. The others must
have one length that the parts divide, and components of absolute value below 2**17 (so that all
distances are exact in 64 bits); anything else is an error. Null ids come last among ids; vectors of
equal id are ordered by their components, and rows that repeat a vector count each. With fewer vectors
than entries the codebooks are smaller, and an empty table gives an empty result. Null labels are one
label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 17
#: Vectors in a task's hands at a time.
SLICE = 4096


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


@dataclass
class Codebooks:
    """``entries`` (part, entry, component) in integers; ``scans`` has each pass's number of full scans."""

    entries: np.ndarray
    scans: list[int]

    def sha256(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass(frozen=True)
class _Round:
    """What a pass needs of the codebooks: the entries, how far each has moved since the last pass (rounded up),
    the most that another than it has moved, and half the way to the nearest other entry (rounded down)."""

    entries: np.ndarray
    moved: np.ndarray | None
    most: np.ndarray | None
    half: np.ndarray


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows x entries), exact: doubles where all sums stay below 2**53, or else 64-bit integers."""
    bound = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if bound * bound * 4 * max(1, rows.shape[1]) < 1 << 52 else np.int64
    a, b = rows.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def _to_own(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((rows - own) ** 2).sum(axis=1)


def _round(entries: np.ndarray, before: np.ndarray | None) -> _Round:
    parts, k = entries.shape[:2]
    half = np.full((parts, k), np.inf)
    for p in range(parts):
        if k > 1:
            apart = squares(entries[p], entries[p])
            np.fill_diagonal(apart, np.iinfo(np.int64).max)
            half[p] = _down(_down(np.sqrt(apart.min(axis=1))) / 2)
    if before is None:
        return _Round(entries, None, None, half)
    moved = np.stack([_up(np.sqrt(_to_own(entries[p], before[p]))) for p in range(parts)]) * (entries != before).any(axis=2)
    order = np.sort(moved, axis=1)
    top, next_top = order[:, -1:], order[:, -2:-1] if k > 1 else order[:, -1:] * 0
    return _Round(entries, moved, np.where((moved == top) & ((moved == top).sum(axis=1, keepdims=True) == 1), next_top, top), half)


def assign(x: np.ndarray, r: _Round, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds (rows x parts) of the next pass, and how many parts were scanned. ``code`` is None in the first pass."""
    parts, k, width = r.entries.shape
    first = code is None
    code = np.zeros((len(x), parts), dtype=np.int64) if first else code.copy()
    upper, lower = (np.full(code.shape, np.inf), np.zeros(code.shape)) if first else (upper.copy(), lower.copy())
    scans = 0
    for p in range(parts):
        rows, own = x[:, p * width : (p + 1) * width], code[:, p]
        if not first:
            upper[:, p] = np.where(r.moved[p][own] > 0, _up(upper[:, p] + r.moved[p][own]), upper[:, p])
            lower[:, p] = np.where(r.most[p][own] > 0, _down(lower[:, p] - r.most[p][own]), lower[:, p])
        stays = lambda at, p=p: upper[at, p] < np.maximum(lower[at, p], r.half[p][code[at, p]])
        open_ = np.flatnonzero(~stays(slice(None)))
        if not first and len(open_):
            upper[open_, p] = _up(np.sqrt(_to_own(rows[open_], r.entries[p][own[open_]])))
            open_ = open_[~stays(open_)]
        if len(open_):
            scans += len(open_)
            apart = squares(rows[open_], r.entries[p])
            best = apart.argmin(axis=1)  # the lower index of equal ones
            at = np.arange(len(open_))
            code[open_, p], upper[open_, p] = best, _up(np.sqrt(apart[at, best]))
            apart[at, best] = np.iinfo(np.int64).max
            lower[open_, p] = _down(np.sqrt(apart.min(axis=1))) if k > 1 else np.inf
    return code, upper, lower, scans


def integers(vectors: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, label, x: array<int>) of the vectors that are kept."""
    value = F.col("embedding")
    finite = value.isNotNull() & ~F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: F.floor(c.cast("double") * s.scale)
    checked = F.transform(value, lambda c: F.when(F.abs(c) < LIMIT, scaled(c)).otherwise(F.raise_error(F.lit(f"a component isn't below {LIMIT}"))).cast("int"))
    return vectors.where(finite).select("vec_id", "label", checked.alias("x"))


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    if len(column.flatten()) != width * len(column) or not (column.value_lengths().to_numpy(zero_copy_only=False) == width).all():
        raise ValueError(f"vectors must all have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


_STATE = "vec_id {id}, label {label}, x array<int>, code array<int>, upper array<double>, lower array<double>"
_SUMS = "part int, entry int, rows bigint, sums array<bigint>, scans bigint"


def _pass(rows: DataFrame, r: _Round, path: str, columns: str, first: bool) -> None:
    """Writes rows with their new state below ``path``/kind=0 and the tasks' sums below kind=1."""
    parts, k, width = r.entries.shape
    names = ["vec_id", "label", "x", "code", "upper", "lower", "part", "entry", "rows", "sums", "scans", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, number, scans, kinds = np.zeros((parts, k, width), dtype=np.int64), np.zeros((parts, k), dtype=np.int64), 0, None
        for batch in common.slices(batches, SLICE):
            x = _matrix(batch, "x", parts * width, np.int64)
            state = (None, None, None) if first else (_matrix(batch, n, parts, t) for n, t in (("code", np.int64), ("upper", np.float64), ("lower", np.float64)))
            code, upper, lower, scanned = assign(x, r, *state)
            scans += scanned
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p * width : (p + 1) * width])
                number[p] += np.bincount(code[:, p], minlength=k)
            kinds = [batch.column(0).type, batch.column(1).type]
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), *none, pa.array(np.zeros(len(x), dtype=np.int32))], names)
        if kinds:
            p, e = (a.ravel() for a in np.meshgrid(np.arange(parts), np.arange(k), indexing="ij"))
            none = [pa.nulls(len(p), t) for t in (*kinds, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))]
            told = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(number.ravel()), _lists(sums.reshape(parts * k, width), pa.int64()), pa.array([scans] + [0] * (len(p) - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, *told, pa.array(np.ones(len(p), dtype=np.int32))], names)

    rows.mapInArrow(run, f"{columns}, {_SUMS}, kind int").write.option("compression", "zstd").partitionBy("kind").parquet(path)


def train(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, Codebooks, list[str]]:
    """Assigned vectors (vec_id, label, x, code), the final codebooks, and the written tables that the rows still read."""
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    columns = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    rows, source = common.stored(integers(vectors, s), "vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(s.entries).select("x").collect()  # at most 256 vectors
    if not start:
        return spark.createDataFrame([], columns), Codebooks(np.zeros((s.parts, 0, 0), dtype=np.int64), []), [source]
    length = len(start[0]["x"])
    if length % s.parts or any(len(r["x"]) != length for r in start):
        raise ValueError(f"vectors must have one length that {s.parts} parts divide")
    entries = np.array([r["x"] for r in start], dtype=np.int64).reshape(len(start), s.parts, length // s.parts).transpose(1, 0, 2).copy()
    books, before, former = Codebooks(entries, []), None, source
    for number in range(s.rounds + 1):
        path = common.new_path(spark, "vectors")
        _pass(rows, _round(books.entries, before), path, columns, first=number == 0)
        rows = spark.read.schema(columns).parquet(f"{path}/kind=0")
        told = spark.read.schema(_SUMS).parquet(f"{path}/kind=1").select("part", "entry", "rows", "scans", F.posexplode("sums")) if length else None
        common.removed(spark, former)
        former = path
        if told is None:
            continue
        totals = told.groupBy("part", "entry", "pos").agg(F.sum("col").alias("total"), F.sum("rows").alias("rows"), F.sum("scans").alias("scans")).collect()  # a row an entry's component
        books.scans.append(sum(t["scans"] for t in totals if t["pos"] == 0))
        if number < s.rounds:
            before, books.entries = books.entries, books.entries.copy()
            for t in totals:
                if t["rows"]:
                    books.entries[t["part"], t["entry"], t["pos"]] = t["total"] // t["rows"]
    return rows, books, [former]


def compress(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code: string of two hex digits a part, error) of every kept vector, and the codebooks."""
    rows, books, _ = train(vectors, s)
    entries = books.entries
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = entries.shape
        for batch in common.slices(batches, SLICE):
            x, code = _matrix(batch, "x", parts * width, np.int64), _matrix(batch, "code", parts, np.int64)
            error = sum(_to_own(x[:, p * width : (p + 1) * width], entries[p][code[:, p]]) for p in range(parts))
            text = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), books


def decoded(codes: DataFrame, books: Codebooks, s: Settings = Settings()) -> DataFrame:
    """``codes`` with ``approximation``, the entries' components over the scale: what a code stands for."""
    entries = books.entries
    book = F.array(*(F.array(*(F.array(*map(F.lit, e.tolist())) for e in part)) for part in entries))
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    whole = F.flatten(F.array(*(F.element_at(F.get(book, F.lit(p)), at(p)) for p in range(entries.shape[0]))))
    return codes.withColumn("approximation", F.transform(whole, lambda c: c / s.scale))


def query(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(common.table(spark, sf_dir, "embeddings"))
    codes, _ = common.stored(codes, "codes")
    by_label, _ = common.stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "codes")
    rows = common.with_groups(codes, by_label, "label", "rows")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql(s: Settings = Settings(), width: int = 16) -> str:
    """Plain Lloyd in SQL: a table of parts, then an assignment and an update a round, written out."""
    parts = f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {s.scale})) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT rid, p, x[p * {width} + 1:(p + 1) * {width}] AS x FROM kept, range({s.parts}) AS r(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= {s.entries})"""
    for n in range(s.rounds + 1):
        parts += f""",
near{n} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min({{'d': list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) AS m
  FROM parts JOIN book{n} USING (p) GROUP BY rid, p)"""
        if n < s.rounds:
            parts += f""",
mean{n} AS (SELECT p, e, list(floor(t / n) ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(x[i]) AS t, count(*) AS n FROM near{n}, range(1, {width + 1}) AS r(i) GROUP BY ALL) GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m ON b.p = m.p AND b.e = m.e)"""
    last = s.rounds
    return f"""WITH {parts},
codes AS (SELECT vec_id, label, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{last} JOIN kept USING (rid) GROUP BY rid, vec_id, label)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) FROM book{last}) AS codebooks_sha256
FROM codes"""


SQL = _sql()
