"""Mixing sources to target weights by entropy balancing (operator 10).

Documents get rates between 0 and 2 whose distance from 1 in (bounded) relative entropy, counted
by token, is least among all rates that meet the token constraints: each source's tokens come to
its target, and the tokens' mean and spread of log document length stay those of the corpus, so
that no source is filled with its short texts alone. The dual of that problem is convex, with one
variable for each source and two for length; at its minimum each document is tilted exponentially,

    rate / (2 - rate) = exp(a(source) + b . z(document)),

so rates differ between the documents of one source. The source constraints are met exactly; those
of length may contradict them (a source of one document), so they carry a small ridge penalty.

The dual is solved by Newton steps: gradient and Hessian are summed over the documents (those
equal in source and size together), the Hessian's arrow shape is eliminated source by source, and
only the 2 x 2 system of the length variables is solved on the driver. Sums are exact decimals, so
their order doesn't matter and reruns agree.

Rates are rounded into copies (0, 1 or 2) so that a source's tokens come near their target
throughout: its sizes are gone through from large to small, and each takes the number of copies
that brings the running total nearest to the sum of the rates so far. The error left is about half
of the smallest size. Which documents of equal size get the extra copy is decided by a keyed hash.

Edge cases: null texts have size 0; a null source is a source of its own, ordered last; sources
without words have target 0 and are left out; repeated rows count as often as they occur (a key of
id, text and the other columns, maps left out, tells rows apart); null ids are allowed; extra
columns are kept by :func:`mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MOST = 2.0
SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
RIDGE = 1e-3  # of the length variables, times the tokens
TOLERANCE = 1e-9  # of a source's target, or a thousandth of a word
MAX_STEPS = 60
ROWS_A_BLOCK = 1 << 16
#: Source figures are broadcast up to this many sources; beyond it they are joined salted.
BROADCAST_SOURCES = 100_000
SALTS = 16
_FEATURES = 2


def level(column: Column) -> Column:
    """A label that is never null: equal for equal values, and one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _places(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: 0, 1, ... in order of code points, null last, by ranges of sources."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = common.checkpointed(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())  # a row a partition
    first, before = [], 0
    for number, n in sizes:
        first.append((number, before))
        before += n
    firsts = ranged.sparkSession.createDataFrame(first or [(0, 0)], "range int, first long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("within", within).join(F.broadcast(firsts), "range").withColumn("place", F.col("first") + F.col("within") - 1).drop("range", "within", "first")


def source_targets(tokens: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, tokens): source, skey, tokens and ``target``, the weights' shares cut at ``most`` x tokens.

    What a cut leaves over is shared again by weight among the rest, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    rows = common.checkpointed(_places(tokens).select("source", level(F.col("source")).alias("skey"), "tokens", weight.alias("weight")))
    total = share * float(rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    per_weight, cut = 0.0, -1
    while True:
        above = F.col("weight") * per_weight >= most * F.col("tokens")
        if cut < 0:
            above = F.lit(False)
        n, used, free = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most * F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        per_weight = (total - used) / free if free else per_weight
        if n == cut or not free:
            break
        cut = n
    return rows.select("source", "skey", "tokens", F.least(F.col("weight") * per_weight, most * F.col("tokens")).alias("target"))


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on order; 0 of nothing."""
    return F.coalesce(F.sum(x.cast("decimal(38,9)")).cast("double"), F.lit(0.0))


def length_features(mean: float, spread: float) -> list[Column]:
    """z and z^2 - 1, z being the standardised log of ``size`` + 1."""
    z = (F.log1p("size") - mean) / spread
    return [z, z * z - 1]


def balance(cells: DataFrame, targets: DataFrame, most: float = MOST, ridge: float = RIDGE) -> DataFrame:
    """``cells`` (skey, size, n) with ``rate``; ``targets`` has (skey, tokens, target)."""
    bound = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("tokens") * (1 - 1e-12), most)
    sources = common.checkpointed(targets.select("skey", "tokens", "target", bound.alias("fixed")))
    free = sources.where("fixed IS NULL")
    cells = common.checkpointed(cells.select("skey", "size", "n"))
    open_cells = common.checkpointed(cells.where("size > 0").join(free.select("skey"), "skey"))
    w = F.col("size") * F.col("n")
    total, first, second = open_cells.agg(_exact(w.cast("double")), _exact(w * F.log1p("size")), _exact(w * F.log1p("size") * F.log1p("size"))).first()
    mean = first / total if total else 0.0
    spread = max(second / total - mean * mean, 0.0) ** 0.5 if total else 0.0
    spread = spread if spread > 1e-6 else 1.0
    z = length_features(mean, spread)
    penalty = ridge * max(total, 1.0)
    count = range(_FEATURES)

    def tilt(b: np.ndarray) -> Column:
        return F.col("dual") + sum((F.lit(float(b[k])) * z[k] for k in count), F.lit(0.0))

    def sums(duals: DataFrame, b: np.ndarray) -> tuple[DataFrame, dict]:
        """Of each source: its variable and its parts of gradient and Hessian; and what the driver solves."""
        x = tilt(b)
        rate = most / (1 + F.exp(-x))
        bend = w * rate * (1 - rate / most)
        softplus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        rows = open_cells.join(duals, "skey").groupBy("skey", "target", "dual").agg(
            _exact(w * rate).alias("got"), _exact(bend).alias("d"), _exact(w * most * softplus).alias("cost"),
            *(_exact(w * rate * z[k]).alias(f"g{k}") for k in count), *(_exact(bend * z[k]).alias(f"b{k}") for k in count),
            *(_exact(bend * z[k] * z[j]).alias(f"c{k}{j}") for k in count for j in count if j <= k),
        )
        rows = common.checkpointed(rows.withColumns({"g": F.col("got") - F.col("target"), "d": F.greatest("d", F.lit(1e-9))}))
        gap = F.abs("g") / F.greatest(F.col("target") * TOLERANCE, F.lit(1e-3))
        one = rows.agg(
            F.coalesce(F.max(gap), F.lit(0.0)).alias("gap"), _exact(F.col("cost") - F.col("dual") * F.col("target")).alias("cost"), *(_exact(F.col(f"g{k}")).alias(f"g{k}") for k in count),
            *(_exact(F.col(f"b{k}") * F.col("g") / F.col("d")).alias(f"r{k}") for k in count),
            *(_exact(F.col(f"c{k}{j}") - F.col(f"b{k}") * F.col(f"b{j}") / F.col("d")).alias(f"s{k}{j}") for k in count for j in count if j <= k),
        ).first().asDict()
        one["cost"] += penalty / 2 * float(b @ b)
        return rows, one

    share = F.col("target") / (most * F.col("tokens"))
    b = np.zeros(_FEATURES)
    rows, one = sums(free.select("skey", "target", F.log(share / (1 - share)).alias("dual")), b)
    for _ in range(MAX_STEPS):
        gradient = np.array([one[f"g{k}"] for k in count]) + penalty * b
        if one["gap"] <= 1 and np.abs(gradient).max() <= 1e-7 * max(total, 1.0):
            break
        schur = np.array([[one[f"s{max(k, j)}{min(k, j)}"] for j in count] for k in count]) + penalty * np.eye(_FEATURES)
        step = -np.linalg.solve(schur, gradient - np.array([one[f"r{k}"] for k in count]))
        move = (F.col("g") + sum((F.lit(float(step[k])) * F.col(f"b{k}") for k in count), F.lit(0.0))) / F.col("d")
        part = 1.0
        while True:
            tried, new = sums(rows.select("skey", "target", (F.col("dual") - part * move).alias("dual")), b + part * step)
            if new["cost"] <= one["cost"] + 1e-12 * abs(one["cost"]) or part < 1e-6:
                break
            part /= 2
        rows, one, b = tried, new, b + part * step
    else:
        raise RuntimeError(f"the dual isn't solved after {MAX_STEPS} Newton steps")
    duals = sources.select("skey", "fixed").join(rows.select("skey", "dual"), "skey", "left")
    rate = F.coalesce("fixed", most / (1 + F.exp(-tilt(b))), F.lit(0.0))
    return cells.join(duals, "skey").select("skey", "size", "n", rate.alias("rate"))


def rounded(rates: DataFrame, most: float = MOST) -> DataFrame:
    """(skey, size, rate, whole, extra) from (skey, size, n, rate): copies of every document of that size, and how
    many get one more. A source's sizes come in falling order and only running sums are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, aim, taken = None, 0.0, 0
        for batch in batches:
            wholes, extras = [], []
            for skey, size, n, rate in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if skey != source:
                    source, aim, taken = skey, 0.0, 0
                whole = int(np.floor(rate + 1e-9))
                aim += rate * size * n
                more = round((aim - taken) / size) - whole * n if size else round((rate - whole) * n)
                more = min(max(more, 0), n if whole < most else 0)
                taken += size * (whole * n + more)
                wholes.append(whole)
                extras.append(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(wholes, pa.int32()), pa.array(extras, pa.int64())], ["skey", "size", "rate", "whole", "extra"])

    ordered = rates.select("skey", "size", "n", "rate").repartition("skey").sortWithinPartitions("skey", F.desc("size"))
    return ordered.mapInArrow(run, "skey string, size long, rate double, whole int, extra long")


def _with_source_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Joins a row a source to ``rows`` (skey, block) without bringing a source's rows together."""
    if figures.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(figures), "skey")
    salted = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("block") % SALTS).cast("int")).join(salted, ["skey", "salt"]).drop("salt")


def _row_keys(docs: DataFrame) -> list[Column]:
    """key_id, key_text and key_rest, a hash of the other columns."""

    def hashable(kind: T.DataType) -> bool:
        return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()

    rest = [docs[f.name] for f in docs.schema.fields if f.name not in ("doc_id", "text") and hashable(f.dataType)]
    return [*common.row_key(docs["doc_id"], docs["text"]), F.xxhash64(F.lit(0), *rest).alias("key_rest")]


_KEY = ["key_id", "key_text", "key_rest"]


def copies(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """doc_id, the key columns, source, size, source_size, target, rate and copies for every row."""
    text = docs["text"]
    items = docs.select(docs["doc_id"], *_row_keys(docs), docs["source"], level(docs["source"]).alias("skey"), F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"))
    items = common.checkpointed(items.withColumn("h", F.xxhash64("key_id", "key_text")))
    blocks = max(64, items.count() // ROWS_A_BLOCK)
    items = items.withColumn("block", F.pmod("h", F.lit(blocks)))
    targets = common.checkpointed(source_targets(items.groupBy("source").agg(F.sum("size").alias("tokens")), share, weights))

    of_block = common.checkpointed(items.groupBy("skey", "size", "block").agg(F.count("*").alias("bn")))
    cells = of_block.groupBy("skey", "size").agg(F.sum("bn").alias("n"))
    decided = rounded(balance(cells, targets))
    before = Window.partitionBy("skey", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = of_block.withColumn("r0", F.coalesce(F.sum("bn").over(before), F.lit(0))).join(decided, ["skey", "size"]).select("skey", "size", "block", "r0", "rate", "whole", "extra")
    inside = Window.partitionBy("skey", "size", "block").orderBy("h", *_KEY)
    chosen = items.join(ranked, ["skey", "size", "block"]).withColumn("copies", F.col("whole") + (F.col("r0") + F.row_number().over(inside) <= F.col("extra")).cast("int"))
    figures = targets.select("skey", F.col("tokens").alias("source_size"), "target")
    return _with_source_figures(chosen, figures).select("doc_id", *_KEY, "source", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Copies are decided without the texts, which are
    then shuffled once; rows equal in all columns are first brought together, on the way to the shuffle."""
    names = [common.unused(docs, k) for k in _KEY]
    n = common.unused(docs, "copies")
    counts = copies(docs, share, weights).where("copies > 0").groupBy(*_KEY).agg(F.sum("copies").cast("int").alias(n)).withColumnsRenamed(dict(zip(_KEY, names, strict=True)))
    one = docs.withColumns(dict(zip(names, _row_keys(docs), strict=True))).dropDuplicates(names)
    nth = common.unused(docs, "nth")
    return one.join(counts, names).withColumn(nth, F.explode(F.sequence(F.lit(1), n))).drop(*names, n, nth)


def query(spark, sf_dir: str) -> DataFrame:
    out = copies(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", "copies")
