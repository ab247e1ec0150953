"""Thresholds per n-gram order, and the filters that use them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Threshold:
    min_global: int = 0
    min_bucket: int = 1
    min_flush: int = 1


#: The thresholds that hold where a configuration says nothing.
DEFAULTS = {
    1: Threshold(0, 1, 1),
    2: Threshold(20, 3, 2),
    3: Threshold(10, 5, 2),
    4: Threshold(8, 2, 2),
    5: Threshold(5, 2, 2),
}


@dataclass(frozen=True)
class Pruning:
    """Thresholds by order. ``min_flush`` is read and kept for configurations' sake but never
    applied: Spark spills whole counts, so no count is dropped for lack of memory."""

    thresholds: Mapping[int, Threshold] = field(default_factory=lambda: dict(DEFAULTS))

    def with_threshold(self, n: int, min_global: int | None = None, min_bucket: int | None = None, min_flush: int | None = None) -> Pruning:
        given = {k: v for k, v in (("min_global", min_global), ("min_bucket", min_bucket), ("min_flush", min_flush)) if v is not None}
        return Pruning({**self.thresholds, n: replace(self.thresholds.get(n, Threshold()), **given)})

    def with_environment(self, environment: Mapping[str, str] | None = None) -> Pruning:
        """Overlaid with PRUNE_MIN_<n>GRAM_{GLOBAL,BUCKET,FLUSH}; values that aren't numbers are ignored."""
        environment = os.environ if environment is None else environment
        out = self
        for n in range(1, 10):
            values = [environment.get(f"PRUNE_MIN_{n}GRAM_{kind}", "") for kind in ("GLOBAL", "BUCKET", "FLUSH")]
            numbers = [int(v) if v.isdecimal() else None for v in values]
            if any(x is not None for x in numbers):
                out = out.with_threshold(n, *numbers)
        return out

    @property
    def export_floor(self) -> int:
        """The least positive global threshold, and 2 at least."""
        return max(2, min((t.min_global for t in self.thresholds.values() if t.min_global > 0), default=2))

    def _reaches(self, count: Column, n: Column, attribute: str) -> Column:
        least = F.create_map(*(x for k, t in sorted(self.thresholds.items()) for x in (F.lit(k), F.lit(getattr(t, attribute)).cast("long"))))
        return F.coalesce(count >= F.try_element_at(least, n.cast("int")), F.lit(False))

    def admits(self, count: Column, n: Column) -> Column:
        """The corpus-wide count reaches the order's threshold; an order without one never does."""
        return self._reaches(count, n, "min_global")

    def fills_bucket(self, count: Column, n: Column) -> Column:
        return self._reaches(count, n, "min_bucket")


def vocabulary(global_counts: DataFrame, pruning: Pruning) -> DataFrame:
    """The admitted (n, ngram) with their ``global_count``."""
    return global_counts.where(pruning.admits(F.col("count"), F.col("n"))).select("n", "ngram", F.col("count").alias("global_count"))


def filtered_counts(counts: DataFrame, admitted: DataFrame, pruning: Pruning) -> DataFrame:
    """Bucket counts worth storing: any unigram, and longer n-grams that are admitted, where the
    bucket's threshold is reached. Unigrams never meet the vocabulary, so only orders from 2 on
    are joined, after the cheap filter."""
    full = counts.where(pruning.fills_bucket(F.col("count"), F.col("n")))
    longer = full.where("n >= 2").join(admitted.where("n >= 2").select("n", "ngram"), ["n", "ngram"], "left_semi")
    return full.where("n = 1").select("bucket", "n", "ngram", "count").unionByName(longer.select("bucket", "n", "ngram", "count"))


def exported_globals(global_counts: DataFrame, pruning: Pruning) -> DataFrame:
    return global_counts.where(F.col("count") >= pruning.export_floor)


def admitted_and_exported(global_counts: DataFrame, pruning: Pruning) -> DataFrame:
    """:func:`exported_vocabulary` of the totals that the vocabulary is made from: two conditions on a row, no join."""
    return vocabulary(exported_globals(global_counts, pruning), pruning)


def exported_vocabulary(global_counts: DataFrame, admitted: DataFrame, pruning: Pruning) -> DataFrame:
    """Admitted n-grams that the exported totals also hold."""
    return exported_globals(global_counts, pruning).join(admitted.select("n", "ngram"), ["n", "ngram"]).select("n", "ngram", F.col("count").alias("global_count"))
