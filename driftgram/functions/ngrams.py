"""N-grams of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """A row for each element that isn't null. The outer form keeps the optimizer from adding a
    filter on the array's size, which would compute an expensive array a second time."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def ngrams(tokens: Column, n: int) -> Column:
    """Windows of ``n`` tokens joined by a space; none if there are fewer tokens or n is 0."""
    if n < 1:
        return F.array().cast("array<string>")
    if n == 1:
        return tokens
    joined = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws(" ", *(F.get(tokens, i + k) for k in range(n))))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def positions(df: DataFrame, tokens: Column | str, max_n: int, *keep: Column | str) -> DataFrame:
    """A row for each token, with it and the tokens behind it as ``t1`` to ``t<max_n>``; null behind the last one."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    behind = [F.slice(tokens, k, F.greatest(F.size(tokens) - (k - 1), F.lit(0))).alias(f"t{k}") for k in range(2, max_n + 1)]
    return df.select(*keep, F.inline_outer(F.arrays_zip(tokens.alias("t1"), *behind)).alias(*(f"t{k}" for k in range(1, max_n + 1)))).where("t1 IS NOT NULL")


def joined(n: int) -> Column:
    """The n-gram of a row of :func:`positions`; null where there are fewer tokens."""
    return F.concat(*[x for k in range(1, n + 1) for x in (F.lit(" "), F.col(f"t{k}"))][1:])


def of_order(df: DataFrame, n: int, *keep: str, tokens: str = "tokens", name: str = "ngram") -> DataFrame:
    """A row for each n-gram of one order. Strings are joined by compiled code, row by row, not in a function of arrays."""
    if n < 1:
        return df.select(*keep, F.lit("").alias(name)).where(F.lit(False))
    return positions(df, tokens, n, *keep).where(f"t{n} IS NOT NULL").select(*keep, joined(n).alias(name))


def of_orders(df: DataFrame, max_n: int, *keep: str, tokens: str = "tokens") -> DataFrame:
    """(keep, n, ngram): a row for each n-gram of orders 1 to ``max_n``, never across texts."""
    each = F.array(*(F.struct(F.lit(n).cast("byte").alias("n"), joined(n).alias("ngram")) for n in range(1, max_n + 1)))
    return positions(df, tokens, max_n, *keep).select(*keep, F.inline(each)).where("ngram IS NOT NULL")


def window_count(tokens: Column, n: int) -> Column:
    """How many n-grams of order ``n`` the tokens have, from their number alone."""
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0)).cast("long")
