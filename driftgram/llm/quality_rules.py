"""Quality rules as a bitmask ledger (operator 1), native DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and one bigint of
failure bits; a policy is a mask over those bits, so trying another policy or leaving a rule out
(ablation) needs only bit operations over the ledger, never the texts again.

Edge cases: null and empty texts have no words, so they fail ``few_words``. Repeated rows are
judged alike. Extra columns are ignored by :func:`ledger` unless named in ``keep``. An empty
table gives an empty ledger and, in :func:`ablate`, zero counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; ``bit`` never changes once ledgers are stored."""

    bit: int
    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        known = {r.name: 1 << r.bit for r in rules}
        return sum(known[name] for name in set(self.rules))


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "odd_word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(3, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "shouting", "100 * n_upper > 50 * word_chars"),
    Rule(6, "exclamation", "100 * n_marks > 50 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(r.name for r in RULES)), Policy("v1-lenient", ("few_words", "repeated_windows", "symbols")))}


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = common.let(tagged, lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, zero, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(common.let(windows, counted))


def measurements(text: Column) -> Column:
    """One struct with every number the rules look at, from one pass over the text."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        joined = F.array_join(w, "")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD))

        def count(n: Column, name: str) -> Column:
            return n.cast("long").alias(name)

        def rest(parts: Column) -> Column:
            joined, lines = parts["joined"], parts["lines"]
            return F.struct(
                count(F.size(w), "n_words"),
                count(F.char_length(joined), "word_chars"),
                count(F.char_length(joined) - F.char_length(F.translate(joined, SYMBOLS, "")), "n_symbols"),
                count(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
                count(_repeated(w), "n_repeat_words"),
                count(F.size(lines), "n_lines"),
                count(F.char_length(joined) - F.char_length(F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")), "n_upper"),
                count(F.char_length(joined) - F.char_length(F.translate(joined, "!", "")), "n_marks"),
            )

        return common.let(F.struct(joined.alias("joined"), lines.alias("lines")), rest)

    return common.let(common.words(text), of)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``failures``: bit ``r.bit`` is set where rule r fails."""
    struct = common.unused(docs, "measured")
    measured = docs.select(*(docs[c] for c in keep), measurements(docs["text"]).alias(struct)).select(*keep, f"{struct}.*")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits)


def apply_policy(ledger_df: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept``: no bit of the policy's mask is set."""
    return ledger_df.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablate(ledger_df: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those kept again if it were left out.

    The ledger is first folded to its distinct failure masks (at most 2**len(rules) rows), so
    each ablation is a bit test over that small table.
    """
    mask = policy.mask(rules)
    folded = ledger_df.groupBy("failures").agg(F.count("*").alias("n"))
    one = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules)))
    hit = F.col("failures").bitwiseAND(F.col("r.bit")) != 0
    alone = hit & (F.col("failures").bitwiseAND(F.lit(mask).cast("long")).bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0)
    return (
        folded.select("failures", "n", one.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("kept_without"))
        .withColumn("policy", F.lit(policy.version))
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(common.table(spark, sf_dir, "documents")), POLICIES["v1"])
    base = F.col("failures").bitwiseAND(F.lit(BASE.mask(RULES)).cast("long")) != 0
    return out.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "failures")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
dup AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT rid, sum(least(3, p - coalesce(q, -9))) AS n
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM dup) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(array_to_string(w, ''), '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(array_to_string(w, ''), '[^!]', '', 'g')) AS n_marks
  FROM d LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 8 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END + CASE WHEN 100 * n_marks > 50 * n_words THEN 64 ELSE 0 END)::BIGINT AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
