"""Secret scanning through a trigram inverted index (operator 9), native functions only.

Each rule is a regular expression. From it a Boolean trigram query is derived: which trigrams every
match must hold. The postings say which of the rules' trigrams a text has. A scan works them out once a
text, and they alone decide which rules can match there; only those are matched against the text. So
a scan reads each text once and moves none. Turned round by trigram (:func:`postings`) they are a stored
index, whose lists :func:`candidates` intersects without the texts. Rules without a mandatory trigram (hex
runs) are matched against every text.

Edge cases: a null text counts as empty and has no spans; rows with equal id and text share postings in a
stored index; null ids are kept; an empty table gives an empty result; extra columns are ignored. Whole
texts of any length are searched. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, trigrams


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; those that don't fully match ``check`` are dropped."""

    kind: str
    pattern: str
    check: str = r"[\s\S]*"


#: The three kinds every scan reports, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"[A-Z0-9]{20,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Publicly documented formats of credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


def _folded(docs: DataFrame) -> Column:
    return F.translate(F.coalesce(docs["text"], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def needed(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that decide about the rules."""
    return sorted({g for r in rules for clause in trigrams.query(r.pattern) for alternative in clause for g in alternative})


def held(text: Column, grams: list[str]) -> Column:
    """Those of ``grams`` that a text (lower-cased) has: its postings."""
    return F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(text, g))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index, restricted to ``grams``: one row (gram, key) for each that occurs."""
    found = common.let(_folded(docs), lambda t: held(t, grams))
    return docs.select(*common.row_key(docs["doc_id"], docs["text"]), F.explode(found).alias("gram"))


def satisfied(grams: Column, rule: Rule) -> Column:
    """A text with these postings satisfies the rule's trigram query."""
    holds = lambda alternative: reduce(Column.__and__, (F.array_contains(grams, g) for g in sorted(alternative)))
    meets = lambda clause: reduce(Column.__or__, map(holds, sorted(clause, key=sorted)))
    return reduce(Column.__and__, map(meets, sorted(trigrams.query(rule.pattern), key=lambda c: sorted(map(sorted, c)))))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key_id, key_text, rules): for each document the rules whose trigram query it satisfies."""
    spark = index.sparkSession
    terms = [
        (rule.kind, c, a, len(alternative), len(clauses), gram)
        for rule in rules
        for clauses in [sorted(trigrams.query(rule.pattern), key=lambda x: sorted(map(sorted, x)))]
        for c, clause in enumerate(clauses)
        for a, alternative in enumerate(sorted(clause, key=sorted))
        for gram in sorted(alternative)
    ]
    term_table = spark.createDataFrame(terms, "kind string, clause int, alternative int, grams int, clauses int, gram string")
    key = ["key_id", "key_text"]
    hits = index.join(F.broadcast(term_table), "gram")  # the terms' number is fixed by the rules
    whole = hits.groupBy(*key, "kind", "clause", "alternative", "grams", "clauses").agg(F.count_distinct("gram").alias("n")).where("n = grams")
    kinds = whole.groupBy(*key, "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return kinds.groupBy(*key).agg(F.array_sort(F.collect_set("kind")).alias("rules"))


def _found(text: Column, rule: Rule) -> Column:
    hits = F.filter(common.spans(text, rule.pattern), lambda s: s["text"].rlike(f"^(?:{rule.check})$"))
    order = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array<struct<start, kind_order, end, kind>>, by start, then kind as listed."""
    indexed = tuple(r for r in rules if trigrams.query(r.pattern))
    full = tuple(r for r in rules if r not in indexed)
    text = F.coalesce(docs["text"], F.lit(""))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")

    def verified(grams: Column) -> Column:
        some = reduce(Column.__or__, (satisfied(grams, r) for r in indexed))
        each = (F.when(satisfied(grams, r), _found(text, r)).otherwise(none) for r in indexed)
        return F.when(some, F.concat(*each)).otherwise(none)

    found = [_found(text, r) for r in full]
    if indexed:
        found.append(common.let(common.let(_folded(docs), lambda t: held(t, needed(indexed))), verified))
    return docs.select("doc_id", F.sort_array(F.concat(none, *found)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    counts = [common.count_kind("spans", r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _sql_kind(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    check = rule.check.replace("'", "''")
    for word in ("password|passwd|secret|token|api_?key",):
        folded = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
        pattern, check = pattern.replace(f"(?i:{word})", f"(?:{folded})"), check.replace(f"(?i:{word})", f"(?:{folded})")
    return f"SELECT rid, text, {order} AS o, '{rule.kind}' AS kind, '^(?:{check})$' AS ok, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM d"


def _sql_written(only: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) {only}, '')"


_BASE = "FILTER (WHERE o < 3)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k AS ({' UNION ALL '.join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
p AS (SELECT rid, o, kind, ok, m, g, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
s AS (SELECT rid, o, kind, ok, m[i] AS t, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s FROM p),
f AS (SELECT rid, o, kind, s, s + length(t) AS e FROM s WHERE regexp_matches(t, ok)),
a AS (SELECT rid, {_sql_written('')} AS spans, {_sql_written(_BASE)} AS base,
  count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
