"""Tokenizer: known cases, and column expressions against the Python model on random texts."""

import decimal
import html.entities
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from driftgram.functions import formatting, ngrams, text
from driftgram.operators import counting

CASES = [
    ("Dr. Wu? We won't go...", ["dr", "wu", "we", "won't", "go"]),
    ("C++ or Zig or C#", ["c++", "or", "zig", "or", "c#"]),
    ("Vue.js + Next.js stack", ["vue.js", "next.js", "stack"]),
    ("See https://example.org/a/b?c=1 now", ["see", "example.org", "now"]),
    ("try gitlab.com/some/repo today", ["try", "gitlab.com", "today"]),
    ("out-of-the-box tools", ["out", "of", "the", "box", "tools"]),
    ("<p>Salt &amp; pepper</p>", ["salt", "pepper"]),
    ("3 &lt; 5 &gt; 4", ["3", "5", "4"]),
    ("&lt;div&gt;", ["div"]),
    ("...so...", ["so"]),
    ("'quoted'", ["quoted"]),
    ("foo.'", ["foo."]),
    ("gpt-4 x86-64 1-2", ["gpt-4", "x86-64", "1-2"]),
    ("gpt-4o gpt-3.5", ["gpt", "4o", "gpt", "3.5"]),
    ("2020-01-01 -5 +foo", ["2020", "01", "01", "5", "+foo"]),
    ("hi…there x²", ["hi...there", "x2"]),
    ("https://foo.com-bar.x/y z", ["foo.com", "bar.x", "z"]),
    ("http://localhost:80 HTTPS://a.com/x", ["http", "localhost", "80", "https", "a.com"]),
    ("foo.community/x", ["foo.community"]),
    ("it’s “fine”", ["it's", "fine"]),
    ("zero​width a‑b", ["zerowidth", "a", "b"]),
    ("&#x2F; &copy x&nbsp;y &hellip;", ["copy", "x", "y"]),
    ("http://a.b.com next", ["a.b.com", "next"]),
    ("çouelle İstanbul ﬁne", ["ouelle", "i", "stanbul", "fine"]),
    ("", []),
    (" \t\n", []),
    ("日本", []),
    (None, []),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    got = {r["i"]: r["tokens"] for r in text.with_tokens(rows).collect()}
    for i, (source, tokens) in enumerate(CASES):
        assert got[i] == tokens, source
        assert text.tokenize_text(source) == tokens, source


def test_random_texts_agree(spark):
    rng = random.Random(5)
    parts = [*"aAbZ01.'+#--/:  <>&;é ñ", "http://", "https://", "foo.com", "a.b/", "&amp;", "&lt;", "&#x27;", "&nbsp;", "gpt-4", "...", "localhost:80/x", " x.io/y ", "’", "²", "​", "\u0301", "&#x301;", "&frac12;"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))),) for _ in range(4000)]
    out = text.with_tokens(spark.createDataFrame(rows, "text string")).select("text", "tokens", text.needs_python(F.col("text")).alias("odd")).collect()
    assert all(r["tokens"] == text.tokenize_text(r["text"]) for r in out)
    assert {r["odd"] for r in out} == {True, False}


STABLE = ["Привет, мир", "Καλημέρα κόσμε", "日本語の文章、漢字かな", "한국어 문장", "مرحبا بالعالم", "שלום עולם", "हिन्दी में पाठ", "ไทย", "naïve café Straße", "😀 emoji ok", "Ελλάδα GPT-4 и C++"]
UNSTABLE = ["ﬁne", "ｆｕｌｌ", "cafe\u0301", "x²", "한\u11a8", "か\u3099", "a\u0301\u0316", "Å (\u212b)"]


MELTING = [t for t in UNSTABLE if "\u0301" in t]


def test_only_marks_behind_letters_leave_the_jvm(spark):
    rows = spark.createDataFrame([(t,) for t in STABLE + UNSTABLE], "text string")
    got = text.with_tokens(rows).select("text", "tokens", text.needs_python(F.col("text")).alias("odd")).collect()
    assert {r["text"] for r in got if r["odd"]} == set(MELTING) and len(MELTING) == 2
    assert all(r["tokens"] == text.tokenize_text(r["text"]) for r in got)


def test_random_texts_of_all_scripts_agree(spark):
    """Whatever isn't called odd has the same tokens after NFKC."""
    rng = random.Random(11)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x600), (0x600, 0x700), (0x900, 0xE80), (0x1100, 0x1200), (0x1E00, 0x2000), (0x2000, 0x2200), (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0xF900, 0xFB50), (0xFF00, 0xFFF0), (0x1D400, 0x1D500)]
    rows = []
    for _ in range(6000):
        some = rng.sample(blocks, 2)
        rows.append(("".join(chr(rng.randrange(*rng.choice(some))) for _ in range(rng.randint(1, 6))),))
    out = spark.createDataFrame(rows, "text string").select("text", text.needs_python(F.col("text")).alias("odd"), text.tokenize_plain(F.col("text")).alias("plain")).where("NOT odd").collect()
    assert 4000 < len(out) < 6000 and sum(unicodedata.normalize("NFKC", r["text"]) != r["text"] for r in out) > 500
    for r in out:
        assert r["plain"] == text.tokenize_text(r["text"]), r["text"]


def test_every_character_between_letters(spark):
    """Each of Unicode's characters alone, within a word, and in a pair with a neighbour."""
    rows = [(f"x{chr(c)}y {chr(c)}7 {chr(c)}{chr(c + 1)}z",) for c in range(0x80, 0x3FFFE) if not 0xD7FF <= c < 0xE000]
    out = spark.createDataFrame(rows, "text string").select("text", text.needs_python(F.col("text")).alias("odd"), text.tokenize_plain(F.col("text")).alias("plain")).where("NOT odd").collect()
    assert len(out) > 0.99 * len(rows)
    for r in out:
        assert r["plain"] == text.tokenize_text(r["text"]), r["text"]


def test_every_entity_is_decoded_in_the_jvm(spark):
    names = [f"a&{k[:-1]};b &{k[:-1]}" for k in html.entities.html5 if k.endswith(";")]
    numbers = [f"x&#{c};y&#x{c:X};z &#X{c:x};" for c in [*range(0, 700), *range(0x2000, 0x2100), 0x301, 0xD800, 0xFB01, 0xFF41, 0x1D4D0, 0x10FFFF, 0x110000, 10**12, 0]] + ["&#00000000000065;", "&#;", "&#x;", "&;", "&a b;", "&amp;lt;b", "<p title='&eacute;'>&eacute;"]
    rows = spark.createDataFrame([(t,) for t in names + numbers], "text string").select("text", text.needs_python(F.col("text")).alias("odd"), text.tokenize_plain(F.col("text")).alias("plain"))
    got = text.with_tokens(rows).collect()
    assert sum(r["odd"] for r in got) < 0.05 * len(got)
    for r in got:
        assert r["tokens"] == text.tokenize_text(r["text"]) and (r["odd"] or r["plain"] == r["tokens"]), r["text"]


def test_chinese_and_typeset_texts_stay_in_the_jvm(spark):
    """Full-width commas and stops, ideographic spaces, no-break spaces, ellipses, named entities."""
    rng = random.Random(8)
    parts = [*"，。！？（）：；　「」、…  ", "第１２章", "ＣＰＵ", "日本語", "caf&eacute;", "&nbsp;", "&hellip;", "word", "½", "ﬁx", "№7", "™", "naïve"]
    rows = [("".join(rng.choice(parts) for _ in range(60)),) for _ in range(2000)]
    out = text.with_tokens(spark.createDataFrame(rows, "text string")).select("text", "tokens", text.needs_python(F.col("text")).alias("odd")).collect()
    assert sum(r["odd"] for r in out) < 0.01 * len(out)
    assert all(r["tokens"] == text.tokenize_text(r["text"]) for r in out)


def test_plain_path_has_no_python(spark):
    plan = text.with_tokens(spark.createDataFrame([("a",)], "text string"), python_rows=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize(("tokens", "n", "grams"), [(["a", "b", "c"], 1, ["a", "b", "c"]), (["a", "b", "c"], 2, ["a b", "b c"]), (["a", "b", "c"], 3, ["a b c"]), (["a"], 2, []), ([], 1, []), (["a"], 0, [])])
def test_ngrams(spark, tokens, n, grams):
    row = spark.createDataFrame([(tokens,)], "t array<string>").select(ngrams.ngrams(F.col("t"), n).alias("g"), ngrams.window_count(F.col("t"), max(n, 1)).alias("w")).first()
    assert row["g"] == grams
    if n:
        assert row["w"] == len(grams)


def test_formats(spark):
    def shown(f, *values):
        return list(spark.range(1).select(*(f(F.lit(v).cast("double")).alias(f"c{i}") for i, v in enumerate(values))).first())

    assert shown(formatting.format_count, 5, 999, 1250, 405950, 2_500_000) == ["5", "999", "1.3K", "405.9K", "2.5M"]
    assert shown(formatting.format_frequency, None, 0, 0.0000123, 5e-13, 0.00123, 0.5) == ["—", "0", "1.23e-5", "5.00e-13", "0.00123", "0.5000"]
    assert shown(formatting.format_frequency, 2488.5 / 3e7, 9.999e-5, 9.994e-5, 1e-5, 9.996e-6, 1e-9) == ["8.29e-5", "1.00e-4", "9.99e-5", "1.00e-5", "1.00e-5", "1.00e-9"]
    assert shown(formatting.log_scale, 0, 2) == [None, 2.0]
    keys = spark.createDataFrame([(["B ", "a"],), (["A", " b"],)], "p array<string>").select(formatting.phrase_set_key(F.col("p")).alias("k")).collect()
    assert {r["k"] for r in keys} == {"a|b"}


def test_small_frequencies_are_rounded_by_their_exact_value(spark):
    """Against exact decimals, halves up; also where the shortest decimal form ends in a five."""
    rng = random.Random(4)
    values = [rng.randint(1, 10**6) / rng.choice([3e7, 1e11, 7e9]) for _ in range(2000)] + [k / 1e8 for k in range(1005, 9995, 10)]
    values = [v for v in values if 1e-9 <= v < 1e-4]

    def exact(v):
        d = decimal.Decimal(v)
        e = d.adjusted()
        n = int((d.scaleb(2 - e)).to_integral_value(decimal.ROUND_HALF_UP))
        n, e = (100, e + 1) if n == 1000 else (n, e)
        return f"{n // 100}.{n % 100:02d}e{e}"

    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", formatting.format_frequency(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in rows] == [exact(r["v"]) for r in rows]


def test_marks_at_tokens_ends(spark):
    """Texts with and without technical hyphens and mixed marks take different ways to the same tokens."""
    pieces = ["word", "it's", "a-b", "c++", "c#.", "'quoted'", "...", "x.y", "--", "-a-", "+", "#'+", "utf8-x", "a-1", "q.'", "'.z", "é", "½", "ab--cd", "1--2", "a''b", "İ", "K"]
    rows = [(f"{a}{s}{b}",) for a in pieces for b in pieces for s in (" ", "", "-")]
    for r in text.with_tokens(spark.createDataFrame(rows, "text string").repartition(4)).collect():
        assert r["tokens"] == text.tokenize_text(r["text"]), r["text"]


def test_ngrams_are_made_by_compiled_code(spark):
    """Neither n-grams nor tokens of plain texts go through a function of arrays, which isn't compiled: 475 task seconds for 0.1 GB before."""
    texts = spark.createDataFrame([("2024-01-01", ["a", "b", "c"]), ("2024-01-01", []), ("2024-01-02", ["a", "b"])], "bucket string, tokens array<string>")
    assert sorted(map(tuple, ngrams.of_orders(texts, 3, "bucket").collect())) == sorted(
        [("2024-01-01", n, g) for n, g in ((1, "a"), (1, "b"), (1, "c"), (2, "a b"), (2, "b c"), (3, "a b c"))] + [("2024-01-02", n, g) for n, g in ((1, "a"), (1, "b"), (2, "a b"))]
    )
    assert [r["ngram"] for r in ngrams.of_order(texts, 3).collect()] == ["a b c"] and ngrams.of_order(texts, 0).count() == 0
    plan = counting.ngram_counts(texts, 3)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "concat" in plan
