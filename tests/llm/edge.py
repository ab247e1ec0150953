"""Tables with every awkward case, shared by the tests of this folder."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def rows():
    """(doc_id, text, lang, source, n_chars)"""
    out = [(i, prose(i, 60 + i), "en", f"s{i % 4}", 1) for i in range(1, 41)]
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \t\n\x0b", "en", "s1", 4), (103, "one", "en", "s1", 3), (104, "one two", None, None, 7)]
    out += [(None, prose(3, 70), "en", "s0", 9), (None, None, None, None, None), (2**60 + 1, prose(4, 65), "en", "s2", 1)]
    out += [(200, prose(200, 20_000), "en", "s3", 1)]  # very long
    out += [(201, "x" * 120_000, "en", "s3", 1)]  # one long word
    out += [(i, prose(500, 80), "en", "s0", 1) for i in range(300, 330)]  # copies
    out += [(7, prose(7, 67), "en", "s3", 1)] * 3  # repeated rows, one id twice
    out += [(400, "naïve 😀 ünïcode text here " + prose(9, 60), "fr", "é", 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("__i", "__t", "__ki", "__kt", "__n", "__copies", "__m", "__r", "__odd", "__spans", "Located", "result", "measured", "Score", "label", "labels", "kept", "failures", "n_words", "spans", "full", "more", "size", "rate", "copies", "shard", "slot", "rank", "block", "h", "key", "key_id", "key_text", "fp", "a", "b", "root", "node", "component_id", "pii", "n_card", "hmm", "row", "word", "c", "level", "target", "skey", "item_id", "held_out", "bucket")


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    """The same rows with extra columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    return documents(spark).select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
