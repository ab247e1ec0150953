"""The deterministic tokenizer, as Spark column expressions.

Order of steps: strip tags, decode entities, URLs to domains, NFKC, drop zero-width characters,
straighten quotes, lower-case, cut into tokens. Spark has no function for NFKC, but tokens are ASCII, so
all that NFKC does to them are two things: a character may stand for one or several ASCII ones (full-width
letters, ligatures, the ellipsis), which a table made from Unicode's data replaces, and an ASCII letter
may melt together with a mark behind it. Only rows that have such a mark go through an Arrow UDF that
runs the same steps in Python; every other row stays in the JVM, and the UDF is handed null for it.
"""

from __future__ import annotations

import functools
import html.entities
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_VERSION = "1"

#: What a URL, a run of token characters and a technical hyphen look like.
_LABEL = r"[a-zA-Z0-9][-a-zA-Z0-9]*"
_DOMAIN = rf"{_LABEL}(?:\.{_LABEL})+"
#: Endings that make a dotted name with a path a URL even without a scheme.
_ENDINGS = ("com", "org", "net", "io", "dev", "ai", "co", "app", "edu", "gov", "me", "info", "biz")
_SCHEME_URL = rf"https?://(?=({_DOMAIN}))(?:{_LABEL}\.)+[a-zA-Z]{{2,}}\S*"
_BARE_URL = rf"(?<![a-zA-Z0-9])(?=({_DOMAIN}))(?:{_LABEL}\.)+(?:{'|'.join(_ENDINGS)})(?=\S*/)\S*"
_RUN = r"[a-z0-9'+#.\-]+"
_TECHNICAL = r"^(?:[a-z]+[0-9]+-[a-z0-9]+|[a-z0-9]+-[0-9]+)$"
#: Tokens of texts without what _ODD finds: no technical hyphens, and no runs of different marks, which would be trimmed
#: in an order. There, marks at a token's ends go, and every hyphen cuts. Characters are listed one by one, for which Java
#: looks into a table; ranges it compares one after the other.
_AZ09 = "abcdefghijklmnopqrstuvwxyz0123456789"
_ODD = r"[-'](?:(?<=')[-.]|(?<=-)['.]|(?<=\.[-'])|(?<=[0-9]-)[a-z0-9]|(?<=[a-z]-)[0-9])"
_EVEN_TOKEN = rf"(?:[{_AZ09}]|[+#](?=[+#'.]*[{_AZ09}]))[{_AZ09}+#]*+(?:(?:'++|\.++)[{_AZ09}+#]++)*+"
_ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
_CURLY, _STRAIGHT = "\u201c\u201d\u2018\u2019", "\"\"''"

#: The usual entities; the ampersand comes last so that nothing is decoded twice.
_PLAIN_ENTITIES = {
    "<": ("&lt;", "&#60;"), ">": ("&gt;", "&#62;"), '"': ("&quot;", "&#34;"), "'": ("&#x27;", "&#39;", "&apos;"), "/": ("&#x2F;", "&#47;"), "&": ("&amp;", "&#38;"),
}
_ANY_ENTITY = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
_OTHER_ENTITY = "&(?!(?:" + "|".join(x[1:-1] for names in _PLAIN_ENTITIES.values() for x in names) + f");){_ANY_ENTITY[1:]}"
_MATTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'+#.-") | set(_ZERO_WIDTH + _CURLY)


@functools.cache
def _nfkc() -> tuple[str, dict[str, str], dict[str, str]]:
    """From Unicode's data: a class of the characters that an ASCII character before them may melt together with, and
    what other characters become that NFKC turns into something that matters to tokens: one character, or several."""
    pairs = {d.split()[1]: d.split()[0] for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d and int(d.split()[0], 16) < 0x80}
    marks = {chr(int(m, 16)) for m in pairs}
    melting, single, several = [], {}, {}
    for c in map(chr, range(0x80, 0x110000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        if unicodedata.normalize("NFKD", c)[0] in marks:
            melting.append(c)
        elif (out := unicodedata.normalize("NFKC", c)) != c and not _MATTERS.isdisjoint(out):
            (single if len(out) == 1 else several)[c] = out
    return f"[{''.join(melting)}]", single, several


@functools.cache
def _other() -> str:
    """The class of characters that may need a step of their own: all but ASCII and what of Latin-1 stays as it is."""
    _, single, several = _nfkc()
    plain = [c for c in range(0x100) if c < 0x80 or chr(c) not in single and chr(c) not in several]
    return "[^" + "".join(f"\\x{c:02x}" for c in plain) + "]"


@functools.cache
def _several() -> tuple[str, dict[str, str]]:
    """The class and the map of characters that become several; the ellipsis is frequent and has a step of its own."""
    others = {k: v for k, v in _nfkc()[2].items() if k != "\u2026"}
    return _class(others), others


@functools.cache
def _melting_entity() -> str:
    """Entities that stand for a mark that may melt together with an ASCII character."""
    melting = _nfkc()[0]
    names = [k for k, v in html.entities.html5.items() if k.endswith(";") and re.search(melting, v)]
    codes = [ord(c) for c in melting[1:-1]]
    return "&(?:" + "|".join([*names, f"#0*(?:{'|'.join(map(str, codes))});", f"#[xX]0*(?i:{'|'.join(f'{c:x}' for c in codes)});"]) + ")"


def _class(characters: Iterable[str]) -> str:
    """A character class, neighbours as ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def _table(entries: dict[str, str]) -> Column:
    """A map from text to text, written as one constant."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def decode_plain_entities(text: Column) -> Column:
    for plain, names in _PLAIN_ENTITIES.items():
        for name in names:
            text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def decode_all_entities(text: Column) -> Column:
    """Every entity with its semicolon, once; names and numbers that nothing has stay as they are."""
    names = _table({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})

    def numbered(entity: Column) -> Column:
        hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
        digits = F.regexp_replace(entity, "^&#[xX]?0*|;$", "")
        code = F.when(F.char_length(digits).between(1, 7), F.conv(digits, 16, 10).cast("int") * hexadecimal.cast("int") + F.conv(F.when(hexadecimal, "0").otherwise(digits), 10, 10).cast("int"))
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decoded(entity: Column) -> Column:
        named = F.try_element_at(names, F.substring(entity, F.lit(2), F.char_length(entity) - 2))
        return F.coalesce(F.when(F.startswith(entity, F.lit("&#")), numbered(entity)).otherwise(named), entity)

    found, gaps = F.regexp_extract_all(text, F.lit(_ANY_ENTITY), F.lit(0)), F.split(text, _ANY_ENTITY, -1)
    joined = lambda x: F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(x["with"], i), F.lit("")))), "")
    return let(F.struct(F.transform(found, decoded).alias("with"), gaps.alias("gaps")), joined)


def decode_entities(text: Column) -> Column:
    """The usual entities by replacement; all of them where there are others."""
    return F.when(text.rlike(_OTHER_ENTITY), decode_all_entities(text)).otherwise(decode_plain_entities(text))


def to_ascii(text: Column) -> Column:
    """Characters that NFKC turns into something that matters to tokens, so turned."""
    single, (rare_class, several) = _nfkc()[1], _several()
    table = _table(several)
    each = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    rare = lambda t: F.when(t.rlike(rare_class), each(t)).otherwise(t)
    return let(F.replace(F.translate(text, "".join(single), "".join(single.values())), F.lit("\u2026"), F.lit("...")), rare)


def urls_to_domains(text: Column) -> Column:
    """A URL becomes its domain between spaces; without a scheme it needs a known ending and a path."""
    return F.regexp_replace(F.regexp_replace(text, f"(?U){_SCHEME_URL}", " $1 "), f"(?U){_BARE_URL}", " $1 ")


def _if_contains(text: Column, part: str, step: Callable[[Column], Column]) -> Column:
    return let(text, lambda t: F.when(F.contains(t, F.lit(part)), step(t)).otherwise(t))


def _trimmed(token: Column) -> Column:
    return F.btrim(F.btrim(F.btrim(token, F.lit(".")), F.lit("'")), F.lit("-"))


def _kept(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, _trimmed), lambda t: t.rlike("[a-z0-9]"))


def cut_tokens(text: Column) -> Column:
    """Tokens of text that is already lower-case."""
    odd = lambda t: (F.contains(t, F.lit("-")) | F.contains(t, F.lit("'"))) & t.rlike(_ODD)
    return let(text, lambda t: F.when(odd(t), _cut_and_trimmed(t)).otherwise(F.regexp_extract_all(t, F.lit(_EVEN_TOKEN), F.lit(0))))


def _cut_and_trimmed(text: Column) -> Column:
    """The same for any text: runs are cut, trimmed one by one, and cut again at natural hyphens."""
    def parts(token: Column) -> Column:
        natural = F.contains(token, F.lit("-")) & ~token.rlike(_TECHNICAL)
        return F.when(natural, _kept(F.split(token, "-"))).otherwise(F.array(token))

    tokens = _kept(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)))
    hyphens = lambda ts: F.when(F.exists(ts, lambda t: F.contains(t, F.lit("-"))), F.flatten(F.transform(ts, parts))).otherwise(ts)
    return let(tokens, hyphens)


def tokenize_plain(text: Column) -> Column:
    """Tokens of texts for which :func:`needs_python` is false; null gives no tokens."""
    text = F.coalesce(text, F.lit(""))
    text = _if_contains(text, "<", strip_tags)
    text = _if_contains(text, "&", decode_entities)
    text = _if_contains(text, "/", urls_to_domains)
    ascii_only = lambda t: F.translate(F.translate(to_ascii(t), _ZERO_WIDTH, ""), _CURLY, _STRAIGHT)
    text = let(text, lambda t: F.when(_has_other(t), ascii_only(t)).otherwise(t))
    return cut_tokens(F.lower(text))


def _has_other(text: Column) -> Column:
    return (F.octet_length(text) != F.char_length(text)) & text.rlike(_other())


def needs_python(text: Column) -> Column:
    """The text has a mark that may melt together with an ASCII character, or an entity that stands for one."""
    written = _has_other(text) & text.rlike(_nfkc()[0])
    return F.coalesce(written | (F.contains(text, F.lit("&")) & text.rlike(_melting_entity())), F.lit(False))


_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")
_PY_SCHEME, _PY_BARE = re.compile(_SCHEME_URL), re.compile(_BARE_URL)
_PY_RUN, _PY_TECHNICAL, _PY_ALNUM = re.compile(_RUN), re.compile(_TECHNICAL), re.compile("[a-z0-9]")


def _entity(match: re.Match[str]) -> str:
    decimal, hexadecimal, name = match.groups()
    if name:
        return html.entities.html5.get(name + ";", match.group())
    code = int(decimal) if decimal else int(hexadecimal, 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else match.group()


def tokenize_text(text: str | None) -> list[str]:
    """The whole tokenizer for one text, in Python: for phrases, and for rows that need it."""
    text = _ENTITY.sub(_entity, re.sub("<[^>]*>", " ", text or ""))
    text = _PY_BARE.sub(r" \1 ", _PY_SCHEME.sub(r" \1 ", text))
    text = unicodedata.normalize("NFKC", text)
    text = text.translate(str.maketrans(_CURLY, _STRAIGHT, _ZERO_WIDTH)).lower()

    def trimmed(tokens: list[str]) -> list[str]:
        return [t for t in (x.strip(".").strip("'").strip("-") for x in tokens) if _PY_ALNUM.search(t)]

    out: list[str] = []
    for token in trimmed(_PY_RUN.findall(text)):
        out += trimmed(token.split("-")) if "-" in token and not _PY_TECHNICAL.match(token) else [token]
    return out


def _udf() -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenize_text(t))

    return tokens


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", python_rows: bool = True) -> DataFrame:
    """``df`` with the array column ``out``. ``python_rows=False`` leaves out the UDF: for corpora
    known to be free of marks behind ASCII letters."""
    text_column = F.col(text)
    if not python_rows:
        return df.withColumn(out, tokenize_plain(text_column))
    odd = F.when(needs_python(text_column), text_column)
    given = "by_python"
    while given.lower() in {c.lower() for c in df.columns}:
        given += "_"
    tokens = F.when(F.col(given).isNull(), tokenize_plain(text_column)).otherwise(F.col(given))
    return df.withColumn(given, _udf()(odd)).withColumn(out, tokens).drop(given)


def normalize_phrase(phrase: str | None) -> str:
    return " ".join(tokenize_text(phrase))
