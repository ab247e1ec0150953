"""Format-preserving pseudonyms for personal data (operator 7), native functions only.

Found in whole texts: e-mail addresses, IPv4 addresses, card numbers (an issuer's beginning and length,
digits together or in the groups that cards show, and the Luhn check), North American phone numbers, US social security numbers, international bank
account numbers (modulo 97) and calendar dates (2024-02-29 and 29.02.2024). Each valid value is
replaced by a keyed permutation within its own format, so a card stays a Luhn-valid number of
the same length, a date a date, and equal values become equal pseudonyms in every document.

The permutation is a Feistel network of :data:`ROUNDS` rounds. The value's variable characters
are cut into halves; a round adds to each character of one half, modulo its alphabet (10 digits,
26 lower or upper letters), a shift taken from SHA-256 of key, round and the other half. Every
round can be undone, so it is a bijection on all values of that format. Octets of an address
are shifted modulo 256. A date is its day number within the 146,097 days of a Gregorian cycle,
written as a pair modulo 189 and 773 (their product), so no cycle walking is needed; likewise a
social security number is its place among the valid ones, modulo 898 x 99 and 9,999. A phone
number whose area and exchange begin with 2 to 9, as the North American plan has it, stays one
(modulo 800 x 800 and 10,000); one of that shape outside the plan stays outside it. The last
digit of a card number and the check digits of an account aren't permuted but worked out anew.

Digit groups beside a grouped card number, or capitals beside a grouped account number, look like a
part of it. So all such spans are tried, and the text is then searched for those that pass their check:
from the left, the longest first. (So where digits before a number happen to pass with its beginning,
as one in ten of those with an issuer's beginning does, that span is replaced and the number's last group is
left.) Numbers without separators stand alone and need no such search, so texts full of them take linear
time; n different grouped numbers in a text take time n times its length. A shorter span than the longest
one of an account must have its country's length.

The key comes from the setting ``spark.driftgram.pii.key``. Where that is unset, :func:`query` draws one for
this run alone, which is kept nowhere: its pseudonyms are linked within the run and to no other.

Edge cases: a null text stays null, empty texts stay empty; values that fail validation are left
alone; repeated rows are treated alike; all other columns of an input are kept, those named like
the results replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
KINDS = ("email", "ip", "phone", "card", "date", "ssn", "iban")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Issuers' beginnings and lengths, as publicly documented.
ISSUERS = "|".join((
    "4[0-9]{12}(?:[0-9]{3}){0,2}", "(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}", "3[47][0-9]{13}", "3(?:0[0-5]|[689][0-9])[0-9]{11}(?:[0-9]{2,5})?",
    "(?:6011|64[4-9][0-9]|65[0-9]{2}|62[0-9]{2}|35(?:2[89]|[3-8][0-9])|220[0-4])[0-9]{12,15}", "(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15}",
))
CARD = rf"(?<![0-9A-Za-z])(?=[2-6][0-9]{{12}})(?:{ISSUERS})(?![0-9A-Za-z])"
#: Cards' groups, the longest first, with one separator throughout.
_GROUPS = [(4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3)]
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
GROUPED_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Card and account numbers that stand alone are looked for where a text has as many digits or capitals in a row; grouped
#: ones of a text that pass their checks are put behind the rest.
OTHERS, ALONE = f"{EMAIL}|{IP}|{DATE}|{SSN}|{PHONE}", f"|{CARD}|{ACCOUNT}"
_MAY_STAND_ALONE = r"[0-9]{13}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"
_MAY_BE_GROUPED = r"[0-9]{4}[ -][0-9]{3,6}[ -][0-9]{3}|[A-Z]{2}[0-9]{2} [A-Z0-9]{4} "
_SHAPES = [f"[0-9]{{{first}}}" + "".join(f"{sep}[0-9]{{{n}}}" for n in rest) for first, *rest in _GROUPS for sep in " -"]
GROUPED_CARD = rf"(?<![0-9A-Za-z])(?:{'|'.join(_SHAPES)})(?![0-9A-Za-z])"
CARD_SPANS = [rf"(?<![0-9A-Za-z])(?=({shape})(?![0-9A-Za-z]))" for shape in _SHAPES]
IBAN_SPANS = [rf"(?<![A-Za-z0-9])(?=([A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n}}}{tail})(?![A-Za-z0-9]))" for n in range(7, 1, -1) for tail in (" [A-Z0-9]{1,3}", "")]
#: Length of a country's account numbers.
IBAN_LENGTHS = {
    n: countries.split()
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Sum of ``digits`` from the left, every second one doubled, starting as ``doubled_first`` says."""
    each = F.transform(F.split(digits, ""), lambda c, i: common.let(c.cast("int") * F.when((i % 2 == 0) == doubled_first, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return luhn_sum(digits, F.char_length(digits) % 2 == 0) % 10 == 0


def card_valid(digits: Column) -> Column:
    return digits.rlike(f"^(?:{ISSUERS})$") & luhn_valid(digits)


def _shift(key: str, tag: str, r: int, other: Column, i: Column) -> Column:
    """32 keyed bits for place ``i``, from the other half."""
    block = F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"{tag}{r}"), F.floor(i / 8).cast("string"), other).cast("binary"), 256)
    return F.conv(F.substring(block, F.lit(1) + (i % 8) * 8, F.lit(8)), 16, 10).cast("long")


def _add(half: Column, key: str, r: int, other: Column, sign: int) -> Column:
    """Each letter or digit of ``half`` moved within its alphabet; anything else stays."""

    def moved(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        first = F.when(code < 58, 48).when(code < 91, 65).otherwise(97)
        shifted = F.pmod(code - first + sign * _shift(key, "chars", r, other, i), F.when(code < 58, 10).otherwise(26))
        return F.when(c.rlike("^[0-9A-Za-z]$"), F.char(first + shifted)).otherwise(c)

    chars = F.transform(F.sequence(F.lit(1), F.char_length(half)), lambda i: F.substring(half, i, F.lit(1)))
    return F.when(F.char_length(half) == 0, half).otherwise(F.array_join(F.transform(chars, moved), ""))


def _feistel(left: Column, right: Column, key: str, forward: bool, add) -> Column:
    """Struct (l, r) after all rounds; rounds are lambda steps, so each is computed once."""
    state = F.struct(left.alias("l"), right.alias("r"))
    order = range(ROUNDS) if forward else reversed(range(ROUNDS))
    sign = 1 if forward else -1

    def step(s: Column, r: int) -> Column:
        if r % 2 == 0:
            return common.let(s, lambda x: F.struct(add(x["l"], key, r, x["r"], sign, 0).alias("l"), x["r"].alias("r")))
        return common.let(s, lambda x: F.struct(x["l"].alias("l"), add(x["r"], key, r, x["l"], sign, 1).alias("r")))

    return reduce(step, order, state)


def permute_chars(value: Column, key: str, forward: bool = True) -> Column:
    """Feistel over the ASCII letters and digits of ``value``; shorter than 2 characters: one keyed half."""
    cut = F.floor(F.char_length(value) / 2).cast("int")
    halves = _feistel(F.substring(value, F.lit(1), cut), F.substring(value, cut + 1, F.char_length(value)), key, forward, lambda half, k, r, other, sign, side: _add(half, k, r, other, sign))
    return common.let(halves, lambda s: F.concat(s["l"], s["r"]))


def _date(value: Column) -> Column:
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd.MM.yyyy"))


def permute_pair(left: Column, right: Column, sizes: tuple[Column, Column], key: str, forward: bool = True) -> Column:
    """Struct (l, r): a bijection on pairs of numbers below the two sizes."""
    add = lambda half, k, r, other, sign, side: F.pmod(half + sign * _shift(k, "pair", r, other.cast("string"), F.lit(0)), sizes[side])
    return _feistel(left, right, key, forward, add)


def mod97(compact: Column) -> Column:
    """An account's country and check digits put last, letters read as 10 to 35, modulo 97."""
    turned = F.concat(F.substring(compact, F.lit(5), F.char_length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, a * 100 + code - 55).otherwise(a * 10 + code - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _into(shape: Column, chars: Column, taken: str) -> Column:
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.when(c.rlike(taken), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substring(chars, a["at"], F.lit(1))).alias("out"))).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out")))
    return F.aggregate(F.split(shape, ""), zero, step, lambda a: a["out"])


def _checked_card(body: Column) -> Column:
    """With the digit that makes it pass the Luhn check."""
    return F.concat(body, F.pmod(F.lit(10) - luhn_sum(body, F.char_length(body) % 2 == 1) % 10, F.lit(10)).cast("string"))


def _checked_account(country: Column, account: Column) -> Column:
    check = F.lit(98) - mod97(F.concat(country, F.lit("00"), account))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


_DAY_ZERO = "1900-01-01"
#: Sizes of the two halves: days of a Gregorian cycle, addresses, social security numbers.
_PAIRS = {"date": (189, 773), "ip": (1 << 16, 1 << 16), "ssn": (898 * 99, 9999)}
_COUNTRY_CODE, _TOP_LEVEL = r"^(?:\+1[ .-]?)?", r"\.[A-Za-z]+$"


def permute(value: Column, kind: Column, key: str, forward: bool = True) -> Column:
    """The pseudonym of a valid value of the given kind; its inverse with ``forward=False``.

    One network permutes characters (of an address without its top-level domain, of a card number
    without its check digit, of an account without country and check digits), one pairs of numbers
    (dates, IPv4 addresses, social security and phone numbers).
    """
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    digits = F.regexp_replace(F.regexp_replace(value, _COUNTRY_CODE, ""), "[^0-9]", "")
    body = (
        F.when(kind == "email", F.regexp_replace(value, _TOP_LEVEL, ""))
        .when(kind == "card", F.substring(bare, F.lit(1), F.char_length(bare) - 1))
        .when(kind == "iban", F.substring(bare, F.lit(5), F.char_length(bare)))
    )
    number = lambda at, n: F.substring(value, F.lit(at), F.lit(n)).cast("long")
    octet = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("long")
    area = number(1, 3)
    day = F.datediff(_date(value), F.lit(_DAY_ZERO).cast("date")).cast("long")
    zone, exchange = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 3).cast("long")
    in_plan = (zone >= 200) & (exchange >= 200)
    dialled = F.when(in_plan, (zone - 200) * 800 + exchange - 200).when(zone < 200, zone * 1000 + exchange).otherwise(200_000 + (zone - 200) * 200 + exchange)
    left = F.when(kind == "date", F.floor(day / 773)).when(kind == "ip", octet(1) * 256 + octet(2)).when(kind == "ssn", (area - 1 - (area > 666).cast("long")) * 99 + number(5, 2) - 1).when(kind == "phone", dialled)
    right = F.when(kind == "date", day % 773).when(kind == "ip", octet(3) * 256 + octet(4)).when(kind == "ssn", number(8, 4) - 1).when(kind == "phone", F.substring(digits, 7, 4).cast("long"))
    first, last = (reduce(lambda c, k: c.when(kind == k, F.lit(_PAIRS[k][side])), _PAIRS, F.when(F.lit(False), F.lit(1))) for side in (0, 1))
    sizes = (first.when(kind == "phone", F.when(in_plan, 640_000).otherwise(360_000)), last.when(kind == "phone", F.lit(10_000)))

    def shown(x: Column) -> Column:
        chars, left, right = x["chars"], x["pair"]["l"], x["pair"]["r"]
        found = F.date_add(F.lit(_DAY_ZERO).cast("date"), (left * 773 + right).cast("int"))
        octets = F.concat_ws(".", *(n.cast("string") for n in (F.floor(left / 256), left % 256, F.floor(right / 256), right % 256)))
        place = F.floor(left / 99) + 1
        ssn = F.format_string("%03d-%02d-%04d", (place + (place >= 666).cast("long")).cast("long"), left % 99 + 1, right + 1)
        national = F.regexp_replace(value, _COUNTRY_CODE, "")
        before = F.when(in_plan, (F.floor(left / 800) + 200) * 1000 + left % 800 + 200).when(left < 200_000, left).otherwise((F.floor((left - 200_000) / 200) + 200) * 1000 + (left - 200_000) % 200)
        phone = F.format_string("%06d%04d", before.cast("long"), right)
        return (
            F.when(kind == "email", F.concat(chars, F.regexp_extract(value, _TOP_LEVEL, 0)))
            .when(kind == "phone", F.concat(F.regexp_extract(value, _COUNTRY_CODE, 0), _into(national, phone, "^[0-9]$")))
            .when(kind == "card", common.let(_checked_card(chars), lambda n: _into(value, n, "^[0-9]$")))
            .when(kind == "iban", common.let(_checked_account(F.substring(value, F.lit(1), F.lit(2)), chars), lambda n: _into(value, n, "^[A-Z0-9]$")))
            .when(kind == "date", F.when(F.contains(value, F.lit("-")), F.date_format(found, "yyyy-MM-dd")).otherwise(F.date_format(found, "dd.MM.yyyy")))
            .when(kind == "ip", octets)
            .when(kind == "ssn", ssn)
            .otherwise(value)
        )

    chars = common.let(F.coalesce(body, F.lit("")), lambda c: permute_chars(c, key, forward))
    pair = common.let(F.struct(left.alias("l"), right.alias("r"), sizes[0].alias("a"), sizes[1].alias("b")), lambda p: permute_pair(p["l"], p["r"], (p["a"], p["b"]), key, forward))
    return common.let(F.struct(chars.alias("chars"), pair.alias("pair")), shown)


def _checked(text: Column) -> Column:
    """Distinct grouped card and account numbers of the text that pass their checks, the longest first."""
    none = F.array().cast("array<string>")
    of = lambda patterns: F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    cards = F.filter(of(CARD_SPANS), lambda v: card_valid(F.regexp_replace(v, "[^0-9]", "")))
    compact = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    in_country = lambda v: F.concat(F.substring(v, 1, 2), F.char_length(compact(v)).cast("string")).isin([f"{name}{n}" for n, names in IBAN_LENGTHS.items() for name in names])
    accounts = F.concat(F.regexp_extract_all(text, F.lit(GROUPED_ACCOUNT), F.lit(0)), F.filter(of(IBAN_SPANS), in_country))
    accounts = F.filter(accounts, lambda v: mod97(compact(v)) == 1)
    found = F.array_distinct(F.concat(F.when(text.rlike(GROUPED_CARD), cards).otherwise(none), F.when(text.rlike(GROUPED_ACCOUNT), accounts).otherwise(none)))
    return F.array_sort(found, lambda a, b: F.char_length(b) - F.char_length(a))


def _found(text: Column) -> Column:
    """What :func:`common.located` finds of :data:`OTHERS` and of the grouped numbers that pass their checks."""
    grouped = text.rlike(_MAY_BE_GROUPED) & text.rlike(f"{GROUPED_CARD}|{GROUPED_ACCOUNT}")
    numbers = F.when(grouped, _checked(text)).otherwise(F.array().cast("array<string>"))
    alone = F.when(text.rlike(_MAY_STAND_ALONE), OTHERS + ALONE).otherwise(OTHERS)
    wanted = lambda n: F.when(F.size(n) == 0, alone).otherwise(F.concat(alone, F.lit("|(?<![0-9A-Za-z])(?:"), F.array_join(n, "|"), F.lit(")(?![0-9A-Za-z])")))
    return common.let(common.let(numbers, wanted), lambda p: common.located(text, p))


def kind_of(value: Column) -> Column:
    """The kind of a value that :func:`_found` found, or null where its validation fails."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    ssn_ok = ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    date_ok = _date(value).between(F.lit("1900-01-01").cast("date"), F.lit("2299-12-31").cast("date"))
    octets_ok = F.forall(F.split(value, r"\."), lambda o: (o.try_cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets_ok, F.lit("ip")))
        .when(value.rlike(f"^(?:{DATE})$"), F.when(date_ok, F.lit("date")))
        .when(value.rlike(f"^(?:{SSN})$"), F.when(ssn_ok, F.lit("ssn")))
        .when(value.rlike("^[A-Z]"), F.when(mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1, F.lit("iban")))
        .when(value.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
        .when(F.char_length(digits).between(13, 19), F.when(card_valid(digits), F.lit("card")))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym; with a null kind the value itself."""
    return F.when(kind.isNull(), value).otherwise(permute(value, kind, key))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten, ``pii``: array<struct<start,end,kind,pseudonym>> in the
    original's code points, and ``n_<kind>`` for each kind."""
    at, result = common.unused(docs, "located"), common.unused(docs, "result")
    found = docs.withColumn(at, _found(docs["text"]))  # in steps, for the analyzer resolves one level of lambdas a round
    text, gaps = found["text"], found[at]["gaps"]
    none = F.array().cast("array<struct<start:int,end:int,kind:string,pseudonym:string>>")

    def judged(s: Column) -> Column:
        return common.let(kind_of(s["text"]), lambda k: F.struct(s["start"].alias("start"), s["end"].alias("end"), k.alias("kind"), pseudonym(s["text"], k, key).alias("pseudonym")))

    def rewritten(spans: Column) -> Column:
        parts = F.transform(spans, lambda s, i: F.concat(F.get(gaps, i), s["pseudonym"]))
        return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))

    both = lambda spans: F.struct(rewritten(spans).alias("text"), F.filter(spans, lambda s: s["kind"].isNotNull()).alias("pii"))
    row = F.when(found[at].isNull(), F.struct(text.alias("text"), none.alias("pii"))).otherwise(common.let(F.transform(found[at]["found"], judged), both))
    others = [c for c in docs.columns if c.lower() not in ("text", "pii", *(f"n_{k}" for k in KINDS))]
    counts = [common.count_kind(f"{result}.pii", k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(*others, row.alias(result)).select(*others, f"{result}.text", f"{result}.pii", *counts)


KEY_SETTING = "spark.driftgram.pii.key"


def query(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    out = pseudonymise(common.table(spark, sf_dir, "documents"), key)
    listed = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["pseudonym"])), ",")
    return out.select("doc_id", "text", *(f"n_{k}" for k in KINDS), listed.alias("pseudonyms"))
