"""Format-preserving pseudonyms for personal numbers and dates, by Feistel networks in DataFrame functions.

A value found in a text is validated, then permuted under a key within its own format: a card number
stays a number of that length that passes the Luhn test, a date a date that exists, an address an address.
The permutation depends on the value alone, so equal values stay linked across documents and spellings
(with or without separators), different values never meet, and with the key it can be undone.

Found and validated: payment cards (Luhn; also among other groups of digits, if they have a card's layout),
IBANs (their country's length, mod 97), US social security numbers (number ranges), IPv4 addresses (octets;
loopback and the all-zero and all-one addresses stay), telephone numbers (8 to 15 digits; the country code
stays), dates that exist from 1800 to 2199 (2001-02-03, 2001/2/3, 03.02.2001, 02/03/2001 month first if that
exists, else day first, and with a month's name in English, German, French or Spanish), mail addresses (the
part before @) and hexadecimal secrets in assignments. All else stays as it is.

The key comes from the session's setting KEY_SETTING. Without one a key is made for the application, whose
pseudonyms can't be linked to those of another one.

Defined cases: a null text stays null with no pseudonyms; a text without such values stays unchanged; very
long texts are searched whole; equal or repeated rows get equal results; an empty table gives no rows;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import fresh_names, table

KEY_SETTING = "spark.twinweave.pii.key"
ROUNDS = 10
#: Keys made for applications that set none.
_MADE: dict[str, str] = {}

#: How many characters an IBAN has, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL OM SO TL AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG",
    25: "PT ST LY", 26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO SV GT HU LB NI PL",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Month names.
MONTHS = (
    "January February March April May June July August September October November December",
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
_NAMES = [name for names in MONTHS for name in names.split()]
_MONTH = "|".join(sorted(set(_NAMES), key=lambda x: (-len(x), x)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Day, month's name, year; and name, day, year.
_DAY_FIRST = rf"(\d{{1,2}})((?:\.|er|º)? (?:de )?)({_MONTH})(\.? (?:del? )?)(\d{{4}})"
_MONTH_FIRST = rf"({_MONTH})(\.? )(\d{{1,2}})(, )(\d{{4}})"
PATTERN = "|".join(
    (
        # mail
        r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
        # IBAN
        r"(?=[A-Z]{2}\d{2})(?<![\p{L}\p{N}])(?:"
        + "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
        + r")(?![\p{L}\p{N}])",
        # secret
        r"(?=[0-9A-Fa-f]{16})(?<=(?i:token|secret|key|password) {0,2}[=:] {0,2}[\"'])[0-9A-Fa-f]{16,}+(?=[\"'])",
        # dates
        r"(?<![\d.-])\d{4}([-/])\d{1,2}\1\d{1,2}(?![\d-])",
        r"(?<![\d./-])\d{1,2}([./])\d{1,2}\2\d{4}(?!\d)",
        rf"(?=\d{{1,2}}(?:\.|er|º)? )(?<!\d){_DAY_FIRST.replace('(', '(?:').replace('(?:?:', '(?:')}(?!\d)",
        rf"(?=[JFMASOND][a-z]{{2}})(?<![\p{{L}}]){_MONTH_FIRST.replace('(', '(?:').replace('(?:?:', '(?:')}(?!\d)",
        # social security number
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        # address
        rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
        # telephone
        r"(?<![\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
        r"(?<![\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
        # a number as long as a card's, and groups of digits that may hold cards
        r"(?<![\p{N}])\d{13,19}(?![\p{N}])",
        r"(?<![\p{N}])\d(?:[ -]?\d){12,}+(?![\p{N}])",
    )
)


def key_of(spark: SparkSession) -> str:
    """The key that the session's setting names, or one made for the application."""
    key = spark.conf.get(KEY_SETTING, None)
    return key or _MADE.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def _joined(count: Column, char: Callable[[Column], Column]) -> Column:
    """The characters at 1 to count; an empty string for 0."""
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), count), char), "")).otherwise("")


def _number(digest: Column, at: Column | int, digits: int) -> Column:
    return F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


#: First code point and size of each class of characters that is permuted within itself.
_CLASSES = ((48, 10), (97, 26), (65, 26), (0xE0, 23), (0xF8, 8), (0xC0, 23), (0xD8, 7))
_HEX = "0123456789abcdef"


def _rotate(char: Column, by: Column) -> Column:
    """The character so many places on within its class."""
    point = F.ascii(char)
    out = char
    for first, size in _CLASSES:
        moved = F.char((F.pmod(point - first + by, F.lit(size)) + first).cast("long"))
        out = F.when(point.between(first, first + size - 1), moved).otherwise(out)
    return out


def _rotate_hex(char: Column, by: Column) -> Column:
    place = F.instr(F.lit(_HEX), char) - 1
    return F.substr(F.lit(_HEX), (F.pmod(place + by, F.lit(16)) + 1).cast("int"), F.lit(1))


def permuted(value: Column, key: str, kind: str, rotate: Callable[[Column, Column], Column] = _rotate) -> Column:
    """A Feistel network over characters: each half in turn moves by amounts that depend on the other."""

    def moved(half: Column, other: Column, round_: Column) -> Column:
        def char(i: Column) -> Column:
            block = F.floor((i - 1) / 16)
            amount = _number(_digest(key, kind, round_, block, F.length(half), other), (i - 1) % 16 * 4 + 1, 4)
            return rotate(F.substr(half, i, F.lit(1)), amount)

        return _joined(F.length(half), char)

    def step(state: Column, round_: Column) -> Column:
        left, right = state["left"], state["right"]
        even = round_ % 2 == 0
        return F.struct(
            F.when(even, moved(left, right, round_)).otherwise(left).alias("left"),
            F.when(even, right).otherwise(moved(right, left, round_)).alias("right"),
        )

    cut = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("left"), F.substr(value, cut + 1).alias("right"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["left"], s["right"])
    )


def permuted_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A Feistel network over two numbers below the given sizes; any product of sizes is its domain."""

    def step(state: Column, round_: Column) -> Column:
        a, b = state["left"], state["right"]
        even = round_ % 2 == 0
        by_b, by_a = _number(_digest(key, kind, round_, b), 1, 12), _number(_digest(key, kind, round_, a), 1, 12)
        return F.struct(
            F.when(even, (a + by_b) % sizes[0]).otherwise(a).alias("left"),
            F.when(even, b).otherwise((b + by_a) % sizes[1]).alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _only(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, F.lit(f"[^{pattern}]"), F.lit(""))


def laid_out(template: Column, chars: Column, pattern: str) -> Column:
    """The template with its characters of the pattern replaced, in order."""

    def char(i: Column) -> Column:
        own = F.substr(template, i, F.lit(1))
        nth = F.length(_only(F.substr(template, F.lit(1), i), pattern))
        return F.when(own.rlike(f"[{pattern}]"), F.substr(chars, nth, F.lit(1))).otherwise(own)

    return _joined(F.length(template), char)


def luhn_digit(payload: Column) -> Column:
    """The check digit of a number without it."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(payload, F.length(payload) + 1 - i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return (F.pmod(-total, F.lit(10))).cast("string")


def iban_rest(value: Column) -> Column:
    """An IBAN's characters from the fifth on, then the first four, as a number modulo 97."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        char = F.substr(turned, i, F.lit(1))
        letter = char.rlike("[A-Z]")
        return F.when(letter, (rest * 100 + F.ascii(char) - 55) % 97).otherwise(
            (rest * 10 + F.ascii(char) - 48) % 97
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


#: Groups of digits of a card with separators: Visa and others, longer ones, American Express, Diners Club.
_LAYOUTS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))


def _is_card(digits: Column) -> Column:
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    return F.length(digits).between(13, 19) & (luhn_digit(payload) == F.substr(digits, F.length(digits), F.lit(1)))


def _new_card(digits: Column, key: str) -> Column:
    return let(permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card"), lambda p: F.concat(p, luhn_digit(p)))


def card(value: Column, key: str) -> Column:
    """The groups that are cards by layout, from the left, each group in one card at most; else all digits together."""

    def by_groups(groups: Column) -> Column:
        sizes = F.transform(groups, F.length)

        def cards_at(i: Column) -> Column:
            """How many groups from the i-th on are a card, 0 if none."""
            found = F.lit(0)
            for layout in reversed((*_LAYOUTS, None)):
                n = len(layout) if layout else 1
                own = F.slice(sizes, i, F.lit(n))
                shape = own == F.array(*map(F.lit, layout)) if layout else F.element_at(sizes, i).between(13, 19)
                fits = (i + n - 1 <= F.size(groups)) & shape
                found = F.when(F.when(fits, _is_card(F.array_join(F.slice(groups, i, F.lit(n)), ""))).otherwise(False), n).otherwise(found)
            return found

        def step(state: Column, x: Column) -> Column:
            """state: the first group that is free, the digits so far."""
            i, n = x["i"], x["n"]
            new = _new_card(F.array_join(F.slice(groups, i, n), ""), key)
            own = F.when(i < state["next"], "").when(n > 0, new).otherwise(F.element_at(groups, i))
            after = F.when((i >= state["next"]) & (n > 0), i + n).otherwise(state["next"])
            return F.struct(after.alias("next"), F.concat(state["digits"], own).alias("digits"))

        places = F.sequence(F.lit(1), F.size(groups))
        return let(
            F.transform(places, lambda i: F.struct(i.alias("i"), cards_at(i).alias("n"))),
            lambda found: F.when(
                F.exists(found, lambda x: x["n"] > 0),
                F.aggregate(found, F.struct(F.lit(1).alias("next"), F.lit("").alias("digits")), step, lambda s: s["digits"]),
            ),
        )

    def of(digits: Column) -> Column:
        groups = let(F.split(value, "[ -]"), by_groups)
        whole = F.when(F.when(F.length(digits) <= 19, _is_card(digits)).otherwise(False), _new_card(digits, key))
        return let(F.coalesce(groups, whole), lambda new: F.when(new.isNotNull(), laid_out(value, new, "0-9")).otherwise(value))

    return let(_only(value, "0-9"), of)


def iban(value: Column, key: str) -> Column:
    def of(chars: Column) -> Column:
        country = F.substr(chars, F.lit(1), F.lit(2))

        def with_check(account: Column) -> Column:
            check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
            return laid_out(value, F.concat(country, check, account), "A-Z0-9")

        new = let(permuted(F.substr(chars, F.lit(5)), key, "iban"), with_check)
        return F.when(iban_rest(chars) == 1, new).otherwise(value)

    return let(_only(value, "A-Z0-9"), of)


#: Areas 001 to 899 without 666, times groups 01 to 99; serials 0001 to 9999.
_SSN = (898 * 99, 9999)


def social_security(value: Column, key: str) -> Column:
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)

    def shown(s: Column) -> Column:
        k = F.floor(s["left"] / 99)
        return F.format_string("%03d-%02d-%04d", k + 1 + F.when(k >= 665, 1).otherwise(0), s["left"] % 99 + 1, s["right"] + 1)

    return F.when(valid, let(permuted_pair(place * 99 + group - 1, serial - 1, _SSN, key, "ssn"), shown)).otherwise(value)


def address(value: Column, key: str) -> Column:
    octet = [F.split_part(value, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    stays = value.startswith("127.") | value.isin("0.0.0.0", "255.255.255.255")

    def shown(s: Column) -> Column:
        parts = (F.floor(s["left"] / 256), s["left"] % 256, F.floor(s["right"] / 256), s["right"] % 256)
        return F.concat_ws(".", *[x.cast("string") for x in parts])

    pair = permuted_pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], (65536, 65536), key, "address")
    return F.when(stays, value).otherwise(let(pair, shown))


def telephone(value: Column, key: str) -> Column:
    """The digits after the country code; zones 1 and 7 have one digit, others count as two."""
    digits = F.length(_only(value, "0-9"))
    code = F.regexp_extract(value, r"^\+(?:[17]|\d{2})", 0)
    rest = F.substr(value, F.length(code) + 1)
    new = let(permuted(_only(rest, "0-9"), key, "telephone"), lambda p: F.concat(code, laid_out(rest, p, "0-9")))
    return F.when(digits.between(8, 15), new).otherwise(value)


#: Days of 400 Gregorian years: 189 * 773. They begin with 1800-01-01.
_DAYS = (189, 773)


def _moved(day: Column, key: str, shown: Callable[[Column], Column]) -> Column:
    """shown(the day's pseudonym); null for no day or one that is out of range."""
    start = F.unix_date(F.lit("1800-01-01").cast("date"))

    def of(n: Column) -> Column:
        pair = permuted_pair(F.floor(n / _DAYS[1]), n % _DAYS[1], _DAYS, key, "date")
        new = let(pair, lambda s: shown(F.date_from_unix_date((s["left"] * _DAYS[1] + s["right"] + start).cast("int"))))
        return F.when(n.between(0, _DAYS[0] * _DAYS[1] - 1), new)

    return let(F.unix_date(day) - start, of)


def _named(value: Column, key: str, pattern: str, day: int, month: int) -> Column:
    """A date with a month's name, whose groups of the pattern are the day's, the month's, what lies between, and last the year."""
    part = [F.regexp_extract(value, pattern, k) for k in range(1, 6)]
    names, place = F.array(*map(F.lit, _NAMES)), F.array_position(F.array(*map(F.lit, _NAMES)), part[month])
    form = F.floor((place - 1) / 12) * 12
    text = F.concat_ws("-", part[4], F.lpad(((place - 1) % 12 + 1).cast("string"), 2, "0"), F.lpad(part[day], 2, "0"))

    def shown(new: Column) -> Column:
        cells = list(part)
        cells[day] = F.dayofmonth(new).cast("string")
        cells[month] = F.element_at(names, (form + F.month(new)).cast("int"))
        cells[4] = F.year(new).cast("string")
        if day == 0:  # only the first of a month is an ordinal in French
            cells[1] = F.when(F.dayofmonth(new) != 1, F.regexp_replace(part[1], "^er", "")).otherwise(part[1])
        return F.concat(*cells)

    return F.coalesce(_moved(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), key, shown), value)


def date(value: Column, key: str) -> Column:
    def parsed(fmt: Column) -> Column:
        return F.try_to_timestamp(value, fmt).cast("date")

    def first_that_exists(a: str, b: str) -> Column:
        return F.when(parsed(F.lit(a)).isNotNull(), a).otherwise(b)

    shapes = [
        (r"^\d{4}-\d{2}-\d{2}$", F.lit("yyyy-MM-dd")),
        (r"^\d{4}-", F.lit("yyyy-M-d")),
        (r"^\d{4}/\d{2}/\d{2}$", F.lit("yyyy/MM/dd")),
        (r"^\d{4}/", F.lit("yyyy/M/d")),
        (r"^\d{2}\.\d{2}\.", F.lit("dd.MM.yyyy")),
        (r"^\d{1,2}\.\d{1,2}\.", F.lit("d.M.yyyy")),
        (r"^\d{2}/\d{2}/", first_that_exists("MM/dd/yyyy", "dd/MM/yyyy")),
    ]
    form = first_that_exists("M/d/yyyy", "d/M/yyyy")
    for shape, fmt in reversed(shapes):
        form = F.when(value.rlike(shape), fmt).otherwise(form)
    numbers = let(form, lambda fmt: F.coalesce(_moved(parsed(fmt), key, lambda day: F.call_function("date_format", day, fmt)), value))
    named = F.when(value.rlike(r"^\d"), _named(value, key, _DAY_FIRST, 0, 2)).otherwise(_named(value, key, _MONTH_FIRST, 2, 0))
    return F.when(value.rlike(r"\p{L}"), named).otherwise(numbers)


def mail(value: Column, key: str) -> Column:
    name = F.split_part(value, F.lit("@"), F.lit(1))
    return F.concat(permuted(name, key, "mail"), F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))


def secret(value: Column, key: str) -> Column:
    new = permuted(F.lower(value), key, "secret", _rotate_hex)
    return F.when(value == F.upper(value), F.upper(new)).otherwise(new)


def pseudonym(value: Column, key: str) -> Column:
    """By the shape of what PATTERN found."""
    kinds = [
        (F.contains(value, F.lit("@")), mail),
        (value.rlike(r"^[A-Z]{2}\d{2}"), iban),
        (value.rlike(r"^(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4}|.*\p{Ll}{2}.* .*)$"), date),
        (value.rlike(r"^\d{3}-\d{2}-\d{4}$"), social_security),
        (value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), address),
        (value.rlike(r"^(?:\+.*|\(.*|\d{3}[.-]\d{3}[.-]\d{4})$"), telephone),
        (value.rlike(r"^[0-9 -]+$") & (F.length(_only(value, "0-9")) > 12), card),
    ]
    out = secret(value, key)
    for shape, replace in reversed(kinds):
        out = F.when(shape, replace(value, key)).otherwise(out)
    return out


def pseudonymized(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns, the text's values replaced, and n_pseudonyms."""
    text, pattern = F.col(column), F.lit(PATTERN)
    # without a digit or an @ there is nothing to find
    may = text.rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = fresh_names(docs, "found", "new", "gaps")
    parts = docs.withColumn(names["found"], found)
    new = F.transform(names["found"], lambda m: pseudonym(m, key))
    any_ = F.size(names["found"]) > 0
    parts = parts.withColumn(names["new"], new).withColumn(names["gaps"], F.when(any_, F.split(text, PATTERN, -1)))
    # gap, value, gap, value, ..., gap
    woven = F.zip_with(names["gaps"], names["new"], lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    changed = F.zip_with(names["found"], names["new"], lambda a, b: F.when(a != b, 1))
    out = parts.withColumn(column, F.when(any_, F.array_join(woven, "")).otherwise(text))
    return out.withColumn("n_pseudonyms", F.size(F.array_compact(changed)).cast("long")).drop(*names.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents"), key_of(spark)).select("doc_id", "text", "n_pseudonyms")
