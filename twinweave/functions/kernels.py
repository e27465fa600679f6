"""64-bit similarity hashes of values, as Column expressions.

A code is a BIGINT whose bits are features of the value. Positions are taken modulo 64, so only the low
six bits of a 32-bit hash are ever needed and are folded as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def or_of(codes: Column) -> Column:
    """OR of an array of codes; 0 for none."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _byte(raw: Column, i: Column) -> Column:
    """The i-th byte (from 1), A-Z as lower case."""
    value = F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int")
    return let(value, lambda b: F.when(b.between(65, 90), b + 32).otherwise(b))


def string_code(text: Column, n: int = 2) -> Column:
    """One bit for each run of n bytes; a single byte sets its own bit; null and empty give 0."""

    def of(raw: Column) -> Column:
        size = F.octet_length(raw)

        def gram(i: Column) -> Column:
            places = F.sequence(i, F.least(i + (n - 1), size))
            return bit(F.aggregate(places, F.lit(0), lambda acc, j: (acc * 23 + _byte(raw, j)) % 64))

        many = or_of(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), gram))
        return F.when(size == 0, F.lit(0).cast("long")).when(size == 1, bit(_byte(raw, F.lit(1)) % 64)).otherwise(many)

    return F.coalesce(let(F.encode(text, "UTF-8"), of), F.lit(0).cast("long"))


def string_position(text: Column) -> Column:
    """The low six bits of the polynomial (base 31) over the UTF-16 units."""

    def of(raw: Column) -> Column:
        units = F.floor(F.octet_length(raw) / 2).cast("int")

        def add(acc: Column, k: Column) -> Column:
            low = F.conv(F.hex(F.substr(raw, k * 2, F.lit(1))), 16, 10).cast("int")
            return (acc * 31 + low) % 64

        return F.when(units == 0, 0).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(units, F.lit(1))), F.lit(0), add)
        )

    return let(F.encode(text, "UTF-16BE"), of)


def long_position(value: Column) -> Column:
    """The low six bits of a 64-bit number folded to 32 bits."""
    v = value.cast("long")
    return v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _guessed(size: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1074)), F.lit(1024)).cast("int")


def _exponent(size: Column, guess: Column) -> Column:
    """The logarithm's guess, put right where rounding took it past a power of two."""
    up = F.pow(F.lit(2.0), guess)
    return F.when(up > size, guess - 1).when(up * 2 <= size, guess + 1).otherwise(guess)


def _bits(value: Column, exponent: Column) -> Column:
    size, below = F.abs(value), exponent < -1022
    scaled = size / F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-1022)))
    mantissa = ((scaled - F.when(below, 0.0).otherwise(1.0)) * float(1 << 52)).cast("long")
    normal = F.shiftleft(F.when(below, 0).otherwise(exponent + 1023).cast("long"), 52).bitwiseOR(mantissa)
    sign = F.when(value < 0, F.lit(-(1 << 63))).otherwise(F.lit(0)).cast("long")
    special = F.when(F.isnan(value), 0x7FF << 52 | 1 << 51).when(size == float("inf"), sign.bitwiseOR(F.lit(0x7FF << 52))).when(size == 0, 0)
    return F.coalesce(special, sign.bitwiseOR(normal)).cast("long")


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as a signed number, by arithmetic: sign, exponent, mantissa. (-0.0 counts as 0.0.)"""
    return let(
        value.cast("double"),
        lambda v: let(_exponent(F.abs(v), _guessed(F.abs(v))), lambda e: _bits(v, e)),
    )


def with_double_bits(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds _bits_<name> for each double column: as double_bits, in projections that are generated code."""
    if not names:
        return rows
    keep = rows.columns
    first = rows.select(*keep, *[_guessed(F.abs(n)).alias(f"_guess_{n}") for n in names])
    second = first.select(*keep, *[_exponent(F.abs(n), F.col(f"_guess_{n}")).alias(f"_exponent_{n}") for n in names])
    return second.select(*keep, *[_bits(F.col(n), F.col(f"_exponent_{n}")).alias(f"_bits_{n}") for n in names])


def _folded32(bits: Column) -> Column:
    """A 64-bit number folded to 32 bits, as a signed number."""
    low = bits.bitwiseXOR(F.shiftrightunsigned(bits, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def number_hash(value: Column, double: bool = False) -> Column:
    """A number's 32-bit hash as a signed 64-bit number: folded, of a double its bits; null stays null."""
    return _folded32(double_bits(value.cast("double")) if double else value.cast("long"))


def boolean_hash(value: Column) -> Column:
    return F.when(value.isNull(), 0).when(value, 1231).otherwise(1237).cast("long")


def boolean_position(value: Column) -> Column:
    return F.when(value, 1231 % 64).otherwise(1237 % 64)


def name_position(name: str) -> int:
    """string_position of a literal."""
    h = 0
    raw = name.encode("utf-16-be")
    for low in raw[1::2]:
        h = (h * 31 + low) % 64
    return h


def onehot(position: Column) -> Column:
    return bit(position)


def salted(feature: str, position: Column) -> Column:
    """A value's bit, moved by its feature's name."""
    return bit((F.lit(name_position(feature) * 31) + position) % 64)


def has_bit(code: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", code, k.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def _from_bits(keep: Callable[[Column], Column]) -> Column:
    """The code whose bit k is set where keep(k)."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, k: F.when(keep(k), acc.bitwiseOR(bit(k))).otherwise(acc)
    )


def majority(codes: Column, small_or: bool = True) -> Column:
    """Bits that more than half of the codes have; with small_or, one or two codes are OR-ed."""
    count = F.size(codes)
    votes = _from_bits(lambda k: F.size(F.filter(codes, lambda c: has_bit(c, k) == 1)) > F.floor(count / 2))
    return F.when(count <= 2, or_of(codes)).otherwise(votes) if small_or else votes


def weighted_vote(features: Column) -> Column:
    """From an array of (code, pos, neg): bits whose features outweigh those without it; zero codes don't vote."""
    voting = F.filter(features, lambda x: x["code"] != 0)
    against = F.aggregate(voting, F.lit(0), lambda acc, x: acc + x["neg"])

    def keep(k: Column) -> Column:
        for_ = F.aggregate(
            voting, F.lit(0), lambda acc, x: acc + F.when(has_bit(x["code"], k) == 1, x["pos"] + x["neg"]).otherwise(0)
        )
        return for_ > against

    return _from_bits(keep)


def rotated(code: Column, places: int, carried: int) -> Column:
    """Shifted right, with so many of the low bits carried to the top places."""
    low = code.bitwiseAND(F.lit((1 << carried) - 1).cast("long"))
    return F.shiftrightunsigned(code, places).bitwiseOR(F.shiftleft(low, 64 - places))


def rotated3(code: Column) -> Column:
    """By 3 places; of the three low bits only two come back, which the codes depend on."""
    return rotated(code, 3, 2)


def rotated5(code: Column) -> Column:
    return rotated(code, 5, 5)


def rotated7(code: Column) -> Column:
    return rotated(code, 7, 7)


def strengthened(code: Column) -> Column:
    return code.bitwiseOR(rotated3(code))


def pattern(code: Column, depth: int) -> Column:
    """Popcounts of the 2 ** depth equal parts of a code, the lowest first."""
    width = 64 >> depth
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    parts = [F.bit_count(F.shiftrightunsigned(code, k * width).bitwiseAND(mask)) for k in range(1 << depth)]
    return F.array(*parts)


def binary(code: Column) -> Column:
    return F.lpad(F.bin(code), 64, "0")


def ngrams(text: Column, n: int = 2) -> Column:
    """Runs of n characters; a text of at most n is one, null or empty has none."""
    size = F.length(text)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    none = F.array().cast("array<string>")
    return F.when(size <= n, F.when(size > 0, F.array(text)).otherwise(none)).otherwise(F.coalesce(many, none))


def string_hash(text: Column) -> Column:
    """The whole 32-bit polynomial (base 31) over the UTF-16 units, as a signed 64-bit number; null gives 0."""

    def of(raw: Column) -> Column:
        units = F.floor(F.octet_length(raw) / 2).cast("int")

        def add(acc: Column, k: Column) -> Column:
            unit = F.conv(F.hex(F.substr(raw, k * 2 - 1, F.lit(2))), 16, 10).cast("long")
            return (acc * 31 + unit) % (1 << 32)

        zero = F.lit(0).cast("long")
        whole = F.when(units == 0, zero).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(units, F.lit(1))), zero, add))
        return let(whole, lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))

    return F.coalesce(let(F.encode(text, "UTF-16BE"), of), F.lit(0).cast("long"))


def pyramid(code: Column, depth: int) -> Column:
    """Patterns from the finest to the whole, one after the other: each is the finer one's pairwise sums."""
    return F.concat(*[pattern(code, d) for d in range(depth, -1, -1)])


def _halved(first: Column, end: Column, depth: int) -> list[tuple[Column, Column]]:
    """The 2 ** depth parts of a range that is cut in halves again and again, the lower half rounded down."""
    if depth == 0:
        return [(first, end)]
    middle = F.floor((first + end) / 2).cast("int")
    return _halved(first, middle, depth - 1) + _halved(middle, end, depth - 1)


def array_pattern(values: Column, depth: int) -> Column:
    """Sums of the 2 ** depth parts of an array of numbers."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.array(*[total(F.slice(values, a + 1, b - a)) for a, b in _halved(F.lit(0), F.size(values), depth)])


def set_pattern(values: Column, depth: int, world: int) -> Column:
    """How many numbers of a set (from 0 to world) lie in each of 2 ** depth parts; an upper bound belongs to its part."""
    parts = _halved(F.lit(0), F.lit(world), depth)
    within = lambda a, b, k: F.size(F.filter(values, lambda x: (x <= b) & ((x > a) if k else F.lit(True))))
    return F.array(*[within(a, b, k) for k, (a, b) in enumerate(parts)])


def pattern_abstract(pattern_: Column) -> Column:
    """The pattern of half the depth's parts: pairwise sums."""
    halves = F.sequence(F.lit(0), (F.size(pattern_) / 2 - 1).cast("int"))
    return F.transform(halves, lambda k: F.get(pattern_, k * 2) + F.get(pattern_, k * 2 + 1))


def pattern_matches(a: Column, b: Column, low: int, high: int) -> Column:
    """Whether the distance of two patterns lies within the bounds."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    return apart.between(low, high)


def tree_radius(bits: Column, least: Column, most: int = 13) -> Column:
    """The Hamming radius of a weight-tree search for a code with so many bits and a least similarity."""
    return F.least(F.ceil(bits * (1 + 1 / least - F.sqrt(least)) / 2), F.lit(most)).cast("int")
