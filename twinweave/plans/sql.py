"""Fragments of DuckDB SQL that mean what the Column expressions of the library mean (for ASCII texts)."""

from __future__ import annotations

from twinweave import model


def bit(p: str) -> str:
    return f"(CASE WHEN ({p}) = 63 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << ({p})::INT) END)"


def or_positions(positions: str) -> str:
    """The code with a bit at each of a list's positions."""
    value = "CASE WHEN p = 63 THEN -(9223372036854775808::HUGEINT) ELSE (1::BIGINT << p::INT)::HUGEINT END"
    return f"coalesce(list_sum(list_transform(list_distinct({positions}), lambda p: {value})), 0)::BIGINT"


def string_code(s: str) -> str:
    grams = f"list_transform(range(1, length({s})), lambda i: (ascii(lower({s}[i])) * 23 + ascii(lower({s}[i + 1]))) % 64)"
    one = bit(f"ascii(lower({s})) % 64")
    return f"(CASE WHEN coalesce(length({s}), 0) = 0 THEN 0 WHEN length({s}) = 1 THEN {one} ELSE {or_positions(grams)} END)"


def string_position(s: str) -> str:
    codes = f"list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::BIGINT)"
    return f"list_reduce(list_prepend(0::BIGINT, {codes}), lambda h, c: (h * 31 + c) % 64)"


def long_position(v: str) -> str:
    """For whole numbers below 2 ** 32 that aren't negative."""
    return f"(({v})::BIGINT & 63)"


def double_bits(v: str) -> str:
    """Of a double that is neither zero, infinite, no number nor below the normal ones; zero gives 0."""
    size = f"abs({v}::DOUBLE)"
    e = f"floor(log2({size}))"
    e = f"(CASE WHEN pow(2::DOUBLE, {e}) > {size} THEN {e} - 1 WHEN pow(2::DOUBLE, {e} + 1) <= {size} THEN {e} + 1 ELSE {e} END)"
    bits = f"((({e} + 1023)::BIGINT * 4503599627370496) + (({size} / pow(2::DOUBLE, {e}) - 1) * 4503599627370496::DOUBLE)::BIGINT)"
    return f"(CASE WHEN {v} = 0 THEN 0::BIGINT WHEN {v} < 0 THEN {bits} - 9223372036854775807 - 1 ELSE {bits} END)"


def double_hash(v: str) -> str:
    """The 64 bits folded to 32, as an unsigned number."""
    bits = double_bits(v)
    return f"xor({bits} & 4294967295, ({bits} >> 32) & 4294967295)"


def double_position(v: str) -> str:
    return f"({double_hash(v)} & 63)"


def cosine(a: str, b: str) -> str:
    below = f"(bit_count({a})::DOUBLE * bit_count({b})::DOUBLE)"
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {below} = 0 THEN 0.0::DOUBLE ELSE bit_count({a} & {b})::DOUBLE / sqrt({below}) END)"


def jaccard(a: str, b: str) -> str:
    below = f"bit_count({a} | {b})::DOUBLE"
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {below} = 0 THEN 0.0::DOUBLE ELSE bit_count({a} & {b})::DOUBLE / {below} END)"


def simple(a: str, b: str) -> str:
    below = f"(bit_count({a})::DOUBLE + bit_count({b})::DOUBLE)"
    return f"(CASE WHEN {below} = 0 THEN 0.0::DOUBLE ELSE 2 * bit_count({a} & {b})::DOUBLE / {below} END)"


def sorensen(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {simple(a, b)} END)"


def hamming(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}))::BIGINT"


def kept_bits(condition: str) -> str:
    """The code with each bit b for which the condition holds."""
    return or_positions(f"list_filter(range(0, 64), lambda b: {condition})")


def edit_class(key: str) -> str:
    return model.EDIT_SQL.format(key=key)


EDITED = f"""edited AS (
  SELECT p_partkey, CASE WHEN m BETWEEN 50 AND 149 THEN p_name || ' v2' ELSE p_name END AS p_name, p_brand,
    CASE WHEN m BETWEEN 150 AND 169 THEN 'MOVED' ELSE p_type END AS p_type, p_size, p_retailprice
  FROM (SELECT *, {edit_class("p_partkey")} AS m FROM part) WHERE m >= 50
  UNION ALL
  SELECT p_partkey + {model.CREATED}, reverse(p_name), p_brand, p_type, p_size, p_retailprice
  FROM part WHERE {edit_class("p_partkey")} BETWEEN 170 AND 199
)"""

CODED = f"""l AS (SELECT p_partkey AS id, p_type AS type, {string_code("p_name")} AS code, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part),
{EDITED},
r AS (SELECT p_partkey AS id, p_type AS type, {string_code("p_name")} AS code, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM edited),
lc AS (SELECT type, code, count(*) AS n FROM l GROUP BY ALL), rc AS (SELECT type, code, count(*) AS n FROM r GROUP BY ALL)"""
