"""Similarities and distances of codes, sets and vectors. Where a formula divides 0 by 0, 0 is returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b)).cast("double")


def _ratio(a: Column, b: Column, top: Column, below: Column, equal_is_one: bool = True) -> Column:
    out = F.when(below == 0, 0.0).otherwise(top / F.when(below == 0, 1.0).otherwise(below))
    return F.when(a == b, 1.0).otherwise(out) if equal_is_one else out


def cosine(a: Column, b: Column) -> Column:
    return _ratio(a, b, _common(a, b), F.sqrt((F.bit_count(a) * F.bit_count(b)).cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    return _ratio(a, b, _common(a, b), F.bit_count(a.bitwiseOR(b)).cast("double"))


def sorensen(a: Column, b: Column) -> Column:
    return _ratio(a, b, 2 * _common(a, b), (F.bit_count(a) + F.bit_count(b)).cast("double"))


def simple(a: Column, b: Column) -> Column:
    """Like sorensen, but equal codes aren't 1 by rule."""
    return _ratio(a, b, 2 * _common(a, b), (F.bit_count(a) + F.bit_count(b)).cast("double"), equal_is_one=False)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1.0 - hamming(a, b) / F.lit(64.0)


def set_jaccard(a: Column, b: Column) -> Column:
    both, all_ = F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")
    return F.when(all_ == 0, 0.0).otherwise(both / F.when(all_ == 0, 1.0).otherwise(all_))


def set_hamming(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def l1(a: Column, b: Column) -> Column:
    """Of two arrays of whole numbers of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda acc, x: acc + x)
