"""Weighted votes of codes, for all 64 bits at once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def voted(rows: DataFrame, codes: list[tuple[str, int, int]], name: str) -> DataFrame:
    """Adds the code whose bits are those that win: of the columns (code, weight for, weight against) those with
    the bit outweigh the others without it. Null and zero codes don't vote.

    A bit wins if the weights for and against of the codes that have it exceed what all voting codes have
    against it. The sums are kept as planes: the k-th plane holds the k-th binary digit of all 64 sums, so
    that adding a weight is a few operations on whole codes. Each step is a projection of its own, since
    Catalyst copies an expression wherever it is used.
    """
    width = sum(p + q for _, p, q in codes).bit_length()
    keep, planes = [f"`{c}`" for c in rows.columns], [f"_plane{k}" for k in range(width)]
    against = " + ".join(f"IF(coalesce(`{code}`, 0L) <> 0, {q}L, 0L)" for code, _, q in codes)
    now = rows.selectExpr(*keep, f"{against} AS _against", *[f"0L AS {x}" for x in planes])
    for code, p, q in codes:
        for low in (k for k in range(width) if (p + q) >> k & 1):
            carry, out = f"coalesce(`{code}`, 0L)", []
            for k, plane in enumerate(planes):
                if k < low:
                    out.append(plane)
                    continue
                out.append(f"{plane} ^ ({carry}) AS {plane}")
                carry = f"{carry} & {plane}"
            now = now.selectExpr(*keep, "_against", *out)
    # a sum is greater if it has the highest digit in which it differs from the bound
    greater, equal = [], "-1L"
    for k in reversed(range(width)):
        digit = f"(-(shiftrightunsigned(_against, {k}) & 1L))"
        greater.append(f"({equal} & {planes[k]} & ~{digit})")
        equal = f"{equal} & ~({planes[k]} ^ {digit})"
    return now.selectExpr(*keep, f"{' | '.join(greater)} AS `{name}`")
