"""What several operators share: reading tables, cutting lineage, fixed folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.storage import removed, shared_folder, shuffles_released, table, written

__all__ = ["batches_of", "fold", "fresh_names", "lots", "removed", "shared_folder", "shuffles_released", "table", "text_or_empty", "written"]

#: Rows and characters that a task works on at once. (Spark bounds Arrow batches by rows and bytes.)
LOT_ROWS, LOT_CHARS = 500, 16_000_000


def lots(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """The frames' rows in lots of at most LOT_ROWS rows, and of LOT_CHARS characters unless a single text has more."""
    for frame in frames:
        first, chars = 0, 0
        for k, size in enumerate(frame[column].str.len()):
            if k > first and (k - first >= LOT_ROWS or chars + size > LOT_CHARS):
                yield frame.iloc[first:k]
                first, chars = k, 0
            chars += size
        if first < len(frame):
            yield frame.iloc[first:]


def fresh_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        out[name] = own
    return out


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def batches_of(rows: Iterator[tuple], columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    """Frames of up to size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)
