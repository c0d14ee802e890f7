"""One rule for all result caps: absent or junk is the default, 0 is all, N is the first N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cap(value, default: int | None) -> int | None:
    """The number of rows to return, or None for all."""
    if isinstance(value, bool):
        return default
    try:
        n = int(str(value).strip()) if value is not None else None
    except ValueError:
        n = None
    if n is None or n < 0:
        return default
    return None if n == 0 else n


def capped(df: DataFrame, value, default: int | None = None) -> DataFrame:
    """`df` must be ordered in full, so that the first rows are the same every time."""
    n = cap(value, default)
    return df if n is None else df.limit(n)


#: How many items the compact form of a reply keeps, and how many files of a cycle.
DEFAULTS = {"health": 10, "get_cycles": 5, "get_dependents": 50, "prepare_edit": 25, "get_resolution_diagnostics": 20}
CYCLE_FILES = 10


def compact(df: DataFrame, tool: str, value=None) -> tuple[DataFrame, int | None]:
    """The first rows of an ordered reply, and the number of all rows where some are left out."""
    n = cap(value, DEFAULTS.get(tool))
    if n is None:
        return df, None
    total = df.count()
    return df.limit(n), total if total > n else None


def trim_files(cycles: DataFrame, most: int = CYCLE_FILES) -> DataFrame:
    """Cycles with their first `most` files; files_truncated says where some are left out."""
    return cycles.withColumn("files_truncated", F.size("files") > most).withColumn("files", F.slice("files", 1, most))
