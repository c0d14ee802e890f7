"""Changed line ranges between two texts, in lines of the new one."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"
MOST_SPLITS = 64


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def changed_ranges(old_text: str, new_text: str) -> list[tuple[int, int]]:
    """1-based inclusive ranges of the new text that are not common with the old one; CRLF counts as LF.

    Windows of both texts wait on a list. A window sheds what both sides share at its ends and is parted at the first
    new line that occurs once on either side; without such a line it is one range. Where only old lines are left, the
    surviving line beside the gap stands for them. Texts that differ only in their final line feed differ in the last line.
    """
    old_text, new_text = (t.replace("\r\n", "\n") for t in (old_text, new_text))
    if old_text == new_text:
        return []
    old, new = ([] if not t else t.removesuffix("\n").split("\n") for t in (old_text, new_text))
    found: list[tuple[int, int]] = []
    waiting = [(0, len(old), 0, len(new), 0)]
    while waiting:
        a, b, c, d, splits = waiting.pop()
        if splits <= MOST_SPLITS and a < b and c < d:
            while a < b and c < d and old[a] == new[c]:
                a, c = a + 1, c + 1
            while a < b and c < d and old[b - 1] == new[d - 1]:
                b, d = b - 1, d - 1
        if a == b and c == d:
            continue
        if c == d:
            if new:
                line = min(c + 1, len(new))
                found.append((line, line))
            continue
        anchor = None
        if a < b and splits <= MOST_SPLITS:
            here, there = Counter(new[c:d]), Counter(old[a:b])
            anchor = next((j for j in range(c, d) if here[new[j]] == 1 and there[new[j]] == 1), None)
        if anchor is None:
            found.append((c + 1, d))
            continue
        i = old.index(new[anchor], a, b)
        waiting += [(a, i, c, anchor, splits + 1), (i + 1, b, anchor + 1, d, splits + 1)]
    if not found and new:
        found.append((len(new), len(new)))
    return merge_ranges(found)


def _ranges(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in changed_ranges(o, n)] for o, n in zip(old, new)])


def ranges_column(old: Column, new: Column) -> Column:
    return F.pandas_udf(_ranges, RANGES)(F.coalesce(old, F.lit("")), F.coalesce(new, F.lit("")))


def since_baseline(live: DataFrame, baselines: DataFrame) -> DataFrame:
    """(file, text) against (file, text): changed_lines, or the whole file where there is no baseline."""
    from ..functions.text import physical_lines

    d = live.select("file", F.col("text").alias("new")).join(baselines.select("file", F.col("text").alias("old")), "file", "left")
    n = physical_lines(F.col("new")).cast("int")
    whole = F.when(n > 0, F.array(F.struct(F.lit(1).alias("start"), n.alias("end")))).otherwise(F.array().cast(RANGES))
    return d.select("file", F.when(F.col("old").isNull(), whole).otherwise(ranges_column(F.col("old"), F.col("new"))).alias("changed_lines"))
