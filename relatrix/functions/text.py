"""Column functions on paths, texts and line ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def content_hash(text: Column) -> Column:
    """sha256: and lower-case hex of the text with CRLF read as LF."""
    return F.concat(F.lit("sha256:"), F.sha2(normalize_newlines(text), 256))


def physical_lines(text: Column) -> Column:
    """0 for an empty text; else the line feeds, and one more without a final one."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def line_of(text: Column, needles: list[Column] | Column) -> Column:
    """Line of the earliest needle (a list of columns, or an array column) in the text, 1 if there is none."""
    needles = needles if isinstance(needles, Column) else F.array(*needles)
    at = F.transform(F.filter(needles, lambda n: n != ""), lambda n: F.instr(text, n))
    first = F.array_min(F.filter(at, lambda i: i > 0))
    return F.when(first.isNull(), F.lit(1)).otherwise(F.size(F.split(F.substring(text, F.lit(1), first - 1), "\n"))).cast("long")


def under_prefix(path: Column, prefix: str) -> Column:
    prefix = prefix.strip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def normalize_path(path: Column) -> Column:
    """Collapse `.` and `..`; a `..` at the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    )
    return F.array_join(kept, "/")


def glob_regex(pattern: str, star_crosses: bool = True) -> str:
    """A whole-string regular expression for `*` and `?`; `**` always crosses directories."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 2] == "**":
            out.append(".*")
            i += 1
        elif c == "*":
            out.append(".*" if star_crosses else "[^/]*")
        elif c == "?":
            out.append("." if star_crosses else "[^/]")
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def has_word(text: Column, word: str) -> Column:
    return text.rlike(r"(?<![A-Za-z0-9_])" + re.escape(word) + r"(?![A-Za-z0-9_])")


def format_ranges(ranges: Column) -> Column:
    """array<struct<start,end>> as `3, 5-8`."""
    one = lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return F.array_join(F.transform(ranges, one), ", ")


def stamp_key(stamp: Column) -> Column:
    """Seconds on a calendar of 366-day years and 31-day months: monotone, and exact inside one day."""
    days = F.year(stamp) * 366 + F.month(stamp) * 31 + F.dayofmonth(stamp)
    return (days.cast("long") * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)).cast("long")


def split_symbols(text: Column) -> Column:
    """Distinct names of a newline- or comma-separated list, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")))


def match_star(text: Column, pattern: str) -> Column:
    """What `*` stands for if the text matches pre*post, else null."""
    pre, star, post = pattern.partition("*")
    if not star:
        return F.when(text == pattern, F.lit(""))
    fits = text.startswith(pre) & text.endswith(post) & (F.length(text) >= len(pre) + len(post))
    return F.when(fits, F.substring(text, F.lit(len(pre) + 1), F.length(text) - len(pre) - len(post)))
