"""Paths: listings, folder cards, duplicate content, modularity alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import physical_lines, under_prefix

#: File names whose fan-in is their package's.
ENTRY_POINTS = ("lib.rs", "main.rs", "__init__.py", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs", "index.mts", "index.cts")


def _rest(prefix: str) -> Column:
    prefix = prefix.strip("/")
    return F.col("rel") if not prefix else F.substring(F.col("rel"), F.lit(len(prefix) + 2), F.length("rel"))


def list_paths(files: DataFrame, prefix: str = "", depth: int = 1) -> DataFrame:
    """Depth 0: (kind, path, n) of every path under the prefix. Depth 1: direct files, and child directories with the
    number of all files below them."""
    d = files.filter(under_prefix(F.col("rel"), prefix))
    if depth <= 0:
        return d.select(F.lit("file").alias("kind"), F.col("rel").alias("path"), F.lit(1).cast("long").alias("n"))
    if prefix.strip("/"):
        d = d.filter(F.col("rel") != prefix.strip("/"))
    rest = _rest(prefix)
    deep = F.instr(rest, "/") > 0
    return (
        d.select(F.when(deep, "dir").otherwise("file").alias("kind"), F.when(deep, F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(F.col("rel")).alias("path"))
        .groupBy("kind", "path")
        .agg(F.count("*").alias("n"))
    )


def folder_cards(files: DataFrame) -> DataFrame:
    """One row per directory prefix (the root is empty): its direct files, child directories and all files below.

    Every path is counted once for each of its ancestors, so the work is the sum of depths, not paths times prefixes.
    """
    parts = F.split("rel", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), F.get(parts, i).alias("child"), (i == F.size(parts) - 1).alias("direct")))
    d = files.select("rel", F.explode(ups).alias("u")).select("rel", "u.*")
    return d.groupBy("prefix").agg(
        F.count_if("direct").alias("n_files"), F.count_distinct(F.when(~F.col("direct"), F.col("child"))).alias("n_dirs"), F.count("*").alias("file_count")
    )


def line_counts(stat: DataFrame, cache: DataFrame, contents: DataFrame) -> DataFrame:
    """(rel, size, mtime_us, n_lines): a cached count where size and time are the same, else the lines of (rel, text)."""
    d = stat.select("rel", "size", "mtime_us").join(cache.select("rel", "size", "mtime_us", F.col("n_lines").alias("known")), ["rel", "size", "mtime_us"], "left")
    fresh = d.filter("known IS NULL").join(contents.select("rel", "text"), "rel").select("rel", "size", "mtime_us", physical_lines(F.col("text")).alias("n_lines"))
    return d.filter("known IS NOT NULL").select("rel", "size", "mtime_us", F.col("known").cast("long").alias("n_lines")).unionByName(fresh)


def duplicate_content(files: DataFrame) -> DataFrame:
    return files.groupBy("hash").agg(F.count("*").alias("n"), F.min("rel").alias("first_rel")).filter("n > 1")


def _alert(d: DataFrame, kind: str, value: str, threshold: int) -> DataFrame:
    return d.select("file", F.lit(kind).alias("kind"), F.col(value).cast("long").alias("value"), F.lit(threshold).cast("long").alias("threshold"))


def line_alerts(files: DataFrame, max_lines: int) -> DataFrame:
    """Files with more lines than the limit; 0 disables."""
    d = files.filter(F.lit(max_lines > 0) & (F.col("n_lines") > max_lines))
    return _alert(d.select(F.col("rel").alias("file"), "n_lines"), "line_count", "n_lines", max_lines)


def fan_in_alerts(edges: DataFrame, mapped: DataFrame, max_fan_in: int) -> DataFrame:
    """Mapped files (column file) with more importers than the limit; entry points are exempt; 0 disables."""
    n = edges.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n"))
    name = F.element_at(F.split(F.col("file").cast("string"), "/"), -1)
    d = n.join(mapped.select("file").distinct(), "file", "left_semi").filter(F.lit(max_fan_in > 0) & (F.col("n") > max_fan_in) & ~name.isin(*ENTRY_POINTS))
    return _alert(d, "fan_in", "n", max_fan_in)


def severity() -> Column:
    return F.col("value") / F.col("threshold")


def ranked_alerts(alerts: DataFrame, n: int | None = 10) -> DataFrame:
    d = alerts.orderBy(F.desc(severity()), "file", "kind")
    return d if n is None else d.limit(n)


def modularity_by_kind(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("kind").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
