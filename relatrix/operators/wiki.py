"""Wiki files: which text documents a source, and checks over all documented sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..scan.symbols import symbols_column
from . import health as H


def candidates(rel: Column, folders: tuple[str, ...] = ("docs", "wiki", "docs/wiki")) -> Column:
    """Paths that may hold a file's wiki, in order: beside it, then under each folder by path and by name."""
    name = F.element_at(F.split(rel, "/"), -1)
    stem = F.regexp_replace(rel, r"\.[^./]+$", "")
    short = F.regexp_replace(name, r"\.[^./]+$", "")
    beside = [F.concat(rel, F.lit(".wiki.md")), F.concat(stem, F.lit(".wiki.md")), F.concat(rel, F.lit(".md")), F.concat(stem, F.lit(".md"))]
    away = [F.concat(F.lit(f"{d}/"), x, F.lit(e)) for d in folders for x in (rel, stem, name, short) for e in (".wiki.md", ".md")]
    return F.array(*beside, *away)


def find_wikis(files: DataFrame, all_paths: DataFrame) -> DataFrame:
    """(rel) and (rel, text) of every path -> file, path, text: the first candidate that exists and is not the source."""
    d = files.select(F.col("rel").alias("file"), F.posexplode(candidates(F.col("rel"))).alias("pos", "rel"))
    d = d.join(all_paths.select("rel", "text"), "rel").filter("rel <> file")
    return d.groupBy("file").agg(F.min_by(F.struct(F.col("rel").alias("path"), "text"), "pos").alias("m")).select("file", "m.path", "m.text")


def verdicts(health: DataFrame, files: DataFrame, wikis: DataFrame) -> DataFrame:
    """Issues and warning of every health row, against the live source and wiki."""
    live = files.select(F.col("rel").alias("file"), F.col("hash").alias("live_hash"), symbols_column(F.col("rel"), F.coalesce("text", F.lit(""))).alias("symbols"))
    w = wikis.select("file", F.col("text").alias("wiki"), content_hash(F.col("text")).alias("wiki_hash"))
    old = health.select(
        "file",
        "status",
        (F.col("public_symbols") if "public_symbols" in health.columns else F.array().cast("array<string>")).alias("old_symbols"),
        (F.col("wiki_hash") if "wiki_hash" in health.columns else F.lit("")).alias("old_wiki_hash"),
    )
    d = old.join(live, "file", "left").join(w, "file", "left").withColumnRenamed("live_hash", "source_hash")
    return H.wiki_verdict(d)


def verify(health: DataFrame, files: DataFrame, wikis: DataFrame) -> DataFrame:
    """Green rows whose wiki has an issue or a warning."""
    d = verdicts(health, files, wikis).filter(H.is_green(F.col("status")))
    return d.filter((F.size("issues") > 0) | F.col("warning").isNotNull()).select("file", "issues", "warning")
